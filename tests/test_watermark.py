"""X4 with a watermark: late rows inside and beyond it, idle channels forgotten."""

import datetime as dt
import glob
import random
import tempfile

from parley.functions.text import EOS
from parley.streaming import stream as st

SCHEMA = "seq long, author_id string, content string, channel string, ts timestamp"


def at(minutes):
    return None if minutes is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def replay(batches, k, delay, idle):
    """Plain Python: (prompts, late seqs, rows kept after every batch)."""
    kept, newest, prompts, late, sizes = [], None, {}, [], []
    for batch in batches:
        low = None if newest is None else newest - delay
        new = [r for r in batch if low is None or r[4] is None or r[4] >= low]
        late += [r[0] for r in batch if r not in new]
        kept = kept + new
        key = lambda r: (r[4] is not None, r[4] or 0, r[0])
        for r in new:
            if "<@1>" in (r[2] or "") and r[1] != "1":
                before = sorted((x for x in kept if x[3] == r[3] and key(x) <= key(r)), key=key)[-k:]
                prompts[r[0]] = "".join((x[2] or "").replace("<@1>", "Bot") + EOS for x in before)
        newest = max([t for t in (newest, *(r[4] for r in new)) if t is not None], default=None)
        if newest is not None:
            low, out = newest - delay, []
            for c in {r[3] for r in kept}:
                own = sorted((r for r in kept if r[3] == c), key=key)
                times = [r[4] for r in own if r[4] is not None]
                if idle is not None and times and max(times) < low - idle:
                    continue
                old = [r for r in own if r[4] is None or r[4] < low]
                out += old[-(k - 1):] + [r for r in own if r not in old]
            kept = out
        sizes.append(len(kept))
    return prompts, late, sizes


def run(spark, batches, k, delay, idle):
    members = spark.createDataFrame([("1", "Bot", 0)], "id string, name string, pos long")
    src, ck, out = (tempfile.mkdtemp(prefix=p) for p in ("parley-src-", "parley-ck-", "parley-out-"))
    sizes = []
    for i, batch in enumerate(batches):
        spark.createDataFrame([(*r[:4], at(r[4])) for r in batch], SCHEMA).coalesce(1).write.parquet(f"{src}/{i}")
        st.stream_late_prompts(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), members, "1", k, out, ck,
                               delay=delay, idle=idle).awaitTermination()
        sizes.append(spark.read.parquet(st.batch_dir(st.tail_dir(ck), i)).count())
    prompts = {r.seq: r.prompt for r in spark.read.schema("seq long, prompt string").parquet(out).collect()}
    late = sorted(r.seq for r in spark.read.schema("seq long").parquet(st.late_dir(out)).collect()) \
        if glob.glob(st.late_dir(out)) else []
    assert len(glob.glob(st.tail_dir(ck) + "/batch=*")) <= 2          # older tails are removed
    return prompts, late, sizes


def test_late_rows_and_idle_channels(spark):
    batches = [
        [(1, "a", "one", "c", 0), (2, "a", "three", "c", 30), (3, "a", "x", "quiet", 1)],
        # 20 is late but in time; the trigger of minute 25 sees it; -60 is beyond the watermark
        [(4, "a", "two", "c", 20), (5, "b", "<@1> four", "c", 25), (6, "b", "<@1> gone", "c", -60)],
        [(7, "a", "far", "c", 500)],
        [(8, "b", "<@1> y", "quiet", 480), (9, "b", "<@1> z", "quiet", 490), (10, "b", "<@1> five", "c", 501), (11, "b", "<@1> none", "c", None)],
    ]
    got = run(spark, batches, 3, "60 minutes", "120 minutes")
    want = replay(batches, 3, 60, 120)
    assert got[0] == want[0] and got[1] == sorted(want[1]) and got[2] == want[2]
    assert got[0][5] == f"one{EOS}two{EOS}Bot four{EOS}" and got[1] == [6]
    assert got[0][8] == f"Bot y{EOS}" and got[0][9] == f"Bot y{EOS}Bot z{EOS}"      # "x" was forgotten
    assert got[2][2] < got[2][1]                                      # and the state became smaller


def test_random_arrivals(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice("ab"), rnd.choice(["m", "<@1> q"]) + str(i), rnd.choice("cccde"), i * 3) for i in range(160)]
    arrive = sorted(rows, key=lambda r: r[4] + rnd.choice([0, 0, 0, 40, 400]))
    batches = [arrive[i:i + 40] for i in range(0, 160, 40)]
    got = run(spark, batches, 4, "50 minutes", "30 minutes")
    want = replay(batches, 4, 50, 30)
    assert got[0] == want[0] and got[1] == sorted(want[1]) and got[2] == want[2] and got[1]
