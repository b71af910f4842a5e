import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parley.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdeABéü", k=rng.randrange(1, 6))) for _ in range(300)]
    out = [(i, " ".join(rng.choice(vocab[: 20 + i]) for _ in range(rng.randrange(1, 80)))) for i in range(200)]
    out += [(200, None), (201, ""), (202, "seen seen seen " * 400), (203, "Never-Seen zzzz"), (None, "a b"), (300, "Rep eat"),
            (300, "Rep eat")]
    return out


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


def test_base_score_is_exact(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = ~lm.held_out(F.col("doc_id"))
    flags = {r[0]: r[1] for r in df.select("doc_id", learn).distinct().collect()}
    c = Counter(w for i, t in rows if flags[i] for w in split(t))
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    for hot in (10_000, 40, 0):
        got = lm.score(df, learn=learn, hot_types=hot, docs_per_block=40).collect()
        assert len(got) == len(rows)
        for r in got:
            t = split(text[r["doc_id"]])
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
            assert r["n_tokens"] == len(t) and r["n_known"] == sum(c[w] > 0 for w in t) and r["train_tokens"] == n
            assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0


def test_filter_levels_bound_the_counts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, _, hist = lm.fit(df, docs_per_block=50)
    pairs = Counter()
    for _, t in rows:
        w = split(t)
        pairs.update(zip(["\0begin", *w], w))
    assert sum(n for c, n in hist[2].items()) == sum(c >= 2 for c in pairs.values())
    lev = lm.level_of(np.array([2, 3, 4, 100]), 2)
    low = lm.count_of(lev, 2)
    assert all(a / 1.5 <= b <= a * 1.5 for a, b in zip([2, 3, 4, 100], low))
    few, _, _ = lm.fit(df, docs_per_block=50, max_bytes=1000)
    assert sum(len(p.data) for p in few.parts.values()) <= 1000 and few.parts[1].least > 1


def test_known_sequences_score_higher(spark):
    rows = [(i, "alpha beta gamma delta " * 5) for i in range(30)]
    df = spark.createDataFrame(rows + [(100, "alpha beta gamma delta"), (101, "delta beta alpha gamma")],
                               "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(df, learn=F.col("doc_id") < 100).collect()}
    assert got[100] > got[101]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(some, learn=F.lit(False)).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0


def test_score_by_hand(spark):
    """Every text's score from plain counts, rounded to the filter's levels (a filter
    with room enough for no false positive)."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = ~lm.held_out(F.col("doc_id"))
    flags = {r[0]: r[1] for r in df.select("doc_id", learn).distinct().collect()}
    train = [split(t) for i, t in rows if flags[i]]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["\0begin", *t], t))
    n, v = sum(one.values()), len(one)
    seen = lambda c, least: float(lm.count_of(lm.level_of(np.array([c]), least), least)[0]) if c >= least else 0.0
    got = {r["doc_id"]: r["score"] for r in lm.score(df, learn=learn, docs_per_block=40, bits_per_key=90).collect()}
    for i, text in rows:
        total, before = 0.0, "\0begin"
        for w in split(text):
            c1, c2 = seen(one[w], 1), seen(two[before, w], lm.MIN_BIGRAM)
            ch = len(train) if before == "\0begin" else seen(one[before], 1)
            follow = min(c2 / max(ch, c2, 1.0), 1.0)
            total += math.log10(lm.WEIGHT * follow + (1 - lm.WEIGHT) * min((c1 + 0.1) / (n + 0.1 * (v + 1)), 1.0))
            before = w
        assert abs(got[i] - total) < 1e-6, i


def test_a_bounded_filter_leaves_no_ngram_out(spark):
    """The scores do not depend on how many n-grams the filter has room for (bits enough
    for no false positive): those left out are asked from their table."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = ~lm.held_out(F.col("doc_id"))
    key = lambda r: (str(r["doc_id"]), r["score"])
    whole = sorted(lm.score(df, learn=learn, docs_per_block=40, bits_per_key=90).collect(), key=key)
    for size in (30_000, 10_000, 1_000):
        model, _, _ = lm.fit(df.where(learn), docs_per_block=40, bits_per_key=90, max_bytes=size)
        assert sum(len(p.data) for p in model.parts.values()) <= size and any(p.least > p.low for p in model.parts.values())
        got = sorted(lm.score(df, learn=learn, docs_per_block=40, bits_per_key=90, max_bytes=size).collect(), key=key)
        assert [r["doc_id"] for r in got] == [r["doc_id"] for r in whole]
        assert all(abs(a["score"] - b["score"]) < 1e-6 for a, b in zip(got, whole)), size


def test_left_out_ngrams_are_not_asked_row_by_row(spark):
    """However little the filter holds, tokens are not dealt out as rows and joined; what
    goes back to the texts is a few bits per n-gram and block."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    for size in (30_000, 1_000):
        plan = lm.score(df, docs_per_block=40, max_bytes=size)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan, plan
    chunks = lm.pack(df)
    merged = lm.fit_chunks(chunks, docs_per_block=400, max_bytes=1_000)[1].where("chunk is not null and kind = 2")
    told = merged.agg(F.sum(F.length("c"))).first()[0]
    n = sum(len(lm._unsqueeze(bytes(r["c"]))) for r in merged.collect())
    assert n > 1_000 and told < n


def test_few_training_texts_of_many(spark):
    """Blocks smaller than those of the filter give the scores of larger ones."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = F.col("doc_id") < 40
    key = lambda r: (str(r["doc_id"]), r["score"])
    for size in (lm.MAX_FILTER_BYTES, 1_000):
        few, one = (sorted(lm.score(df, learn=learn, docs_per_block=n, bits_per_key=90, max_bytes=size).collect(), key=key)
                    for n in (10, 1_000))
        for a, b in zip(few, one, strict=True):
            assert a["doc_id"] == b["doc_id"] and a["n_known"] == b["n_known"]
            assert abs(a["score"] - b["score"]) < 1e-6 and abs(a["base_score"] - b["base_score"]) < 1e-6


def test_numbers_come_back_from_their_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, lm.FEW - 1, lm.FEW, 5_000):
        for top in (1, 200, 2**34, 2**64 - 1):
            x = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            assert (lm._unsqueeze(lm._squeeze(x)) == x).all()
