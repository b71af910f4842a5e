"""N-gram stand-ins, generation strategies and the driver contract."""

import os
import sys

from pyspark.sql import functions as F

from parley.functions.text import EOS
from parley.operators import ngram as ng

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def corpus(spark):
    rows = [(i, "a", t) for i, t in enumerate(["x y z", "x y w", "x z", "y z x y"])]
    return spark.createDataFrame(rows, "seq long, author_id string, content string")


def test_fit_and_candidates(spark):
    m = ng.fit_ngram_model(corpus(spark), 2)
    row = m.where((F.col("prefix") == "x") & (F.col("token") == "y")).first()
    # x is followed by y (3 times) and z (1); vocabulary of a = {x, y, z, w, </s>}
    assert row.cnt == 3 and abs(row.p - (3 + 1) / (4 + 5)) < 1e-12
    c = ng.decode_candidates(m, top_k=100, top_p=0.7, temperature=0.8)
    toks = [r.token for r in c.where(F.col("prefix") == "x").orderBy("rank").collect()]
    assert toks[0] == "y"
    # the kept mass is the first to reach 0.7, and q over all candidates is one
    assert [r.cum - r.q < 0.7 for r in c.collect()] == [True] * c.count()
    whole = ng.decode_candidates(m, top_p=1.1)
    sums = whole.groupBy("author_id", "prefix").agg(F.sum("q").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def plain_reply(model, author, prompt, rid, seed, max_length=200, top_k=100, top_p=0.7, t=0.8):
    """The sampling rule token by token."""
    import hashlib
    import math
    words = [w for w in prompt.replace(EOS, " ").split() if w]
    hist, out = words + [ng.BOS], []
    length = len(words) + prompt.count(EOS)
    for step in range(max_length):
        if length + len(out) >= max_length:
            break
        seen = {tuple(hist[i:i + 3]) for i in range(len(hist) - 2)}
        cs = [(tok, p) for tok, p in model.get((author, hist[-1]), []) if tuple(hist[-2:] + [tok]) not in seen][:top_k]
        w = [math.exp(math.log(p) / t) for _, p in cs]
        q = [x / sum(w) for x in w]
        kept, cum = 0, 0.0
        while kept < len(q) and cum < top_p:
            cum += q[kept]
            kept += 1
        u = int(hashlib.md5(f"{seed}:{rid}:{step}".encode()).hexdigest()[:8], 16) / 2 ** 32
        run, tok = 0.0, None
        for (name, _), x in list(zip(cs, q))[:kept]:
            if run + x >= u * cum:
                tok = name
                break
            run += x
        if tok is None or tok == ng.EOS_TOKEN:
            break
        out.append(tok)
        hist.append(tok)
    return " ".join(out)


def test_sampler_follows_the_rule(spark):
    m = ng.fit_ngram_model(corpus(spark), 2)
    table = {}
    for r in m.orderBy(F.col("p").desc(), "token").collect():
        table.setdefault((r.author_id, r.prefix), []).append((r.token, r.p))
    prompts = [(1, "a", "x y"), (2, "a", "z"), (3, "a", "x y z w x y" + EOS), (4, "nobody", "x"), (5, "a", ""),
               (6, "a", "x " * 198 + EOS)]
    df = spark.createDataFrame(prompts, "seq long, author_id string, prompt string")
    for length, top_p, bucket, share in ((200, 0.7, 10_000, 2), (12, 0.05, 10_000, 1), (12, 0.7, 2, 9), (200, 0.7, 4, 1)):
        got = dict(ng.generate_replies(df, ng.sampler_entries(m), 2, seed=3, max_length=length, top_p=top_p,
                                       bucket_tokens=bucket, task_prompts=share).collect())
        assert got == {i: plain_reply(table, a, p, i, 3, length, top_p=top_p) for i, a, p in prompts}


def test_a_model_beyond_one_task_takes_few_rounds(spark):
    """Frequent prefixes are at hand in every task: a reply of some 60 tokens over a model
    larger than a task holds stops only at rare ones, and writes no tables for its steps."""
    import random
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    texts = [" ".join(rng.choice(rare) if rng.random() < 0.05 else rng.choice(common) for _ in range(60)) for _ in range(100)]
    m = ng.fit_ngram_model(spark.createDataFrame([(i, a, t) for i, t in enumerate(texts) for a in ("a", None)],
                                                 "seq long, author_id string, content string"), 2)
    table = {}
    for r in m.orderBy(F.col("p").desc(), "token").collect():
        table.setdefault((r.author_id, r.prefix), []).append((r.token, r.p))
    prompts = [(i, "a" if i % 3 else None, f"c{i % 12} c1") for i in range(40)]
    df = spark.createDataFrame(prompts, "seq long, author_id string, prompt string")
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(base))
    got = dict(ng.generate_replies(df, ng.sampler_entries(m), 2, seed=3, bucket_tokens=600).collect())
    new = set(os.listdir(base)) - before
    assert got == {i: plain_reply(table, a, p, i, 3) for i, a, p in prompts}
    assert max(len(t.split()) for t in got.values()) > 40
    assert m.count() > 600 and len(new) < 10
    rounds = [f for d in new for f in os.listdir(os.path.join(base, d)) if f.startswith("round=")]
    assert 1 < len(rounds) < 30, len(rounds)


def test_no_prompt_and_no_model(spark):
    m = ng.fit_ngram_model(corpus(spark), 2)
    schema = "seq long, author_id string, prompt string"
    assert ng.generate_replies(spark.createDataFrame([], schema), ng.sampler_entries(m)).count() == 0
    got = ng.generate_replies(spark.createDataFrame([(1, "a", "x"), (2, None, None)], schema),
                              ng.sampler_entries(m.where("false"))).collect()
    assert sorted(map(tuple, got)) == [(1, ""), (2, "")]


def test_generate_with_a_function(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "seq long, prompt string").repartition(3)
    got = ng.generate_with(df, lambda b: b["prompt"].str.upper()).collect()
    assert sorted(map(tuple, got)) == [(i, f"P{i}") for i in range(7)]


def plain_perplexity(train, test, size):
    """R2 row by row: (batches, mean loss)."""
    import math
    from collections import Counter
    cnt, tot, words = Counter(), Counter(), {}
    pairs = lambda t: list(zip([ng.BOS, *t.split()], [*t.split(), ng.EOS_TOKEN]))
    for _, a, t in train:
        for p, w in pairs(t):
            cnt[a, p, w] += 1
            tot[a, p] += 1
            words.setdefault(a, set()).add(w)
    losses = []
    for _, a, t in sorted(r for r in test if r[2] is not None and r[1] in words):
        ps = [(cnt[a, p, w] + 1) / (tot[a, p] + len(words[a])) if tot[a, p] else 1 / len(words[a]) for p, w in pairs(t)]
        losses.append(sum(-math.log(p) for p in ps) / len(ps))
    n = len(losses) // size
    return n, sum(losses[:n * size]) / (n * size) if n else None


def test_perplexity_of_unseen_grams(spark):
    import random
    rnd = random.Random(6)
    make = lambda i, ws: (i, rnd.choice("ab"), " ".join(rnd.choice(ws) for _ in range(rnd.randrange(0, 8))))
    train = [make(i, "xyzw") for i in range(80)]
    test = [make(100 + i, "xyzwQR") for i in range(41)] + [(300, "nobody", "x y"), (301, "a", None), (302, None, "x")]
    schema = "seq long, author_id string, content string"
    m = ng.fit_ngram_model(spark.createDataFrame(train, schema), 2)
    for size in (4, 7):
        got = ng.score_ngram_perplexity(m, spark.createDataFrame(test, schema), 2, batch_size=size).first()
        n, mean = plain_perplexity(train, test, size)
        assert got.batches == n and abs(got.mean_loss - mean) < 1e-8
    none = ng.score_ngram_perplexity(m, spark.createDataFrame(test[:3], schema), 2).first()
    assert tuple(none) == (0, None, None)


def test_entry_contract(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and {"seq", "response"} <= set(df.columns)
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 45


def test_package_is_shipped_once(spark, monkeypatch):
    from parley import session
    added = []
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setattr(spark.sparkContext, "addPyFile", lambda p: added.append(p))
    session.ship_package(spark)
    session.ship_package(spark)
    assert len(added) == 1
    import zipfile
    names = zipfile.ZipFile(added[0]).namelist()
    assert "parley/operators/windows.py" in names and "parley/streaming/stream.py" in names


def test_remove_scratch_takes_old_tables_only(spark):
    from parley import session
    df = session.materialize(spark.range(5))
    path = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    base = os.path.dirname(path)
    os.makedirs(f"{base}/keep-me", exist_ok=True)
    session.remove_scratch(spark, older_than_hours=1)
    assert os.path.isdir(path) and df.count() == 5
    old = f"{base}/table-{'0' * 32}"
    os.makedirs(old, exist_ok=True)
    os.utime(old, (1, 1))
    assert session.remove_scratch(spark, older_than_hours=1) >= 1
    assert not os.path.isdir(old) and os.path.isdir(path) and os.path.isdir(f"{base}/keep-me")
