"""Evaluation: ROUGE against straightforward Python versions, LCS kernels."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parley.functions import lcs as L
from parley.operators import evaluate as ev

import re

TOK = re.compile(r"[a-z0-9]+")


def py_rouge_n(pred, ref, n):
    def grams(t):
        toks = TOK.findall(t.lower())
        return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))
    gp, gr = grams(pred), grams(ref)
    ov = sum(min(c, gp[g]) for g, c in gr.items())
    p, r = ov / max(sum(gp.values()), 1), ov / max(sum(gr.values()), 1)
    return p, r, L.fmeasure(p, r)


def texts(seed, n=60):
    rnd = random.Random(seed)
    words = ["the", "cat", "sat", "on", "mat", "A", "dog", "ran", "x1", "Été"]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_rouge_n_matches_python(spark):
    preds, refs = texts(1), texts(2)
    df = spark.createDataFrame(list(zip(range(len(preds)), preds, refs)), "seq long, pred string, label string")
    for n in (1, 2):
        got = {r.seq: (r[f"rouge{n}_p"], r[f"rouge{n}_r"], r[f"rouge{n}_f"]) for r in ev.rouge_n(df, n).collect()}
        for i, (p, r) in enumerate(zip(preds, refs)):
            exp = py_rouge_n(p, r, n)
            assert all(abs(a - b) < 1e-12 for a, b in zip(got[i], exp)), (i, n)


def dp_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_lcs_kernels():
    rnd = random.Random(0)
    for _ in range(200):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        assert L.lcs_length(a, b) == dp_lcs(a, b)
        idx = L.lcs_indices(a, b)
        assert len(idx) == dp_lcs(a, b)
        assert idx == sorted(idx)


def test_rouge_l_udf(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat on the mat"), (2, "", "x")],
                               "seq long, pred string, label string")
    got = {r.seq: r for r in ev.rouge_l(df).collect()}
    assert abs(got[1].rougeL_p - 2 / 3) < 1e-12 and abs(got[1].rougeL_r - 2 / 5) < 1e-12
    assert got[2].rougeL_f == 0.0 and got[2].rougeLsum_f == 0.0


def test_bootstrap_weights_are_poisson():
    ids, reps = np.arange(20_000), np.arange(1, 4)
    w = ev.bootstrap_weights(ids, reps, 1)
    assert abs(w.mean() - 1.0) < 0.02 and abs(w.var() - 1.0) < 0.03
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.03
    assert (ev.bootstrap_weights(ids[5:9], reps, 1) == w[5:9]).all()


def test_bootstrap_against_plain_sums(spark):
    rnd = random.Random(3)
    rows = [(i * 7, rnd.random(), None if i % 9 == 0 else rnd.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "seq long, a double, b double").repartition(5)
    got = {(r.metric, r.kind): r.value for r in ev.rouge_mid(df, ["a", "b"], seed=4, samples=51).collect()}
    w = ev.bootstrap_weights(np.array([r[0] for r in rows]), np.arange(1, 52), 4)
    for i, m in ((1, "a"), (2, "b")):
        x = np.array([np.nan if r[i] is None else r[i] for r in rows])
        ok = ~np.isnan(x)
        means = (x[ok][:, None] * w[ok]).sum(axis=0) / w[ok].sum(axis=0)
        assert abs(got[m, "mid"] - 100 * np.median(means)) < 1e-4 and abs(got[m, "mean"] - 100 * x[ok].mean()) < 1e-4
    none = ev.rouge_mid(df.where("false"), ["a", "b"], samples=5).collect()
    assert {r.value for r in none} == {None} and len(none) == 4


def test_bootstrap_moves_vectors_not_pairs(spark):
    df = spark.range(5000).select(F.col("id").alias("seq"), F.rand(1).alias("a")).repartition(6)
    plan = ev.rouge_mid(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    head = plan[:plan.rindex("MapInArrow add_rows")]       # everything above the sums of the tasks
    assert head.count("MapInArrow") == 2 and "seq" not in head


def test_lsum_against_the_plain_union(spark):
    rnd = random.Random(5)
    text = lambda: "\n".join(" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 4)))
    rows = [(i, text(), text()) for i in range(60)]
    got = {r.seq: r for r in ev.rouge_l(spark.createDataFrame(rows, "seq long, pred string, label string")).collect()}
    for i, pred, ref in rows:
        ps, rs = ([s.split() for s in t.split("\n") if s] for t in (pred, ref))
        n, m = sum(map(len, ps)), sum(map(len, rs))
        hits = Counter()
        for r in rs:
            for k in set().union(*[L.lcs_indices(r, p) for p in ps]):
                hits[r[k]] += 1
        o = sum(min(c, sum(p.count(t) for p in ps)) for t, c in hits.items())
        assert abs(got[i].rougeLsum_p - (o / n if n and m else 0)) < 1e-12
        assert abs(got[i].rougeLsum_r - (o / m if n and m else 0)) < 1e-12


def test_loss_summary(spark):
    log = spark.createDataFrame([(i + 1, float(i % 3)) for i in range(10)], "step long, loss double")
    assert tuple(ev.loss_summary(log).first()) == (10, 0.9)
    assert tuple(ev.loss_summary(log.where("false")).first()) == (None, None)


def test_perplexity_and_curve(spark):
    losses = spark.createDataFrame([(i + 1, float(i % 3)) for i in range(10)], "step long, loss double")
    p = ev.perplexity(losses).first()
    assert p.batches == 10 and abs(p.mean_loss - 0.9) < 1e-9
    curve = ev.loss_curve(losses, every=4).orderBy("block").collect()
    assert [(r.block, r.step) for r in curve] == [(0, 4), (1, 8)]
    empty = spark.createDataFrame([], "step long, loss double")
    assert ev.perplexity(empty).first().perplexity is None


def test_lcs_readout_low_memory_path_matches_full_table(monkeypatch):
    rnd = random.Random(4)
    cases = [([rnd.choice("abcde") for _ in range(rnd.randint(1, 60))],
              [rnd.choice("abcde") for _ in range(rnd.randint(1, 60))]) for _ in range(60)]
    full = [L.lcs_indices(a, b) for a, b in cases]
    monkeypatch.setattr(L, "DP_CELLS", 10)
    low = [L.lcs_indices(a, b) for a, b in cases]
    assert full == low


def test_lsum_single_sentence_is_rouge_l():
    rnd = random.Random(9)
    for _ in range(50):
        a = [rnd.choice("abc") for _ in range(rnd.randint(0, 15))]
        b = [rnd.choice("abc") for _ in range(rnd.randint(0, 15))]
        monkey = L.rouge_lsum([a], [b])
        # the general union path on the same single pair
        m, n = len(a), len(b)
        if m and n:
            hits = len(L.lcs_indices(a, b))
            assert monkey == (hits / n, hits / m, L.fmeasure(hits / n, hits / m))
