import math

import numpy as np
from pyspark.sql import functions as F

from parley.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, ids, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 16
          and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i in ids:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)
            out[i] = d[:k]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16)) * 2
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * 0.4).astype(np.float32).tolist()) for i in range(600)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(40)]                       # a third copy each other: ties
    rows += [(2000, None), (2100, []), (2200, [0.0] * 16), (2300, [float("nan")] + [1.0] * 15), (2400, [1.0] * 8),
             (2500, [None] + [1.0] * 15), (None, same), (2700, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = ann.search(df, F.col("vec_id") % 100 == 0, block=64, query_block=4).collect()
    want = brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0})
    assert {r["query_id"] for r in got} == set(want)
    hits = total = 0
    for q, best in want.items():
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11)) and [r[1:] for r in mine] == sorted(r[1:] for r in mine)
        hits += len({j for _, j in best} & {r[2] for r in mine})
        total += len(best)
    assert hits / total >= 0.99
    tied = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 1000)
    assert [v for _, v in tied] == [7, *range(1001, 1010)]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal((20, 64))
    centre, turn = x.mean(axis=0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    low, high = ann.bounds(q, *ann.encode(x, centre, turn), centre, turn, 3.0)
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert ((low <= d + 1e-9) & (d <= high + 1e-9)).mean() > 0.99


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x"), (1, [1.0, 2.5], "x")], SCHEMA)
    got = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.5)]
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_queries_are_one(spark):
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (0, [5.0, 0.0], "x")] + [(i, [float(i), 1.0], "x") for i in range(1, 9)]
    rows += [(3, [3.0, 1.0], "x")]                          # a candidate row that repeats counts twice
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, k=6, block=4).collect()
    want = sorted((min(math.dist(v, q) for _, q, _ in rows[:3]), i) for i, v, _ in rows[3:])[:6]
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert all(abs(r["score"] - want[r["rank"] - 1][0]) < 1e-12 for r in got)
