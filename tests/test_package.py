"""Packaging: the original tool's two preprocess cases, window and split invariants."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import package as pk
from parley.operators.windows import dense_index, preceding

# the original tool's fixture: one author, newest first
RAW = ["8...", "7...", "6...", "5..", "4..", "3..", "2..", "1..."]


def fixture(spark):
    n = len(RAW)
    rows = [(n - 1 - i, "111111111111111111", c, "test") for i, c in enumerate(RAW)]
    msgs = spark.createDataFrame(rows, "seq long, author_id string, content string, channel string")
    members = spark.createDataFrame([("111111111111111111", "SomeUser", 0)], "id string, name string, pos long")
    return msgs, members


def test_standard_preprocess(spark):
    msgs, members = fixture(spark)
    out = pk.package_for_training(msgs, members, "SomeUser", pk.PackageParams(length=6, test_perc=0.1))
    packaged = sorted((r.response, tuple(r.ctx)) for r in out["packaged"].collect())
    assert packaged == [("7...", ("6...", "5..", "4..", "3..", "2..", "1...")),
                        ("8...", ("7...", "6...", "5..", "4..", "3..", "2.."))]
    assert out["train"].count() == 2
    assert out["test"].count() == 2           # fallback copies the first train rows


def test_extrapolated_preprocess(spark):
    msgs, members = fixture(spark)
    out = pk.package_for_training(msgs, members, "SomeUser",
                                  pk.PackageParams(length=2, window=6, test_perc=0.1))
    train = out["train"]
    assert train.count() == 30
    first = [tuple(r.ctx) for r in train.where(F.col("response") == "7...").orderBy("combo").limit(3).collect()]
    assert first == [("6...", "5.."), ("6...", "4.."), ("6...", "3..")]
    assert out["test"].count() == 4


def test_params_validation():
    import pytest
    with pytest.raises(pk.ParamError):
        pk.PackageParams(length=0)
    with pytest.raises(pk.ParamError):
        pk.PackageParams(length=3, window=3)
    with pytest.raises(pk.ParamError):
        pk.PackageParams(test_perc=1.0)


def test_unknown_target(spark):
    import pytest
    msgs, members = fixture(spark)
    with pytest.raises(pk.TargetNotFoundError):
        pk.resolve_target(members, "Nobody")


def random_messages(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ch = "hot" if rnd.random() < 0.6 else f"c{rnd.randint(0, 20)}"
        content = None if rnd.random() < 0.05 else f"m{i}"
        rows.append((i * 3 + rnd.randint(0, 2), str(rnd.randint(0, 9)), content, ch))
    return spark.createDataFrame(rows, "seq long, author_id string, content string, channel string")


def brute(df, k, by):
    w = Window.partitionBy(*by).orderBy("seq") if by else Window.orderBy("seq")
    lags = F.array(*[F.lag("content", i).over(w) for i in range(1, k + 1)])
    nb = F.least(F.row_number().over(w) - 1, F.lit(k))
    return df.select("seq", F.slice(lags, 1, nb).alias("ctx"), nb.alias("n_before"))


def test_preceding_split_path_equals_plain_lag(spark):
    df = random_messages(spark)
    for by in (["channel"], []):
        for k in (1, 3, 6):
            got = preceding(df, k, by, block_rows=97).select("seq", "ctx", "n_before")
            exp = brute(df, k, by)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect())), (by, k)


def test_preceding_tiny_blocks(spark):
    # blocks smaller than k: the repair must reach back over several blocks
    df = random_messages(spark, n=400, seed=3)
    got = preceding(df, 8, [], block_rows=5).select("seq", "ctx", "n_before")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute(df, 8, []).collect()))


def test_dense_index(spark):
    df = random_messages(spark, n=2000, seed=11)
    got = dense_index(df, ["seq"], block_rows=100).select("seq", "pos")
    exp = df.select("seq", (F.row_number().over(Window.orderBy("seq")) - 1).alias("pos"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_dense_index_ties_and_nulls(spark):
    rows = [(i, None if i % 5 == 0 else i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "seq long, k long")
    exp = [r[0] for r in df.orderBy("k", "seq").collect()]
    for block in (50, 10_000):
        got = dense_index(df, ["k", "seq"], block_rows=block).orderBy("pos").collect()
        assert [r["seq"] for r in got] == exp and [r["pos"] for r in got] == list(range(1000))


def test_split_exact(spark):
    df = spark.range(100003).withColumnRenamed("id", "seq").withColumn("response", F.lit("r"))
    train, test = pk.split_exact(df, 0.29, 5, max_edge_rows=500)
    n_test = int(0.29 * 100003)
    assert test.count() == n_test
    assert train.count() == 100003 - n_test
    assert test.join(train, "seq").count() == 0
    ranked = df.withColumn("k", pk.shuffle_key(5)).withColumn(
        "r", F.row_number().over(Window.orderBy("k", "seq")))
    exp = {r[0] for r in ranked.where(F.col("r") <= n_test).select("seq").collect()}
    assert {r[0] for r in test.select("seq").collect()} == exp


def test_split_truncates_like_python(spark):
    df = spark.range(100).withColumnRenamed("id", "seq")
    _, test = pk.split_exact(df, 0.29, 1)
    assert test.count() == 28


def test_preceding_composite_order_with_ties(spark):
    # the first order column has heavy ties (one timestamp for many rows):
    # ranges keep ties together, the window orders by (ts, seq)
    rnd = random.Random(5)
    rows = [(i, f"m{i}", "hot" if rnd.random() < 0.7 else "cold", rnd.choice([10, 10, 10, 20, 30]) + i // 500)
            for i in range(2500)]
    df = spark.createDataFrame(rows, "seq long, content string, channel string, ts long")
    got = preceding(df, 4, ["channel"], ["ts", "seq"], block_rows=150).select("seq", "ctx", "n_before")
    w = Window.partitionBy("channel").orderBy("ts", "seq")
    lags = F.array(*[F.lag("content", i).over(w) for i in range(1, 5)])
    nb = F.least(F.row_number().over(w) - 1, F.lit(4))
    exp = df.select("seq", F.slice(lags, 1, nb).alias("ctx"), nb.alias("n_before"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_preceding_null_scope_is_a_scope(spark):
    rows = [(i, None if i % 3 else "x", f"m{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, channel string, content string")
    got = preceding(df, 3, ["channel"], block_rows=200).select("seq", "ctx", "n_before")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute(df, 3, ["channel"]).collect()))


def test_check_params_says_what_the_constructor_says(spark):
    import pytest
    rows = [(n, w, p) for n in (None, 0, 1, 3) for w in (None, 0, 1, 4) for p in (None, 0.0, 0.3, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, length int, window int, test_perc double")
    for r in pk.check_params(df).collect():
        if r.error is None:
            pk.PackageParams(r.length, r.window, r.test_perc)
        else:
            with pytest.raises(pk.ParamError, match=r.error):
                pk.PackageParams(r.length, r.window, r.test_perc)
