"""P1, P7, P9, P14 for many targets at once."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import package as pk
from parley.operators.windows import running_totals


def grouped_rows(spark):
    rnd = random.Random(2)
    names = ["hot"] * 3000 + ["mid"] * 300 + [f"n{i % 60}" for i in range(400)] + [None] * 50 + ["one"]
    rnd.shuffle(names)
    return spark.createDataFrame([(i, n, f"r{i}") for i, n in enumerate(names)], "seq long, target string, response string")


@pytest.mark.parametrize("edge", [2_000_000, 3, 1])
def test_split_exact_by_equals_ranks_per_target(spark, edge):
    df = grouped_rows(spark)
    train, test = pk.split_exact_by(df, ["target"], 0.29, 5, max_edge_rows=edge)
    w = Window.partitionBy("target")
    ranked = df.withColumn("r", F.row_number().over(w.orderBy(pk.shuffle_key(5), "seq"))) \
        .withColumn("n", F.floor(F.lit(0.29) * F.count(F.lit(1)).over(w).cast("double")))
    want = {r.seq for r in ranked.where("r <= n").select("seq").collect()}
    assert {r.seq for r in test.collect()} == want and test.count() == len(want)
    assert {r.seq for r in train.collect()} == set(range(df.count())) - want
    assert train.columns == df.columns and test.where("target = 'one'").count() == 0


def test_no_plan_sorts_a_whole_target(spark):
    """The windows rank counts and edge buckets; the rows themselves are only filtered."""
    df = grouped_rows(spark)
    train, test = pk.split_exact_by(df, ["target"], 0.29, 5)
    for t in (train, test):
        assert "Window" not in t._jdf.queryExecution().optimizedPlan().toString()


def test_empty_and_single(spark):
    none = grouped_rows(spark).where("false")
    train, test = pk.split_exact_by(none, ["target"], 0.5, 1)
    assert train.count() == test.count() == 0


def test_min_test_per_target(spark):
    df = grouped_rows(spark)
    train, test = pk.split_exact_by(df, ["target"], 0.1, 5)
    out = pk.ensure_min_test_by(train, test, ["target"], 5).groupBy("target").count().collect()
    sizes = {r["target"]: r["count"] for r in df.groupBy("target").count().collect()}
    assert {r["target"]: r["count"] for r in out} == {
        t: int(0.1 * n) if int(0.1 * n) >= 4 else min(4, n - int(0.1 * n)) for t, n in sizes.items()}


def chat(spark):
    rnd = random.Random(4)
    rows = [(i, str(rnd.randrange(1, 5)), f"m{i}", rnd.choice("xy")) for i in range(500)]
    members = [("1", "Ann", 0), ("2", "Bob", 1), ("9", "Ann", 2), ("3", "Cy", 3), ("3", "Twin", 4)]
    return (spark.createDataFrame(rows, "seq long, author_id string, content string, channel string"),
            spark.createDataFrame(members, "id string, name string, pos long"))


def test_each_target_equals_its_own_run(spark):
    msgs, members = chat(spark)
    params = pk.PackageParams(length=1, window=3, test_perc=0.2, seed=3)
    many = pk.package_for_training(msgs, members, ["Ann", "Bob", "Twin", "Cy", "Ann"], params)
    for name in ("Ann", "Bob", "Cy", "Twin"):
        alone = pk.package_for_training(msgs, members, name, params)
        for part in ("packaged", "train", "test"):
            got = many[part].where(F.col("target") == name).drop("target").select(*alone[part].columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, alone[part].collect())), (name, part)


def test_resolve_targets(spark):
    _, members = chat(spark)
    got = {(r.target, r.id) for r in pk.resolve_targets(members, ["Ann", "Twin"]).collect()}
    assert got == {("Ann", "1"), ("Twin", "3")}
    with pytest.raises(pk.TargetNotFoundError, match="Zed"):
        pk.resolve_targets(members, ["Ann", "Zed"])


def test_running_totals(spark):
    rows = [(i, (i * 7) % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(4)
    got = {r.k: r.off for r in running_totals(df, ["k"], "n", "off", block_rows=37).collect()}
    acc = 0
    for k, n in rows:
        assert got[k] == acc
        acc += n
