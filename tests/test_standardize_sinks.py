"""Roster standardisation (T1..T6) and the remaining sources/sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from parley.operators import evaluate as ev
from parley.operators import sequences as sq
from parley.operators import standardize as st
from parley.sources import io


def test_missing_and_extend(spark):
    msgs = spark.createDataFrame([(1, 5, "a"), (2, 7, "b"), (3, None, "c"), (4, 5, "d")],
                                 "seq long, who long, text string")
    std = st.standardize(msgs, "who", "text")
    assert std.columns == ["seq", "author_id", "content"]
    members = spark.createDataFrame([("5", "Five", 0)], "id string, name string, pos long")
    miss = st.missing_members(std, members)
    assert [r.id for r in miss.collect()] == ["7"]
    over = spark.createDataFrame([("7", "Seven")], "id string, name string")
    ext = st.extend_members(members, miss, over)
    assert sorted((r.id, r.name) for r in ext.collect()) == [("5", "Five"), ("7", "Seven")]
    assert ext.where("id = '7'").first().pos > 0
    plain = st.extend_members(members, miss)
    assert plain.where("id = '7'").first().name == "7"


def test_assign_target(spark):
    members = spark.createDataFrame([("5", "Five", 0), ("7", "Seven", 1)], "id string, name string, pos long")
    assert st.assign_target(members, "Five", "7").where("name = 'Five'").count() == 1
    renamed = st.assign_target(members, "Target", "7")
    assert renamed.where("id = '7'").first().name == "Target"
    with pytest.raises(st.UnknownMemberError):
        st.assign_target(members, "Target", "9")


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    got = {r.column: (r.dtype, r.non_null, r.rows) for r in st.profile(df).collect()}
    assert got == {"a": ("bigint", 2, 2), "b": ("string", 1, 2)}


def test_ingest_channels(spark):
    d = tempfile.mkdtemp(prefix="parley-json-")
    with open(os.path.join(d, "dump.json"), "w") as f:
        for ch, i in (("general", 1), ("random", 2), ("general", 3)):
            f.write(json.dumps({"author_id": i, "content": f"m{i}", "timestamp": "2022-07-01 01:40:3%d" % i,
                                "channel": ch}) + "\n")
    assert io.ingest_channels(spark, d).count() == 3
    assert io.ingest_channels(spark, d, ["general"]).count() == 2
    with pytest.raises(io.ChannelError):
        io.ingest_channels(spark, d, ["voice"])


def test_eval_report_and_feature_cache(spark):
    d = tempfile.mkdtemp(prefix="parley-rep-")
    scores = spark.createDataFrame([("rouge2", 1.5), ("perplexity", 3.0)], "metric string, value double")
    ev.write_eval_report(scores, d + "/report")
    lines = [r.value for r in spark.read.text(d + "/report").collect()]
    assert lines == ["perplexity = 3.0", "rouge2 = 1.5"]


def test_feature_cache_follows_its_input(spark):
    path = tempfile.mkdtemp(prefix="parley-feat-") + "/feat"
    texts = spark.createDataFrame([(1, "a b"), (2, None), (2, None)], "seq long, content string")
    built = []

    def cached(rows, overwrite=False, **params):
        def build():
            built.append(1)
            return rows.withColumn("n", F.length("content"))
        return sorted(map(tuple, sq.cache_features(build, path, {"rows": rows}, params, overwrite).collect()), key=str)

    first = cached(texts, k=2)
    assert cached(texts.repartition(3), k=2) == first and len(built) == 1      # equal rows in another order
    assert cached(texts.orderBy("content"), overwrite=True, k=2) == first and len(built) == 2
    assert cached(texts, k=3) == first and len(built) == 3                     # another parameter
    for changed in (texts.limit(2), texts.withColumn("content", F.upper("content")), texts.where("false"),
                    texts.select("content", "seq"), texts.withColumnRenamed("seq", "id")):
        before = len(built)
        cached(changed, k=3)
        assert len(built) == before + 1

    def fails():
        raise RuntimeError("no")
    cached(texts, k=2)
    with pytest.raises(RuntimeError):
        sq.cache_features(fails, path, {"rows": texts}, {"k": 9}, overwrite=False)
    assert cached(texts, k=2) == first                                         # the failed build left the rows


def test_fingerprint_sees_nulls_and_nesting(spark):
    def of(rows, schema="a string, b string, c array<string>"):
        return sq.fingerprint(spark.createDataFrame(rows, schema))
    tables = [[("x", None, None)], [(None, "x", None)], [(None, None, ["x", None])], [(None, None, [None, "x"])],
              [("x", None, None)] * 2, [("x", None, [])], []]
    assert len({of(t) for t in tables}) == len(tables)
    assert of([("1", "2", ["3"]), ("4", None, None)]) == of([("4", None, None), ("1", "2", ["3"])])
