"""Streaming twins of the batch operators, and source/sink round trips."""

import os
import tempfile

from pyspark.sql import functions as F

from parley.functions.text import EOS
from parley.operators import serve as sv
from parley.operators.clean import clean_messages
from parley.sources import io
from parley.streaming import stream as st

SCHEMA = "seq long, author_id string, content string, channel string"


def chat_rows():
    rows = []
    for i in range(40):
        body = ["hi <@1> there", "plain", "   ", "x <@2> <:e:3>", "http://a.b now", None][i % 6]
        rows.append((i, str(i % 4), body, "c" + str(i % 2)))
    return rows


def test_stream_equals_batch_across_micro_batches(spark):
    rows = chat_rows()
    members = spark.createDataFrame([("1", "Bot", 0), ("2", "Ann", 1)], "id string, name string, pos long")
    src = tempfile.mkdtemp(prefix="parley-src-")
    ck = tempfile.mkdtemp(prefix="parley-ck-")
    out = tempfile.mkdtemp(prefix="parley-out-")
    # two files = two micro-batches; the prompt window must span them
    spark.createDataFrame(rows[:20], SCHEMA).coalesce(1).write.mode("overwrite").parquet(src + "/a")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    spark.createDataFrame(rows[20:], SCHEMA).coalesce(1).write.mode("overwrite").parquet(src + "/b")
    q = st.stream_prompts(stream, members, "1", 3, out, ck)
    q.awaitTermination()
    got = sorted((r.seq, r.prompt) for r in spark.read.parquet(out).collect())
    batch = sv.prompts(spark.createDataFrame(rows, SCHEMA), members, "1", 3)
    assert got == sorted((r.seq, r.prompt) for r in batch.collect())
    assert all(p.endswith(EOS) for _, p in got)

    out2, ck2 = tempfile.mkdtemp(prefix="parley-out-"), tempfile.mkdtemp(prefix="parley-ck-")
    q = st.stream_clean(spark.readStream.schema(SCHEMA).parquet(src + "/*"), members, out2, ck2)
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out2).select("seq", "content").collect())
    exp = clean_messages(spark.createDataFrame(rows, SCHEMA), members).select("seq", "content")
    assert got == sorted(tuple(r) for r in exp.collect())


def test_csv_round_trip_keeps_newlines_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="parley-csv-")
    path = os.path.join(d, "raw_messages.csv")
    with open(path, "w") as f:
        f.write('author_id,content,timestamp,channel\n'
                '1,"line one\nline two",2022-07-06 00:35:18.108,test\n'
                '2,"she said ""hi""",2022-07-01 01:40:39.608,test\n'
                '1,   ,2022-07-01 01:40:37.080,test\n')
    df = io.read_messages(spark, path)          # newest first in the file
    got = [(r.seq, r.author_id, r.content) for r in df.orderBy("seq").collect()]
    assert got == [(-2, "1", "   "), (-1, "2", 'she said "hi"'), (0, "1", "line one\nline two")]
    assert io.read_members(spark, os.path.join(d, "missing.csv")).count() == 0


def test_training_round_trip_and_layout(spark):
    d = tempfile.mkdtemp(prefix="parley-train-")
    df = spark.createDataFrame([(1, "r", ["a", "b"])], "seq long, response string, ctx array<string>")
    io.write_dataset(df, d + "/train", fmt="csv")
    back = io.read_training(spark, d + "/train").first()
    assert back.response == "r" and back.ctx == ["a", "b"]
    t = df.withColumn("guild", F.lit(io.CUSTOM_GUILD)).withColumn("session", F.lit("s1"))
    io.write_dataset(t, d + "/runs", partition_by=("guild", "session"))
    io.write_dataset(t.withColumn("session", F.lit("s2")), d + "/runs", partition_by=("guild", "session"))
    assert io.read_session(spark, d + "/runs", io.CUSTOM_GUILD, "s1").count() == 1
    assert io.session_layout("/r", "g", "s") == "/r/guild=g/session=s"
    snap = io.roster_snapshot(spark.createDataFrame([("1", "A", 0)], "id string, name string, pos long"), ("9", "bot"))
    assert [tuple(r) for r in snap.orderBy("pos").collect()] == [("1", "A", 0), ("9", "bot", 1)]


def test_late_messages_take_their_event_time_place(spark):
    import datetime as dt
    members = spark.createDataFrame([("1", "Bot", 0)], "id string, name string, pos long")
    schema = "seq long, author_id string, content string, channel string, ts timestamp"
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    first = [(1, "a", "one", "c", t(1)), (3, "a", "three", "c", t(3)), (4, "b", "<@1> four", "c", t(4))]
    late = [(2, "a", "two", "c", t(2)), (5, "b", "<@1> five", "c", t(5))]
    src, ck, out = (tempfile.mkdtemp(prefix=p) for p in ("parley-src-", "parley-ck-", "parley-out-"))
    spark.createDataFrame(first, schema).coalesce(1).write.mode("overwrite").parquet(src + "/a")
    spark.createDataFrame(late, schema).coalesce(1).write.mode("overwrite").parquet(src + "/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = st.stream_late_prompts(stream, members, "1", 4, out, ck)
    q.awaitTermination()
    got = dict((r.seq, r.prompt) for r in spark.read.parquet(out).collect())
    # seq 4 was answered before "two" arrived; seq 5 sees "two" in time order
    assert got[4] == f"one{EOS}three{EOS}Bot four{EOS}"
    assert got[5] == f"two{EOS}three{EOS}Bot four{EOS}Bot five{EOS}"


def test_replayed_batch_changes_nothing(spark):
    rows = chat_rows()
    members = spark.createDataFrame([("1", "Bot", 0), ("2", "Ann", 1)], "id string, name string, pos long")
    src, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("parley-src-", "parley-out-", "parley-ck-"))
    for i in range(4):
        spark.createDataFrame(rows[i * 10:i * 10 + 10], SCHEMA).coalesce(1).write.parquet(f"{src}/{i}")
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    st.stream_prompts(read(), members, "1", 3, out, ck).awaitTermination()
    once = sorted((r.seq, r.prompt) for r in spark.read.parquet(out).collect())
    assert once == sorted((r.seq, r.prompt) for r in sv.prompts(
        spark.createDataFrame(rows, SCHEMA), members, "1", 3).collect())
    last = max(int(f) for f in os.listdir(ck + "/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):                    # as if the driver died before the commit
        if os.path.exists(f"{ck}/commits/{f}"):
            os.remove(f"{ck}/commits/{f}")
    st.stream_prompts(read(), members, "1", 3, out, ck).awaitTermination()
    assert sorted((r.seq, r.prompt) for r in spark.read.parquet(out).collect()) == once


def test_null_authors_and_times(spark):
    import datetime as dt
    schema = "seq long, author_id string, content string, channel string, ts timestamp"
    t = dt.datetime(2024, 1, 1)
    rows = [(1, None, "<@1> one", "c", t), (2, "a", "two", "c", None), (3, "1", "<@1> own", "c", t),
            (4, "b", "<@1> four", "c", None)]
    members = spark.createDataFrame([("1", "Bot", 0)], "id string, name string, pos long")
    src = tempfile.mkdtemp(prefix="parley-src-")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(src + "/a")
    read = lambda: spark.readStream.schema(schema).parquet(src + "/*")
    got = st.drain(spark, lambda out, ck: st.stream_triggers(read(), "1", out, ck), "t")
    assert sorted(r.seq for r in got.collect()) == [1, 4]
    got = st.drain(spark, lambda out, ck: st.stream_late_prompts(read(), members, "1", 3, out, ck), "p")
    assert dict((r.seq, r.prompt) for r in got.collect()) == {
        1: f"two{EOS}Bot four{EOS}Bot one{EOS}", 4: f"two{EOS}Bot four{EOS}"}


def test_ingest_orders_by_time_then_file(spark):
    import json
    d = tempfile.mkdtemp(prefix="parley-json-")
    rows = [("a", "one", "2024-01-01T00:00:01"), ("b", "two", "2024-01-01T00:00:00"), ("a", "three", "2024-01-01T00:00:01")]
    with open(d + "/x.json", "w") as f:
        for a, c, ts in rows:
            f.write(json.dumps({"author_id": a, "content": c, "timestamp": ts, "channel": "c"}) + "\n")
    got = [(r.seq, r.content) for r in io.ingest_channels(spark, d).orderBy("seq").collect()]
    assert got == [(0, "two"), (1, "one"), (2, "three")]
    back = [r.content for r in io.ingest_channels(spark, d, newest_first=True).orderBy("seq").collect()]
    assert back == ["two", "three", "one"]
    members = spark.createDataFrame([], "id string, name string, pos long")
    assert clean_messages(io.ingest_channels(spark, d), members).count() == 3


def test_file_order_for_parquet_uses_row_index(spark):
    d = tempfile.mkdtemp(prefix="parley-pq-")
    df = spark.range(0, 3000, numPartitions=3).withColumnRenamed("id", "v")
    df.repartitionByRange(3, "v").sortWithinPartitions("v").write.mode("overwrite").parquet(d)
    raw = spark.read.parquet(d).select("v", "_metadata")
    got = io.with_file_order(raw, newest_first=False).select("v", "seq").collect()
    assert all(r.v == r.seq for r in got) and len(got) == 3000


def test_prompt_state_survives_a_restart(spark):
    # run 1 drains file a; run 2 (same checkpoint) drains file b: the prompt
    # of the first trigger in b still sees the last messages of a
    members = spark.createDataFrame([("1", "Bot", 0)], "id string, name string, pos long")
    schema = "seq long, author_id string, content string, channel string"
    src, ck, out = (tempfile.mkdtemp(prefix=p) for p in ("parley-src-", "parley-ck-", "parley-out-"))
    spark.createDataFrame([(1, "a", "one", "c"), (2, "a", "two", "c")], schema) \
        .coalesce(1).write.mode("overwrite").parquet(src + "/a")
    st.stream_prompts(spark.readStream.schema(schema).parquet(src + "/*"), members, "1", 3, out, ck) \
        .awaitTermination()
    spark.createDataFrame([(3, "b", "<@1> three", "c")], schema).coalesce(1).write.mode("overwrite").parquet(src + "/b")
    st.stream_prompts(spark.readStream.schema(schema).parquet(src + "/*"), members, "1", 3, out, ck) \
        .awaitTermination()
    got = [(r.seq, r.prompt) for r in spark.read.parquet(out).collect()]
    assert got == [(3, f"one{EOS}two{EOS}Bot three{EOS}")]
