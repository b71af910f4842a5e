"""Queries for sources, sinks and standardisation (S2..S8, T1, T4, C8, F4, F7).

Each writes what Spark derives from the driver tables to scratch storage with
the sink under test, and reads it back with the source under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import clean as cl
from parley.operators import evaluate as ev
from parley.operators import package as pk
from parley.operators import sequences as sq
from parley.operators import standardize as st
from parley.plans import q_evaluate as qe
from parley.plans import q_package as qp
from parley.plans import q_sequences as qs
from parley.plans import views as v
from parley.plans.catalog import register
from parley.session import materialize
from parley.sources import io
from parley.streaming.stream import _scratch

FILE_ROWS = 200_000      # rows of a written CSV file (a multi-line CSV file is read by one task)
NARROW = 400             # batches wider than this are dropped


def ordered_csv(df, order, path, descending=False):
    """``df`` as CSV files whose path order and row order follow ``order``;
    the number of files follows the number of rows."""
    col = F.col(order).desc() if descending else F.col(order)
    files = max(1, -(-df.count() // FILE_ROWS))
    io.write_dataset(df.repartitionByRange(files, col).sortWithinPartitions(col).drop(order), path, fmt="csv")
    return path


@register("standardize", "SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS author_id, props AS content FROM events")
def standardize(spark, sf):
    e = v.table(spark, sf, "events").withColumnRenamed("event_id", "seq")
    return st.standardize(e, "user_id", "props")


@register("reverse_order", v.with_views("chat") + """
SELECT 1 - row_number() OVER (ORDER BY seq DESC) AS seq, author_id, content FROM chat""")
def reverse_order(spark, sf):
    """An export that is newest first; ``seq`` still ascends with time."""
    chat = v.chat(spark, sf).select("seq", "author_id", "content")
    path = ordered_csv(chat, "seq", _scratch(spark, "newest-first"), descending=True)
    return io.read_messages(spark, path, newest_first=True).select("seq", "author_id", "content")


@register("ingest_channels", v.with_views("chat") + """
SELECT row_number() OVER (ORDER BY ts, seq) - 1 AS seq, author_id, content, channel FROM chat""")
def ingest_channels(spark, sf):
    path = _scratch(spark, "channels")
    chat = v.chat(spark, sf).select("seq", "author_id", "content", F.col("ts").cast("string").alias("timestamp"),
                                    "channel")
    chat.repartitionByRange(4, "seq").sortWithinPartitions("seq").drop("seq") \
        .write.option("ignoreNullFields", False).json(path)
    return io.ingest_channels(spark, path).select("seq", "author_id", "content", "channel")


@register("roster_snapshot", v.with_views("members") + f"""
SELECT id, name, row_number() OVER (ORDER BY pos) - 1 AS pos FROM members
UNION ALL SELECT '{v.BOT_ID}', 'bot', (SELECT count(*) FROM members)""")
def roster_snapshot(spark, sf):
    m = v.members(spark, sf)
    back = io.read_members(spark, ordered_csv(m, "pos", _scratch(spark, "members")))
    return io.roster_snapshot(back, (v.BOT_ID, "bot"))


@register("training_round_trip", v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
win AS ({qp._lags(2, 'seq', 'PARTITION BY channel')})""") + f"""
SELECT CAST(seq AS VARCHAR) AS seq, response, context1, context2 FROM win
WHERE author_id = {qp._TARGET_ID} AND rn > 2""")
def training_round_trip(spark, sf):
    path = _scratch(spark, "training")
    io.write_dataset(qp.target_rows(spark, sf, 2, "channel").select("seq", "response", "ctx"), path, fmt="csv", k=2)
    return pk.flatten_context(io.read_training(spark, path), 2)


@register("session_round_trip", v.with_views("chat") + """
SELECT 's1' AS session, seq, author_id, content FROM chat
UNION ALL SELECT 's2', seq, author_id, 'other' FROM chat
UNION ALL SELECT 's3', seq, author_id, content FROM chat WHERE seq % 2 = 1""")
def session_round_trip(spark, sf):
    """Sessions written in turn to one folder, one of them twice: each write
    replaces its own session and no other."""
    root = _scratch(spark, "sessions")
    chat = v.chat(spark, sf).select("seq", "author_id", "content")
    rows = lambda s, x: x.withColumn("guild", F.lit(io.CUSTOM_GUILD)).withColumn("session", F.lit(s))
    for part in (rows("s1", chat.withColumn("content", F.lit("old"))),
                 rows("s2", chat.withColumn("content", F.lit("other"))),
                 rows("s1", chat)):
        io.write_dataset(part, root, partition_by=("guild", "session"))
    io.write_session(chat, root, io.CUSTOM_GUILD, "s3")
    # a run may be made from the one it replaces
    before = io.read_session(spark, root, io.CUSTOM_GUILD, "s3").select(*chat.columns)
    io.write_session(before.where("seq % 2 = 1"), root, io.CUSTOM_GUILD, "s3")
    back = [io.read_session(spark, root, io.CUSTOM_GUILD, s) for s in ("s1", "s2", "s3")]
    return back[0].unionByName(back[1]).unionByName(back[2]).select("session", "seq", "author_id", "content")


@register("multi_session_clean", v.with_views("chat", "members", extra=v.CLEAN_SQL) + """
SELECT s.session, c.seq, c.content FROM cleaned c, (VALUES ('a'), ('b')) s(session)""")
def multi_session_clean(spark, sf):
    """Two sessions numbered alike: no row of one replaces a row of the other."""
    chat = v.chat(spark, sf)
    both = chat.withColumn("session", F.lit("a")).unionByName(chat.withColumn("session", F.lit("b")))
    return cl.clean_messages(both, v.members(spark, sf)).select("session", "seq", "content")


@register("cache_features", qs._BASE + "," + qs.VOCAB_SQL + "," + qs.ENCODE_SQL + "SELECT seq, ids FROM encoded")
def cache_features(spark, sf):
    """Features cached for older texts, then for today's: those are built anew, and
    taken from the cache the next time (that build would fail)."""
    path = _scratch(spark, "features")
    base, vocab = materialize(qs.dialog_rows(spark, sf)), materialize(qs.dialog_vocab(spark, sf))
    older = base.withColumn("response", F.upper("response"))

    def features(rows):
        return lambda: sq.encode(rows, vocab, sq.turns()).select("seq", qs._joined_ids(F.col("ids")).alias("ids"))

    def fails():
        raise AssertionError("equal input was built again")

    sq.cache_features(features(older), path, {"rows": older, "vocab": vocab}, {"k": qs.K}, overwrite=False)
    sq.cache_features(features(base), path, {"rows": base, "vocab": vocab}, {"k": qs.K}, overwrite=False)
    return sq.cache_features(fails, path, {"rows": base.repartition(3), "vocab": vocab}, {"k": qs.K}, overwrite=False)


@register("narrow_batches", qs._BASE + "," + qs.VOCAB_SQL + "," + qs.ENCODE_SQL + f"""
SELECT seq, batch_id, width FROM padded WHERE width <= {NARROW}""")
def narrow_batches(spark, sf):
    p = sq.drop_wide_batches(sq.pad_batches(qs.batched_rows(spark, sf)), NARROW)
    return p.select("seq", "batch_id", "width")


@register("eval_report", v.with_views("dialog", extra=qe.PAIRS_SQL + "," + qe._rouge_n_sql(1)) + """
SELECT 'rouge1_f = ' || CAST(round(avg(f) * 100, 4) AS VARCHAR) AS line FROM scored""")
def eval_report(spark, sf):
    path = _scratch(spark, "report")
    ev.write_eval_report(qe.rouge_mean(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
