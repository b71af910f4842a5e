"""Structured Streaming jobs X1..X4: the batch operators per micro-batch.

Every job runs ``foreachBatch`` with the batch operator of the same name, for
any roster size, and writes each micro-batch to its own ``batch=<id>`` folder
(overwritten when a batch is replayed, so a replay changes nothing).

- X1 ``stream_clean``: C1..C7 with the join-based mention lookup.
- X2 ``stream_triggers``: Q1.
- X3 ``stream_prompts``: Q1 + Q2 + Q4 over the batch and a tail table, the
  k-1 newest cleaned messages of every channel after the batch before; rows
  are ordered by ``seq``.
- X4 ``stream_late_prompts``: the same ordered by event time (ts, then seq), with
  a watermark.  A message that arrives late takes its place for every later
  trigger; one older than the watermark (the newest time of the batches before,
  less ``delay``) is not answered and not kept, but listed as late.  The tail holds
  what a message that is still in time may need: the rows not older than the
  watermark and the k-1 newest older ones of each channel; a channel whose
  newest row is ``idle`` older than the watermark is forgotten.  A null ``ts``
  counts as oldest and is never late.

The tail after batch n, and the newest time seen, are tables of their own next
to the checkpoint, so a restart continues from them; those of batch n - 2 are
removed with batch n.  The tail is joined and windowed like any table, so a
channel with a third of all messages is still cut into blocks, which state kept
by channel in one task would not be.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators.clean import clean_messages
from parley.operators.serve import build_prompt, clean_or_null, latest_context, trigger_filter
from parley.session import ensure_checkpoint_dir, materialize
from parley.sources.commit import remove_folder


def _scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def batch_dir(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id}"


def _each_batch(stream: DataFrame, run, checkpoint: str, trigger: dict | None):
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def stream_clean(stream: DataFrame, members: DataFrame, out_dir: str, checkpoint: str,
                 trigger: dict | None = None):
    """Cleaned messages as Parquet at ``out_dir``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        clean_messages(batch, members).write.mode("overwrite").parquet(batch_dir(out_dir, batch_id))
    return _each_batch(stream, run, checkpoint, trigger)


def stream_triggers(stream: DataFrame, bot_id: str, out_dir: str, checkpoint: str,
                    trigger: dict | None = None):
    """Messages that mention the bot and are not its own (as Q1)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        trigger_filter(batch, bot_id).write.mode("overwrite").parquet(batch_dir(out_dir, batch_id))
    return _each_batch(stream, run, checkpoint, trigger)


def late_dir(out_dir: str) -> str:
    """Where X4 lists the rows that came after the watermark."""
    return out_dir.rstrip("/") + "-late"


def tail_dir(checkpoint: str) -> str:
    return checkpoint.rstrip("/") + "-tail"


def _clock(spark: SparkSession, checkpoint: str, batch_id: int):
    """The newest event time of the batches before, in microseconds (none: no batch had one)."""
    if batch_id == 0:
        return None
    return spark.read.schema("newest long").parquet(
        batch_dir(checkpoint.rstrip("/") + "-clock", batch_id - 1)).first()[0]


def _stream_prompts(stream, members, bot_id, k, out_dir, checkpoint, platform, order, trigger, delay=None, idle=None):
    tails = tail_dir(checkpoint)
    keep = ["channel", "author_id", "content", "clean", *dict.fromkeys([*order, "seq"])]

    def mark(newest):
        """The watermark that ``newest`` sets."""
        return None if newest is None else F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {delay}")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _clock(spark, checkpoint, batch_id) if delay is not None else None
        if (low := mark(before)) is not None:
            late = F.coalesce(F.col("ts") < low, F.lit(False))
            batch = materialize(batch)
            batch.where(late).select("seq", "channel", "ts").write.mode("overwrite") \
                .parquet(batch_dir(late_dir(out_dir), batch_id))
            batch = batch.where(~late)
        new = clean_or_null(batch, members, platform, bot_id).select(*keep, F.lit(True).alias("_new"))
        both = new
        if batch_id > 0:
            old = spark.read.schema(new.drop("_new").schema).parquet(batch_dir(tails, batch_id - 1))
            both = new.unionByName(old.withColumn("_new", F.lit(False)))
        both = materialize(both)
        ctx = latest_context(both, k, ["channel"], order, "clean").where("_new")
        trigger_filter(ctx, bot_id).select("seq", build_prompt(F.col("history")).alias("prompt")) \
            .write.mode("overwrite").parquet(batch_dir(out_dir, batch_id))
        # the k-1 newest per channel: Spark limits each task's rows of a channel before the shuffle
        newest = Window.partitionBy("channel").orderBy(*[F.col(c).desc() for c in order])
        settled, open_rows = both, None
        if delay is not None:
            top = both.agg(F.max(F.unix_micros("ts"))).first()[0]
            top = before if top is None else top if before is None else max(top, before)
            spark.createDataFrame([(top,)], "newest long").write.mode("overwrite") \
                .parquet(batch_dir(checkpoint.rstrip("/") + "-clock", batch_id))
            if (low := mark(top)) is not None:
                if idle is not None:
                    gone = both.groupBy(F.col("channel").alias("_gone")).agg(F.max("ts").alias("_last")) \
                        .where(F.col("_last") < low - F.expr(f"INTERVAL {idle}"))
                    both = both.join(gone, F.col("channel").eqNullSafe(F.col("_gone")), "left_anti")
                in_time = F.coalesce(F.col("ts") >= low, F.lit(False))
                settled, open_rows = both.where(~in_time), both.where(in_time).select(*keep)
        tail = settled.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= max(k - 1, 0)).select(*keep)
        (tail if open_rows is None else tail.unionByName(open_rows)) \
            .write.mode("overwrite").parquet(batch_dir(tails, batch_id))
        if batch_id > 1:                                     # the batch before is the oldest that can run again
            remove_folder(spark, batch_dir(tails, batch_id - 2))

    return _each_batch(stream, run, checkpoint, trigger)


def stream_prompts(stream: DataFrame, members: DataFrame, bot_id: str, k: int, out_dir: str,
                   checkpoint: str, platform: str = "none", trigger: dict | None = None):
    """Prompts in order of ``seq`` as Parquet at ``out_dir``."""
    return _stream_prompts(stream, members, bot_id, k, out_dir, checkpoint, platform, ["seq"], trigger)


def stream_late_prompts(stream: DataFrame, members: DataFrame, bot_id: str, k: int, out_dir: str,
                        checkpoint: str, platform: str = "none", trigger: dict | None = None,
                        delay: str | None = None, idle: str | None = None):
    """Prompts in order of event time as Parquet at ``out_dir``, late rows at
    ``late_dir(out_dir)``.  ``delay`` and ``idle`` are intervals such as ``10 minutes``;
    without ``delay`` nothing is late, and only the k-1 newest rows are kept."""
    x = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return _stream_prompts(x, members, bot_id, k, out_dir, checkpoint, platform, ["ts", "seq"], trigger, delay, idle)


def drain(spark: SparkSession, start_query, name: str) -> DataFrame:
    """Run a stream to the end of its input (availableNow) into a fresh
    folder under the checkpoint dir and read the result back."""
    out, ck = _scratch(spark, f"{name}-out"), _scratch(spark, f"{name}-ck")
    q = start_query(out, ck)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out).drop("batch")
