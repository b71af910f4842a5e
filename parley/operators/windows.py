"""Order-based operators that must not collapse into one partition.

``preceding`` gives every row the k rows before it inside a scope (a
channel, a session, a conversation).  A scope may hold a third of all
rows, so a plain ``Window.partitionBy(scope)`` would put that third into
one task.  Scopes larger than ``block_rows`` are therefore cut into
blocks by global ranges of the full order key; each block is
windowed independently, and only the first k rows of each block are
repaired with the tails of the previous blocks (a table with one row per
block).  The data is windowed once; a second, narrow window over the hot
rows only (order key and value) yields the block tails.

``dense_index`` numbers rows 0..n-1 in a total order without a global
single-partition window: ranges of the order, one count per range, offsets
broadcast back, ``row_number`` inside each range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import materialize, parallelism

# A table is broadcast only when its row count is known to be below this.
BROADCAST_ROWS = 2_000_000
MIN_BLOCK_ROWS = 50_000
MAX_BLOCK_ROWS = 5_000_000


def auto_block_rows(spark, total: int) -> int:
    """Rows per block: about four blocks per core, never tiny, and never more
    than one task should sort (``MAX_BLOCK_ROWS``) however large the input."""
    return min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, math.ceil(total / (4 * parallelism(spark)))))


def counted_broadcast(small: DataFrame) -> DataFrame:
    """A table to join with: broadcast where its counted rows allow it."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _in_ranges(df: DataFrame, order: Sequence[str], n_ranges: int) -> DataFrame:
    """``df`` cut into ranges of the full order key and stored with its range
    number ``_rng``.  Ties of the first columns are split by the later ones,
    nulls are the first range's, any orderable type will do."""
    return materialize(df.repartitionByRange(n_ranges, *[F.col(c) for c in order])
                       .withColumn("_rng", F.spark_partition_id().cast("long")))


def preceding(df: DataFrame, k: int, by: Sequence[str] = (), order: str | Sequence[str] = "seq",
              value: str = "content", out: str = "ctx",
              block_rows: int | None = None) -> DataFrame:
    """Add ``out`` = up to ``k`` previous ``value``s in the scope ``by``
    ordered by ``order`` (nearest first; null values keep their place) and
    ``n_before`` = min(k, number of earlier rows in the scope).

    ``order`` (one column or several) must be unique within a scope.
    """
    order = [order] if isinstance(order, str) else list(order)
    if k < 0:
        raise ValueError("k must be >= 0")
    spark = df.sparkSession
    cols = df.columns
    by = list(by)
    scope = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    x = df.withColumn("_scope", scope)

    def lags(w):
        return [F.lag(F.col(value), i).over(w) for i in range(1, k + 1)]

    # one row per scope, kept for the hot list below (released before return)
    counts = x.groupBy("_scope").agg(F.count(F.lit(1)).alias("_cnt")).persist()
    total, biggest = counts.agg(F.sum("_cnt"), F.max("_cnt")).first()
    total = total or 0
    block_rows = block_rows or auto_block_rows(spark, total)

    if k == 0:
        counts.unpersist()
        return df.withColumn(out, F.array().cast(T.ArrayType(df.schema[value].dataType))) \
                 .withColumn("n_before", F.lit(0))

    if not biggest or biggest <= block_rows:
        counts.unpersist()
        w = Window.partitionBy("_scope").orderBy(*order)
        nb = F.least(F.row_number().over(w) - 1, F.lit(k))
        return x.select(*cols, F.slice(F.array(*lags(w)), 1, nb).alias(out),
                        nb.cast("int").alias("n_before"))

    # --- split path: hot scopes are cut into global quantile ranges --------
    # the input is read several times below (hot list, blocks, tails, heads):
    # it is stored once, already cut into ranges of the full order key
    x = _in_ranges(x, order, max(2, math.ceil(total / block_rows)))
    # at most total / block_rows scopes can exceed block_rows: a proven bound
    hot_rows = counts.where(F.col("_cnt") > block_rows).select("_scope").collect()
    counts.unpersist()
    hot_schema = T.StructType([T.StructField("_scope", x.schema["_scope"].dataType, False),
                               T.StructField("_hot", T.BooleanType(), False)])
    hot = spark.createDataFrame([(r[0], True) for r in hot_rows], hot_schema)
    if len(hot_rows) <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    x = x.join(hot, "_scope", "left")
    x = x.withColumn("_hot", F.coalesce(F.col("_hot"), F.lit(False))) \
         .withColumn("_blk", F.when(F.col("_hot"), F.col("_rng")).otherwise(F.lit(-1)))

    w = Window.partitionBy("_scope", "_blk").orderBy(*order)
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    vtype = T.ArrayType(df.schema[value].dataType)

    # pass A, hot rows only and only (scope, block, order, value): the last
    # k values of every block, nearest first, read off the block's last row
    hx = x.where(F.col("_hot")).select("_scope", "_blk", *order, value)
    ends = hx.select("_scope", "_blk",
                     F.row_number().over(w).alias("_rn"),
                     F.count(F.lit(1)).over(wall).alias("_cnt"),
                     F.array(F.col(value), *lags(w)[: k - 1]).alias("_lastk")) \
             .where(F.col("_rn") == F.col("_cnt")) \
             .select("_scope", "_blk", F.slice("_lastk", 1, F.least(F.col("_cnt"), F.lit(k))).alias("_tail"))
    # the k values before each block: tails of up to k earlier blocks (each
    # non-empty block gives at least one), nearest first.  #blocks rows.
    pw = Window.partitionBy("_scope").orderBy("_blk").rowsBetween(-k, -1)
    prefix = ends.select("_scope", "_blk", F.slice(F.flatten(F.reverse(F.collect_list("_tail").over(pw))),
                                                   1, k).alias("_prev"))

    # pass B, all rows: the window, then the repair of each block's first k
    # rows.  The join keys are the window's partition keys, so only the small
    # prefix table moves.
    base = x.select(*cols, "_scope", "_hot", "_blk",
                    F.row_number().over(w).alias("_rn"), F.array(*lags(w)).alias("_lags"))
    base = base.join(prefix, ["_scope", "_blk"], "left")
    within = F.slice(F.col("_lags"), 1, F.least(F.col("_rn") - 1, F.lit(k)))
    prev = F.coalesce(F.col("_prev"), F.array().cast(vtype))
    head = F.col("_hot") & (F.col("_rn") <= k)
    n_head = F.least(F.lit(k), F.col("_rn") - 1 + F.size(prev))
    n_rest = F.least(F.col("_rn") - 1, F.lit(k))
    return base.select(*cols,
                       F.when(head, F.slice(F.concat(within, prev), 1, n_head)).otherwise(within).alias(out),
                       F.when(head, n_head).otherwise(n_rest).cast("int").alias("n_before"))


def dense_index(df: DataFrame, order: Sequence[str], out: str = "pos",
                block_rows: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in the total order
    ``order`` (nulls first; must be unique)."""
    return dense_index_total(df, order, out, block_rows)[0]


def dense_index_total(df: DataFrame, order: Sequence[str], out: str = "pos",
                      block_rows: int | None = None) -> tuple[DataFrame, int]:
    """``dense_index`` plus the row count it found on the way."""
    spark = df.sparkSession
    order = list(order)
    # the input feeds the count, the ranges and the window: compute it once
    stored = materialize(df)
    total = stored.count()
    block_rows = block_rows or auto_block_rows(spark, total)
    x = _in_ranges(stored, order, max(1, math.ceil(total / block_rows)))
    counts = sorted((int(r[0]), int(r[1])) for r in
                    x.groupBy("_rng").count().collect())  # <= n_ranges rows
    offsets, acc = [], 0
    for rng, cnt in counts:
        offsets.append((rng, acc))
        acc += cnt
    off_df = spark.createDataFrame(offsets, "_rng long, _off long")
    x = x.join(F.broadcast(off_df), "_rng")
    w = Window.partitionBy("_rng").orderBy(*order)
    return x.withColumn(out, (F.col("_off") + F.row_number().over(w) - 1).cast("long")) \
            .drop("_rng", "_off"), total


def running_totals(df: DataFrame, order: Sequence[str], value: str, out: str,
                   block_rows: int | None = None) -> DataFrame:
    """Add ``out`` = the sum of ``value`` over all rows before each one in the
    total order ``order`` (unique): ranges of the order, one sum per range,
    their offsets broadcast, a window inside each range."""
    spark = df.sparkSession
    stored = materialize(df)
    total = stored.count()
    x = _in_ranges(stored, order, max(1, math.ceil(total / (block_rows or auto_block_rows(spark, total)))))
    sums = sorted((int(r[0]), r[1]) for r in x.groupBy("_rng").agg(F.sum(value)).collect())  # <= n_ranges rows
    offsets, acc = [], 0
    for rng, n in sums:
        offsets.append((rng, acc))
        acc += n or 0
    x = x.join(F.broadcast(spark.createDataFrame(offsets, "_rng long, _acc long")), "_rng")
    past = Window.partitionBy("_rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn(out, F.col("_acc") + F.coalesce(F.sum(value).over(past), F.lit(0))).drop("_rng", "_acc")
