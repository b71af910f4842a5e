"""Sources and sinks S1..S8.

Row order in a chat export is data, so every reader assigns ``seq``:
ascending = oldest first.  CSV exports are read by many tasks even where
messages hold line breaks (``csv_scan``).

Writers replace a table, or the sessions they hold rows of, as a whole: a failed
write leaves what was there (``commit``), and other sessions stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import schemas
from parley.operators.windows import counted_broadcast, dense_index, running_totals
from parley.sources.commit import missing, replace_folder, settle
from parley.sources.csv_scan import read_csv

CUSTOM_GUILD = "CUSTOM"


class ChannelError(ValueError):
    """A requested channel is missing from the export."""


def with_file_order(df: DataFrame, newest_first: bool = True, out: str = "seq") -> DataFrame:
    """``seq`` from file order for inputs whose ``_metadata`` has a row index
    (Parquet): files in path order, rows in file order; no row is moved.  With
    ``newest_first`` the numbering is reversed (ascending = oldest)."""
    x = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.row_index"))
    files = running_totals(x.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")), ["_file"], "_n", "_off")
    pos = F.col("_at") + F.col("_off")
    x = x.join(counted_broadcast(files.select("_file", "_off")), "_file")
    return x.withColumn(out, (-pos if newest_first else pos).cast("long")).drop("_file", "_at", "_off")


def read_messages(spark: SparkSession, path: str, author_col: str = "author_id",
                  content_col: str = "content", newest_first: bool = True,
                  extra: Sequence[str] = ("timestamp", "channel"), na_values: Sequence[str] = ()) -> DataFrame:
    """S1 (+T1): a CSV export -> ``seq, author_id, content`` (+ ``ts``,
    ``channel`` when present); embedded newlines and doubled quotes survive.
    ``na_values``: texts read as null in any column (none by default)."""
    raw = read_csv(spark, path)
    for c in raw.columns[1:] if na_values else []:
        raw = raw.withColumn(c, F.when(~F.col(f"`{c}`").isin(list(na_values)), F.col(f"`{c}`")))
    cols = [F.col(f"`{author_col}`").cast("string").alias("author_id"),
            F.col(f"`{content_col}`").cast("string").alias("content")]
    if "timestamp" in extra and "timestamp" in raw.columns:
        cols.append(F.to_timestamp("timestamp").alias("ts"))
    if "channel" in extra and "channel" in raw.columns:
        cols.append(F.col("channel").cast("string").alias("channel"))
    return raw.select((-F.col("_pos") if newest_first else F.col("_pos")).alias("seq"), *cols)


def read_members(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``id, name, pos``; a missing path gives an empty roster."""
    if not path or missing(spark, path):
        return spark.createDataFrame([], schemas.MEMBERS)
    return read_csv(spark, path).select(F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name"),
                                        F.col("_pos").alias("pos"))


def ingest_channels(spark: SparkSession, path: str, channels: Sequence[str] = (),
                    fmt: str = "json", newest_first: bool = False) -> DataFrame:
    """S3: exported channel histories -> ``seq, author_id, content, ts, channel``.
    ``seq`` follows time, ties file order (reversed if ``newest_first``).
    An empty list keeps every channel; an unknown channel is an error."""
    raw = spark.read.format(fmt).load(path)
    # file order: the file, the split within it, and the row within the split
    sign = F.lit(-1 if newest_first else 1)
    df = raw.select(F.col("_metadata.file_path").alias("_file"),
                    (sign * F.col("_metadata.file_block_start")).alias("_split"),
                    (sign * F.monotonically_increasing_id()).alias("_row"),
                    F.col("author_id").cast("string").alias("author_id"),
                    F.col("content").cast("string").alias("content"),
                    F.to_timestamp(F.col("timestamp")).alias("ts"),
                    F.col("channel").cast("string").alias("channel"))
    if channels:
        wanted = list(channels)
        df = df.where(F.col("channel").isin(wanted))
        found = {r[0] for r in df.select("channel").distinct().collect()}  # <= len(wanted) rows
        missing = [c for c in wanted if c not in found]
        if missing:
            raise ChannelError(f"not a text channel of the export: {missing}")
    order = ["ts", "_file", "_split", "_row"]
    return dense_index(df, order, "seq").select("seq", "author_id", "content", "ts", "channel")


def roster_snapshot(members: DataFrame, bot: tuple[str, str] | None = None) -> DataFrame:
    """The roster, optionally with the bot's own row appended last."""
    m = members.select(F.col("id").cast("string").alias("id"), "name",
                       F.col("pos").cast("long").alias("pos"))
    if bot is None:
        return m
    top = m.agg(F.max("pos")).first()[0]
    row = m.sparkSession.createDataFrame([(str(bot[0]), bot[1], (top if top is not None else -1) + 1)],
                                         schemas.MEMBERS)
    return m.unionByName(row)


def read_training(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A train/test table with flat ``context1..K`` -> ``response, ctx``."""
    raw = read_csv(spark, path).drop("_pos") if fmt == "csv" else spark.read.format(fmt).load(path)
    ctx_cols = sorted((c for c in raw.columns if c.startswith("context") and c[7:].isdigit()),
                      key=lambda c: int(c[7:]))
    keep = [c for c in raw.columns if c not in ctx_cols]
    return raw.select(*keep, F.array(*[F.col(c) for c in ctx_cols]).alias("ctx"))


def _writer(df: DataFrame, fmt: str):
    w = df.write.format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("quote", '"').option("escape", '"') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return w


def _flat(df: DataFrame, fmt: str, k: int | None) -> DataFrame:
    """Arrays of context become ``context1..k`` for CSV."""
    if "ctx" not in df.columns or fmt != "csv":
        return df
    width = k if k is not None else df.select(F.max(F.size("ctx"))).first()[0] or 0
    return df.select(*[c for c in df.columns if c != "ctx"],
                     *[F.col("ctx")[i].alias(f"context{i + 1}") for i in range(width)])


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", k: int | None = None,
                  partition_by: Sequence[str] = ()) -> None:
    """Write a table in place of the old one; with ``partition_by`` in place of
    the partitions that ``df`` has rows of: all others stay."""
    out = _flat(df, fmt, k)
    if partition_by:
        # staged by Spark's committer; only partitions written are replaced, when the job has succeeded
        _writer(out, fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(*partition_by).save(path)
    else:
        replace_folder(df.sparkSession, path, lambda folder: _writer(out, fmt).save(folder))


def land(df: DataFrame, path: str) -> DataFrame:
    """Write once to Parquet and continue from the splittable copy."""
    replace_folder(df.sparkSession, path, lambda folder: df.write.parquet(folder))
    return df.sparkSession.read.parquet(path)


def session_layout(root: str, guild: str, session: str) -> str:
    """The folder of one run; custom data uses the guild ``CUSTOM``."""
    return f"{root.rstrip('/')}/guild={guild}/session={session}"


def write_session(df: DataFrame, root: str, guild: str, session: str, fmt: str = "parquet",
                  k: int | None = None) -> None:
    """One run in place of its older rows (also when it has none left)."""
    write_dataset(df, session_layout(root, guild, session), fmt, k)


def read_session(spark: SparkSession, root: str, guild: str, session: str,
                 fmt: str = "parquet") -> DataFrame:
    """Read one run back from a ``partitionBy('guild','session')`` table
    (partition pruning reads only that folder)."""
    settle(spark, session_layout(root, guild, session))
    return spark.read.format(fmt).load(root) \
        .where((F.col("guild") == guild) & (F.col("session") == session))
