"""CSV files with line breaks inside quotes, read by many tasks.

A split of a file cannot tell whether it begins inside a quoted field.  So each
line is scanned for both cases: a line maps the state before it (at a record's
start, or inside quotes) to the state after it.  These maps are combined along
the lines of every split, then along the splits of every file, which gives
every line its true state and every record its number in the file.  Lines are
put together to records, and records are parsed with ``from_csv``.

The lines are stored once with (file, split, line in the split), and everything
after that goes by these, so a row's number depends on the bytes of the files
alone: not on how they are cut, packed or dealt, now or when a task runs again.

Format: UTF-8, comma, ``"`` quotes doubled inside quoted fields, lines that end in
``\\n`` or ``\\r\\n``, a header in every file, blank lines between records skipped.
A quote inside an unquoted field is an ordinary character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.windows import counted_broadcast, running_totals
from parley.session import materialize

OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# states of a scan within a line
_START, _PLAIN, _QUOTED, _CLOSED = 0, 1, 2, 3


def ends_open(line: Column, inside: bool) -> Column:
    """Whether the line ends inside quotes, if it begins inside quotes (or not)."""
    def quote(state: Column, piece: Column) -> Column:
        """The state after ``piece`` and the quote that follows it."""
        field = piece.endswith(",") | ((piece == "") & (state == _START))
        return F.when(state == _QUOTED, F.lit(_CLOSED)) \
            .when((state == _CLOSED) & (piece == ""), F.lit(_QUOTED)) \
            .otherwise(F.when(field, F.lit(_QUOTED)).otherwise(F.lit(_PLAIN)))

    pieces = F.split(line, '"', -1)
    first = F.lit(_QUOTED if inside else _START)
    end = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), first, quote)
    return F.when(F.instr(line, '"') == 0, F.lit(inside)).otherwise(end == _QUOTED)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _split, _row, value, _from_start, _from_quoted), stored: the lines of all
    files and the two states each can end in (true: inside quotes)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return materialize(lines.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"), "value",
        ends_open(F.col("value"), False).alias("_from_start"), ends_open(F.col("value"), True).alias("_from_quoted")))


def _before(x: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds the state before each step of a sequence of state maps, for a sequence
    that begins outside (``_b0``) and inside quotes (``_b1``).

    A map is constant, keeps the state or flips it; so the state is that of the
    last constant map, or else the first state, flipped as often as after it.
    """
    w = Window.partitionBy(*by).orderBy(order)
    up_to, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    const = F.col("_from_start") == F.col("_from_quoted")
    flips = F.col("_from_start") & ~F.col("_from_quoted")
    x = x.withColumn("_f", F.sum(flips.cast("int")).over(up_to))
    last = F.last(F.when(const, F.struct(F.col("_from_start").alias("s"), F.col("_f").alias("f"))), True).over(past)
    x = x.withColumn("_last", last).withColumn("_fb", F.col("_f") - flips.cast("int"))

    def state(first: bool) -> Column:
        odd = lambda n: (n % 2) == 1
        return F.when(F.col("_last").isNotNull(), F.col("_last.s") != odd(F.col("_fb") - F.col("_last.f"))) \
            .otherwise(F.lit(first) != odd(F.col("_fb")))
    return x.withColumn("_b0", state(False)).withColumn("_b1", state(True)).drop("_f", "_fb", "_last")


def _after(before: Column) -> Column:
    return F.when(before, F.col("_from_quoted")).otherwise(F.col("_from_start"))


def records(lines: DataFrame) -> DataFrame:
    """(_pos, value): every record but the headers, numbered through all files
    (in path order) from 0."""
    blank = F.col("value").isin("", "\r")
    scanned = _before(lines.withColumn("_blank", blank).drop("value"), ["_file", "_split"], "_row")
    starts = lambda before: (~F.col(before) & ~F.col("_blank")).cast("long")
    # one row per split: its own map, and the records that begin in it in either case
    chunks = scanned.groupBy("_file", "_split").agg(
        F.max_by(_after(F.col("_b0")), "_row").alias("_from_start"),
        F.max_by(_after(F.col("_b1")), "_row").alias("_from_quoted"),
        F.sum(starts("_b0")).alias("_n0"), F.sum(starts("_b1")).alias("_n1"))
    n = F.when(F.col("_b0"), F.col("_n1")).otherwise(F.col("_n0"))
    chunks = materialize(_before(chunks, ["_file"], "_split").withColumn("_n", n).withColumnRenamed("_b0", "_open")
                         .select("_file", "_split", "_open", "_n"))
    so_far = F.sum("_n").over(Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    files = running_totals(chunks.groupBy("_file").agg(F.greatest(F.sum("_n") - 1, F.lit(0)).alias("_n")),
                           ["_file"], "_n", "_off")
    chunks = counted_broadcast(materialize(
        chunks.withColumn("_first", F.coalesce(so_far, F.lit(0))).join(files.select("_file", "_off"), "_file")
        .select("_file", "_split", "_open", "_first", "_off")))

    x = _before(lines.withColumn("_blank", blank), ["_file", "_split"], "_row") \
        .join(chunks, ["_file", "_split"]) \
        .withColumn("_in", F.when(F.col("_open"), F.col("_b1")).otherwise(F.col("_b0")))
    begins = ~F.col("_in") & ~F.col("_blank")
    w = Window.partitionBy("_file", "_split").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    rec = F.col("_first") + F.sum(begins.cast("long")).over(w) - 1
    x = x.withColumn("_rec", rec).withColumn("_begins", begins).withColumn("_goes_on", _after(F.col("_in"))) \
        .where((F.col("_in") | ~F.col("_blank")) & (F.col("_rec") > 0))
    pos = (F.col("_off") + F.col("_rec") - 1).alias("_pos")
    # most records are one line; the lines of the others meet by record number
    one = x.where(F.col("_begins") & ~F.col("_goes_on")).select(pos, "value")
    many = x.where(~F.col("_begins") | F.col("_goes_on")).select(pos, "_split", "_row", "value").groupBy("_pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_split", "_row", "value"))),
                                 lambda s: s["value"]), "\n").alias("value"))
    return one.unionByName(many).withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, and ``_pos``: the row's place, files in path order."""
    header = spark.read.options(header=True, inferSchema=False, multiLine=True, **OPTIONS).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in schema.names)
    parsed = F.from_csv(F.col("value"), F.lit(ddl), {**OPTIONS, "multiLine": "true"})
    return records(scan_lines(spark, path)).select("_pos", parsed.alias("_r")).select("_pos", "_r.*")
