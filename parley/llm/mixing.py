"""Mixing sources to target weights (op 1).

Each source's words, its documents taken in order, are one stream that is cut
into blocks of ``block`` words.  The output is a number of shards of ``slots``
blocks; every shard draws how many of its slots go to each source from a
multinomial over the target shares.  A slot's number within its source is
mapped through that source's pseudorandom permutation, and the block it lands
on is joined by its index.

Draws scatter around the targets, so slots beyond a source's exact number are
handed on to the sources that drew too few (slot by slot, in permuted order):
every source ends with its target to within one block, and no block is used
more often than its target's number of passes (at most ``max_passes``).

Targets: the sources (by code point, null last) weigh 3, 1, 2, repeating (or
``weights``), and share ``share`` times all words; a target stops at
``max_passes`` times its source's size, the excess is shared again by weight.

Defined results for odd input
- null or empty text: size 0, taken 0
- null source: a source of its own, last in order
- null id: such documents are dealt by row; repeated ids or rows are separate
  documents (told apart by a row number, fixed in the size table)
- empty table, or no word at all: targets 0, nothing taken
- extra columns: ``document_counts`` returns its own columns only; ``remix``
  keeps those of its input
- ties in order (equal ids): broken by size, then by the row number
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.scratch import keep
from parley.operators.windows import counted_broadcast, running_totals

BLOCK = 64                  # words in a block
SLOTS = 4096                # blocks in an output shard
SHARE = 1.5
MAX_PASSES = 2
WEIGHTS = (3, 1, 2)
SEED = 17
CHUNK = 4_000               # documents in a range whose word offsets are summed on their own
TASK_SHARDS = 16            # output shards whose slots one task makes
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row_no, doc_id, source, size), written once; row_no tells repeated rows apart."""
    return keep(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"),
                            F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "mix-sizes")


def source_targets(size: DataFrame, share: float = SHARE, max_passes: int = MAX_PASSES,
                   weights: tuple = WEIGHTS) -> list[dict]:
    """One dict per source (there are few: it is the one list the driver holds)."""
    got = size.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    got = sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))
    out = [{"source": r["source"], "no": i, "size": int(r["size"]), "docs": r["docs"],
            "weight": weights[i % len(weights)]} for i, r in enumerate(got)]
    total = share * sum(s["size"] for s in out)
    open_, left = [s for s in out if s["size"]], total
    for s in out:
        s["target"] = 0.0
    while open_:
        unit = left / sum(s["weight"] for s in open_)
        full = [s for s in open_ if unit * s["weight"] > max_passes * s["size"]]
        if not full:
            for s in open_:
                s["target"] = unit * s["weight"]
            break
        for s in full:
            s["target"] = float(max_passes * s["size"])
            left -= s["target"]
        open_ = [s for s in open_ if s not in full]
    return out


def _feistel(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, elementwise: a four-round Feistel
    network on the next even number of bits, repeated while outside the range."""
    bits = np.ceil(np.log2(np.maximum(n, 4))).astype(np.uint64)
    half = (bits + np.uint64(1)) >> np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), bool)
    limit = n.astype(np.uint64)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            f = (right + key[todo] * np.uint64(2 * r + 3)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            left, right = right, (left ^ f) & mask[todo]
        out[todo] = (left << half[todo]) | right
        todo = out >= limit
    return out.astype(np.int64)


def draw_slots(spark, targets: list[dict], *, block: int = BLOCK, slots: int = SLOTS,
               seed: int = SEED) -> DataFrame:
    """(shard, slot, source_no, block_no, pass_no): what every output slot takes."""
    live = [s for s in targets if s["size"] and s["target"]]
    schema = "shard long, slot int, source_no int, block_no long, pass_no int"
    if not live:
        return spark.createDataFrame([], schema)
    no = np.array([s["no"] for s in live])
    blocks = np.array([-(-s["size"] // block) for s in live], np.int64)
    want = np.array([round(s["target"] * b / s["size"]) for s, b in zip(live, blocks.tolist())], np.int64)
    total = int(want.sum())
    if not total:
        return spark.createDataFrame([], schema)
    shards = -(-total // slots)
    share = want / want.sum()
    keys = np.random.default_rng(seed).integers(1, 2**62, size=(len(live), 3), dtype=np.int64).astype(np.uint64)

    def counts_of(shard: int) -> np.ndarray:
        n = min(slots, total - shard * slots)
        return np.random.default_rng([seed, shard]).multinomial(n, share)

    def draw(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            got = [counts_of(s) for s in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, len(live)), pa.int64()),
                 pa.array(np.tile(np.arange(len(live)), len(ids)), pa.int32()),
                 pa.array(np.concatenate(got), pa.int64()),
                 pa.array(np.concatenate([np.cumsum(g) - g for g in got]), pa.int64())],
                names=["shard", "k", "n", "at"])

    drawn = spark.range(shards).mapInArrow(draw, "shard long, k int, n long, at long")
    # a source's slots before each shard: running sums by ranges, less those of the sources before it
    drawn = keep(running_totals(drawn, ["k", "shard"], "n", "first"), "mix-drawn")
    sums = {r["k"]: r["n"] for r in drawn.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    have = np.array([sums.get(k, 0) for k in range(len(live))], np.int64)
    base = np.cumsum(have) - have
    over, under = np.maximum(have - want, 0), np.maximum(want - have, 0)
    over_from = np.cumsum(over) - over              # a handed-on slot's number over all sources
    under_to = np.cumsum(under)

    def expand(batches):
        for b in batches:
            shard, k, n, first, place = (b.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            k = np.repeat(k, n).astype(np.int64)
            here = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            slot = here + np.repeat(place, n)
            q = here + np.repeat(first, n) - base[k]
            r = _feistel(q, have[k], keys[k, 0])
            extra = r >= want[k]
            g = over_from[k] + r - want[k]
            to = np.searchsorted(under_to, np.where(extra, g, 0), side="right")
            to = np.minimum(to, len(live) - 1)
            r = np.where(extra, have[to] + g - (under_to[to] - under[to]), r)
            k = np.where(extra, to, k)
            turn, at = r // blocks[k], r % blocks[k]
            idx = _feistel(at, blocks[k], keys[k, 1] + turn.astype(np.uint64) * keys[k, 2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(shard, n), pa.int64()), pa.array(slot.astype(np.int32), pa.int32()),
                 pa.array(no[k], pa.int32()), pa.array(idx, pa.int64()), pa.array(turn, pa.int32())],
                names=["shard", "slot", "source_no", "block_no", "pass_no"])

    # the drawn counts are a small table, the slots are not: shards are dealt before they are made
    return drawn.select("shard", "k", "n", "first", "at") \
        .repartition(max(1, -(-shards // TASK_SHARDS)), "shard").mapInArrow(expand, schema)


def _source_table(spark, targets: list[dict], columns: str, schema: str) -> DataFrame:
    rows = [tuple(s[c] for c in columns.split()) for s in targets]
    return F.broadcast(spark.createDataFrame(rows, schema))      # one row per source


def offsets(size: DataFrame, targets: list[dict], chunk: int = CHUNK) -> DataFrame:
    """``size`` with source_no and ``start``, the document's first word in its
    source's stream.  The stream's order is (range, id): a source has a range,
    a hash bucket of the id, for about every ``chunk`` documents (a null id is
    dealt by its row).  Each range is summed on its own and starts where
    the ranges before it end, so a hot source is not one task."""
    spark = size.sparkSession
    info, base = [], 0
    for s in targets:
        info.append((s["source"], s["no"], max(1, -(-s["docs"] // chunk)), base))
        base += s["size"]
    no = F.broadcast(spark.createDataFrame(info, "_s string, source_no int, ranges int, source_base long"))   # a row per source
    dealt = F.when(F.col("doc_id").isNull(), F.xxhash64("row_no")).otherwise(F.xxhash64("doc_id"))
    t = size.join(no, size["source"].eqNullSafe(no["_s"])).drop("_s") \
        .withColumn("range", F.pmod(dealt, F.col("ranges"))).drop("ranges")
    per = t.groupBy("source_no", "range", "source_base").agg(F.sum("size").alias("n"))
    per = keep(running_totals(per, ["source_no", "range"], "n", "base")
               .select("source_no", "range", (F.col("base") - F.col("source_base")).alias("base")), "mix-ranges")
    inner = Window.partitionBy("source_no", "range").orderBy("doc_id", "size", "row_no") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return t.drop("source_base").withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))) \
        .join(per, ["source_no", "range"]) \
        .withColumn("start", F.col("base") + F.col("inner")).drop("range", "base", "inner")


def segments(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, block_no, row_no, first, n): the words of a document in a block,
    ``first`` counted within the document."""
    b = F.lit(block)
    at = F.col("block_no") * b
    return placed.where("size > 0").withColumn("block_no", F.explode(F.sequence(
        F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))) \
        .select("source_no", "block_no", "row_no",
                F.greatest(F.lit(0), at - F.col("start")).alias("first"),
                (F.least(F.col("start") + F.col("size"), at + b) - F.greatest(F.col("start"), at)).alias("n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *,
        weights: tuple = WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES,
        block: int = BLOCK, slots: int = SLOTS, seed: int = SEED,
        size: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(sizes, plan, targets).  The plan has a row per output slot and document
    part: shard, slot, pass_no, row_no, first (word in the document), n (words).
    ``size`` is the size table if it is written already."""
    size = sizes(docs, id_col, text, source) if size is None else size
    targets = source_targets(size, share, max_passes, weights)
    drawn = draw_slots(docs.sparkSession, targets, block=block, slots=slots, seed=seed)
    parts = segments(offsets(size, targets), block)
    # the slots are made in Python, so their number is not known to the planner: never broadcast them
    plan = drawn.hint("merge").join(parts, ["source_no", "block_no"])
    return size, plan, targets


def document_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                    **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document."""
    size, plan, targets = mix(docs, id_col, text, source, **options)
    spark = docs.sparkSession
    taken = plan.groupBy("row_no").agg(F.sum("n").alias("taken"))
    info = _source_table(spark, targets, "source size target", "_s string, source_size long, target double")
    out = size.join(taken, "row_no", "left")
    return out.join(info, out["source"].eqNullSafe(info["_s"])).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def numbered(docs: DataFrame) -> DataFrame:
    """(row_no, _row): the rows with numbers that are the same in every pass.  Rows read
    from Parquet files have their place in them; others are written with a number.

    The row travels as one value, so its columns cannot clash with the plan's.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    try:
        at = docs.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"), row)
    except AnalysisException:
        at = None
    if at is not None:
        n = F.col("_n").cast("decimal(38,0)")
        files = keep(at.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_at").cast("decimal(38,0)")).alias("_s"),
                                             F.max("_at").alias("_top")), "mix-files")
        # whole files, every row once: else a row's place does not tell it from others
        if files.where((F.col("_top") != F.col("_n") - 1) | (F.col("_s") * 2 != n * (n - 1))).isEmpty():
            first = keep(running_totals(files, ["_file"], "_n", "_first").select("_file", "_first"), "mix-files")
            return at.join(counted_broadcast(first), "_file").select((F.col("_first") + F.col("_at")).alias("row_no"), "_row")
    return keep(docs.select(F.monotonically_increasing_id().alias("row_no"), row), "mix-rows")


def remix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
          n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mixture as documents: each document once per pass that takes of it,
    its text cut to the words taken (whole, byte for byte, where all are).

    The size table and the texts go by the same row numbers (``numbered``).
    """
    rows = numbered(docs)
    row = F.col("_row")
    size = keep(rows.select("row_no", row[id_col].alias("doc_id"), row[source].alias("source"),
                            n_words(row[text]).alias("size")), "mix-sizes")
    size, plan, _ = mix(docs, id_col, text, source, size=size, **options)
    part = F.struct("first", "n")
    per = plan.groupBy("row_no", "pass_no").agg(F.sum("n").alias("_n"), F.sort_array(F.collect_list(part)).alias("_p"))
    per = per.join(size.select("row_no", "size"), "row_no") \
        .select("row_no", "pass_no", F.when(F.col("_n") < F.col("size"), F.col("_p")).alias("_p"))
    word = F.regexp_extract_all(F.col("_text"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("_p", lambda p: F.slice(word, (p["first"] + 1).cast("int"),
                                                                     p["n"].cast("int")))), " ")
    out = rows.withColumn("_text", row[text]).join(per, "row_no").withColumn("_new", F.when(F.col("_p").isNull(), F.col("_text")).otherwise(cut))
    new = {text: F.col("_new")}
    if n_chars and n_chars in docs.columns:
        new[n_chars] = F.length("_new").cast("long")
    return out.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])
