"""Training sequences and batches F1..F8.

Vocabulary and encoding are re-aimed from a pretrained BPE to a
corpus-built word vocabulary: every whitespace token, ranked by count, ties
by token.  Ids: 0 = end-of-sequence (also the pad value), 1 = not in the
vocabulary at hand, 2.. = tokens by rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.operators.windows import dense_index, dense_index_total
from parley.session import materialize
from parley.sources.commit import missing, replace_folder, settle

# fixed values
EOS_ID = 0
OOV_ID = 1
FIRST_TOKEN_ID = 2
PAD_ID = 0
BATCH_SIZE = 4
MAX_WIDTH = 1024
HEAD_TOKENS = 200_000    # tokens of the vocabulary that are broadcast
HEAD_CHARS = 64          # their length at most
TAIL = -1                # a token outside them, until it is looked up

_EOS_SPLIT = r"\Q" + tx.EOS + r"\E"


def turns(ctx: str = "ctx", response: str = "response") -> Column:
    """Messages of a row oldest first: contextK .. context1, response."""
    return F.concat(F.reverse(F.col(ctx)), F.array(F.col(response)))


def training_text(ctx: str = "ctx", response: str = "response", eos: str = tx.EOS) -> Column:
    """every message followed by the end-of-sequence marker."""
    return F.concat(F.array_join(turns(ctx, response), eos), F.lit(eos))


def prompt_text(ctx: str = "ctx", response: str = "response", eos: str = tx.EOS) -> Column:
    """F1 cut before its last message (the pieces after the last two
    markers are dropped), then re-terminated."""
    pieces = F.split(training_text(ctx, response, eos), _EOS_SPLIT, -1)
    keep = F.slice(pieces, 1, F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.concat(F.array_join(keep, eos), F.lit(eos))


def build_vocab(texts: DataFrame, col: str = "content") -> DataFrame:
    """``(token, cnt, id)`` of every whitespace token, most frequent
    first (ties by token).  Counting is a partial-aggregated group-by; ranking
    is by ranges (``dense_index``), so no task sees the whole vocabulary."""
    counts = texts.select(F.explode(tx.word_tokens(F.col(col))).alias("token")) \
                  .groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = dense_index(counts.withColumn("_neg", -F.col("cnt")), ["_neg", "token"], "_pos")
    return ranked.select("token", F.col("cnt").cast("long").alias("cnt"),
                         (F.col("_pos") + FIRST_TOKEN_ID).cast("int").alias("id"))


def _head_lookup(head: list) -> Callable[[Column], Column]:
    """Ids of token arrays by a broadcast of the most frequent tokens; a null token
    is the end of a message, a token not among them becomes ``TAIL``."""
    from pyspark.sql import SparkSession
    known = SparkSession.active().sparkContext.broadcast(
        (pa.array([r[0] for r in head], pa.string()), np.array([r[1] for r in head], np.int32)))

    @F.arrow_udf("array<int>")
    def lookup(col: pa.Array) -> pa.Array:
        tokens, ids = known.value
        flat = col.flatten()
        at = pc.index_in(flat, value_set=tokens, skip_nulls=True).fill_null(len(ids)).to_numpy(zero_copy_only=False)
        found = np.append(ids, np.int32(TAIL))[at]
        found[flat.is_null().to_numpy(zero_copy_only=False)] = EOS_ID
        sizes = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(found))
    return lookup


def encode(df: DataFrame, vocab: DataFrame, messages: Column, out: str = "ids",
           head_tokens: int = HEAD_TOKENS) -> DataFrame:
    """Token ids of ``messages`` (array of texts, in order), each
    message's tokens followed by the end-of-sequence id.

    The ``head_tokens`` most frequent tokens (of at most ``HEAD_CHARS`` characters)
    are broadcast and looked up where the row is, so nothing is moved for them.
    Other tokens of the vocabulary are its tail: only tokens outside the head are
    then exploded, joined to it and put back by a row number fixed when the rows
    are stored.
    """
    # one entry per token; a null token stands for the end of a message (no end for a null list)
    tokens = F.flatten(F.transform("_msgs", lambda m: F.concat(
        F.coalesce(tx.word_tokens(m), F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))))
    words = vocab.select("token", "id")
    frequent = (F.col("id") < FIRST_TOKEN_ID + head_tokens) & (F.length("token") <= HEAD_CHARS)
    head = words.where(frequent).collect()               # at most head_tokens rows of bounded length
    tail = words.where(~frequent)
    x = df.withColumn("_msgs", messages).withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>"))) \
        .drop("_msgs").withColumn("_ids", _head_lookup(head)(F.col("_tokens")))
    final = F.transform("_ids", lambda i: F.when(i == TAIL, F.lit(OOV_ID)).otherwise(i))
    if tail.isEmpty():
        return x.withColumn(out, final).drop("_tokens", "_ids")
    rows = materialize(x.withColumn("_row", F.monotonically_increasing_id()))
    open_at = F.filter(F.sequence(F.lit(0), F.size("_ids") - 1), lambda i: F.get("_ids", i) == TAIL)
    open_at = F.when(F.size("_ids") > 0, open_at).otherwise(F.array().cast("array<int>"))
    asked = rows.select("_row", "_tokens", F.explode(open_at).alias("_i")) \
        .select("_row", "_i", F.get("_tokens", F.col("_i")).alias("token"))
    found = asked.join(tail, "token", "left").groupBy("_row").agg(
        F.collect_list(F.struct("_i", F.coalesce("id", F.lit(OOV_ID)).alias("id"))).alias("_found"))
    placed = F.filter(F.transform("_ids", lambda i, n: F.struct(n.alias("_i"), i.alias("id"))), lambda s: s["id"] != TAIL)
    whole = F.transform(F.array_sort(F.concat(placed, F.col("_found"))), lambda s: s["id"])
    return rows.join(found, "_row", "left") \
        .withColumn(out, F.when(F.col("_found").isNull(), F.col("_ids")).otherwise(whole)) \
        .drop("_row", "_tokens", "_ids", "_found")


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows that does not depend on their order:
    row count and two sums of row hashes (repeated rows count)."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        # a hash skips nulls, so each cell says whether it is one; nested values are hashed as written out
        cells += [c.isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c]
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *cells).cast("decimal(38,0)")).cast("string")
    r = df.agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()


def cache_features(build: Callable[[], DataFrame], path: str, inputs: Mapping[str, DataFrame],
                   params: Mapping[str, object] | None = None, overwrite: bool = True) -> DataFrame:
    """the table that ``build`` makes of ``inputs`` and ``params``, stored at ``path``.

    A manifest beside the rows names what they were made of: a fingerprint of
    every input (texts, vocabulary, ..) and the parameters.  Without ``overwrite``
    the stored rows are taken if the manifest says the same of today's inputs;
    anything else, a missing manifest included, builds and replaces them.
    """
    sources = {k: fingerprint(v) for k, v in sorted(inputs.items())}
    made_of = json.dumps({"inputs": sources, "params": dict(params or {})}, sort_keys=True, default=str)
    spark = next(iter(inputs.values())).sparkSession
    settle(spark, path)
    rows, manifest = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/manifest"
    if not overwrite and not missing(spark, manifest):
        if [r[0] for r in spark.read.text(manifest).collect()] == [made_of]:       # one line
            return spark.read.parquet(rows)

    def write(folder: str) -> None:
        build().write.parquet(f"{folder}/rows")
        spark.createDataFrame([(made_of,)], "value string").coalesce(1).write.text(f"{folder}/manifest")

    replace_folder(spark, path, write)
    return spark.read.parquet(rows)


def assign_batches(df: DataFrame, size: int = BATCH_SIZE, seed: int | None = None,
                   id_col: str = "seq", drop_last: bool = True,
                   order: list[str] | None = None) -> DataFrame:
    """``batch_id`` and ``slot``.  With a seed the order is the seeded
    permutation (training sampler), otherwise ``order``/``id_col``
    (sequential evaluation).  The incomplete last batch is dropped."""
    if seed is not None:
        x = df.withColumn("_bkey", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
        x, total = dense_index_total(x, ["_bkey", id_col], "_bpos")
        x = x.drop("_bkey")
    else:
        x, total = dense_index_total(df, order or [id_col], "_bpos")
    keep = (total // size) * size if drop_last else total
    return x.where(F.col("_bpos") < keep) \
            .withColumn("batch_id", F.floor(F.col("_bpos") / size).cast("long")) \
            .withColumn("slot", (F.col("_bpos") % size).cast("int")).drop("_bpos")


def pad_batches(df: DataFrame, ids: str = "ids", pad_id: int = PAD_ID) -> DataFrame:
    """right-pad every row to the longest row of its batch; labels
    are the inputs.  Adds ``width``."""
    w = Window.partitionBy("batch_id")
    width = F.max(F.size(F.col(ids))).over(w)
    return df.withColumn("width", width.cast("int")) \
             .withColumn("input_ids", F.concat(F.col(ids), F.array_repeat(
                 F.lit(pad_id), F.col("width") - F.size(F.col(ids))))) \
             .withColumn("labels", F.col("input_ids"))


def drop_wide_batches(df: DataFrame, limit: int = MAX_WIDTH) -> DataFrame:
    """skip whole batches wider than ``limit``."""
    return df.where(F.col("width") <= limit)


def step_plan(batches: DataFrame, accum: int = 1, epochs: int = 1, max_steps: int = -1) -> DataFrame:
    """F8: optimisation steps and epochs from the number of batches."""
    n = F.countDistinct("batch_id")
    per_epoch = F.floor(n / accum)
    if max_steps > 0:
        steps = F.lit(max_steps).cast("long")
        eps = (F.floor(F.lit(max_steps) / F.when(per_epoch > 0, per_epoch)) + 1).cast("long")
    else:
        steps = (per_epoch * epochs).cast("long")
        eps = F.lit(epochs).cast("long")
    return batches.agg(n.cast("long").alias("batches"), steps.alias("steps"), eps.alias("epochs"))

