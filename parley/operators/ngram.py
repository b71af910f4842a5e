"""Model work re-aimed to table operators R1..R4.

Fine-tuning a language model on one person's messages becomes fitting a
per-author n-gram model; evaluation becomes n-gram perplexity; the
sampling rule of generation (temperature, top-k, nucleus) becomes a
ranked candidate table; generation itself is a pluggable per-partition
generator (``mapInPandas``) or the built-in sampler, whose tasks hold the prefixes
visited most and fetch the others by joins.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.operators.windows import BROADCAST_ROWS, counted_broadcast
from parley.session import ensure_checkpoint_dir, materialize, parallelism

BOS = "<s>"
EOS_TOKEN = "</s>"
# fixed values of the original generation call: top-k 100, nucleus 0.7,
# temperature 0.8, at most 200 tokens, no repeated 3-gram
TOP_K = 100
TOP_P = 0.7
TEMPERATURE = 0.8
MAX_LENGTH = 200        # prompt and reply together
NO_REPEAT_NGRAM = 3
BUCKET_TOKENS = 2_000_000   # candidates of the sampler that one task holds, as Arrow columns
HELD_OBJECTS = 200_000      # of these, as Python objects
TASK_PROMPTS = 20_000       # prompts that one task holds, at most
TASK_LEAST = 32             # and at least, where there are so many


def token_stream(c: Column, n: int) -> Column:
    """``n-1`` start markers, the whitespace tokens, one end marker."""
    return F.concat(F.array_repeat(F.lit(BOS), n - 1), tx.word_tokens(c), F.array(F.lit(EOS_TOKEN)))


def grams(df: DataFrame, n: int, by: str = "author_id", col: str = "content",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per position: ``(by, prefix, token)`` (prefix = n-1 tokens)."""
    toks = token_stream(F.col(col), n)
    x = df.select(*keep, by, toks.alias("_t"))
    pos = F.sequence(F.lit(n), F.size("_t"))
    x = x.select(*keep, by, "_t", F.explode(pos).alias("_i"))
    prefix = F.array_join(F.slice("_t", F.col("_i") - n + 1, n - 1), " ")
    return x.select(*keep, by, prefix.alias("prefix"), F.element_at("_t", F.col("_i")).alias("token"))


def fit_ngram_model(corpus: DataFrame, n: int = 2, by: str = "author_id", col: str = "content",
                    add_k: float = 1.0) -> DataFrame:
    """``(by, prefix, token, cnt, p)`` with add-k smoothing over the
    author's vocabulary.  Counting is partial-aggregated; prefix totals
    are a second aggregation joined back (AQE splits a skewed prefix)."""
    g = grams(corpus, n, by, col)
    counts = g.groupBy(by, "prefix", "token").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy(by, "prefix").agg(F.sum("cnt").alias("_tot"))
    vocab = counts.groupBy(by).agg(F.countDistinct("token").alias("_v"))
    m = counts.join(totals, [by, "prefix"]).join(vocab, by)
    p = (F.col("cnt") + F.lit(add_k)) / (F.col("_tot") + F.lit(add_k) * F.col("_v"))
    return m.select(by, "prefix", "token", F.col("cnt").cast("long").alias("cnt"), p.alias("p"),
                    F.col("_tot").cast("long").alias("prefix_total"), F.col("_v").cast("long").alias("vocab"))


def score_ngram_perplexity(model: DataFrame, rows: DataFrame, n: int = 2, by: str = "author_id",
                           col: str = "content", id_col: str = "seq", add_k: float = 1.0,
                           batch_size: int = 4) -> DataFrame:
    """R2 -> E5: per-row mean negative log-likelihood, per-batch mean
    (sequential batches of ``batch_size`` rows by ``id_col``, incomplete
    tail dropped), perplexity = exp(mean of batch means).  A gram the author never
    wrote has the smoothed mass of its prefix, or of the vocabulary where the
    prefix is new as well.  Rows without a text, or of an author without a
    model, are left out.

    A mean of means is a weighted sum, and a gram's weight is known from its row
    alone, so nothing is looked up per gram: the model's counts and the weights
    of the rows' grams go through one grouped sum per gram, then per prefix, then
    per author.
    """
    from parley.operators.sequences import assign_batches

    known = model.select(by).distinct()
    rows = rows.where(F.col(col).isNotNull()).join(known, by, "left_semi").select(id_col, by, col)
    batched = materialize(assign_batches(rows, size=batch_size, id_col=id_col))
    kept = batched.count()
    size = (F.size(token_stream(F.col(col), n)) - (n - 1)).cast("double")
    asked = grams(batched.withColumn("_w", 1.0 / size), n, by, col, keep=("_w",))
    none = F.lit(0).cast("long")
    both = model.select(by, "prefix", "token", F.col("cnt"), F.lit(0.0).alias("_w"), F.col("vocab")) \
        .unionByName(asked.select(by, "prefix", "token", none.alias("cnt"), "_w", none.alias("vocab")))
    per_gram = both.groupBy(by, "prefix", "token").agg(
        F.sum("cnt").alias("cnt"), F.sum("_w").alias("_w"), F.max("vocab").alias("vocab"))
    per_prefix = per_gram.groupBy(by, "prefix").agg(
        F.sum("cnt").alias("tot"), F.sum("_w").alias("_w"), F.max("vocab").alias("vocab"),
        F.sum(F.col("_w") * F.log(F.col("cnt") + F.lit(add_k))).alias("_top"))
    seen = F.col("tot") > 0
    per_author = per_prefix.groupBy(by).agg(
        F.max("vocab").alias("vocab"),
        F.sum(F.when(seen, F.col("_w") * F.log(F.col("tot") + F.lit(add_k) * F.col("vocab")) - F.col("_top"))
              .otherwise(0.0)).alias("_seen"),
        F.sum(F.when(seen, 0.0).otherwise(F.col("_w"))).alias("_new"))
    loss = F.sum(F.col("_seen") + F.col("_new") * F.log("vocab")) / F.lit(float(max(kept, 1)))
    return per_author.agg(F.when(F.lit(kept > 0), F.round(loss, 9)).alias("mean_loss")) \
        .select(F.lit(kept // batch_size).cast("long").alias("batches"), "mean_loss",
                F.round(F.exp("mean_loss"), 6).alias("perplexity"))


def decode_candidates(model: DataFrame, by: str = "author_id", top_k: int = TOP_K,
                      top_p: float = TOP_P, temperature: float = TEMPERATURE,
                      salts: int = 16) -> DataFrame:
    """The next tokens sampling may pick for each prefix: the ``top_k``
    most likely, re-weighted by temperature, kept while the probability
    mass before them is below ``top_p``.  Adds ``rank``, ``q`` and ``cum``."""
    part = Window.partitionBy(by, "prefix")
    ordered = part.orderBy(F.col("p").desc(), F.col("token"))
    # two-stage top-k: a prefix followed by very many tokens is first cut to
    # top_k inside each of ``salts`` slices (exact: the global top_k is
    # inside the union of the slice top_k), so no task sorts a whole hot prefix
    salt = F.abs(F.xxhash64("token")) % salts
    sliced = Window.partitionBy(by, "prefix", "_salt").orderBy(F.col("p").desc(), F.col("token"))
    pre = model.select(by, "prefix", "token", "p", salt.alias("_salt")) \
               .withColumn("_r", F.row_number().over(sliced)).where(F.col("_r") <= top_k)
    x = pre.select(by, "prefix", "token", "p", F.row_number().over(ordered).alias("rank")) \
           .where(F.col("rank") <= top_k)
    x = x.withColumn("_w", F.exp(F.log("p") / temperature))
    x = x.withColumn("q", F.col("_w") / F.sum("_w").over(part))
    running = part.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("cum", F.sum("q").over(running))
    return x.where(F.col("cum") - F.col("q") < top_p) \
            .select(by, "prefix", "token", F.col("rank").cast("long").alias("rank"), "q", "cum")


def generate_with(prompts: DataFrame, generator: Callable[[pd.DataFrame], pd.Series],
                  id_col: str = "seq", prompt_col: str = "prompt") -> DataFrame:
    """R4 (pluggable): ``generator`` maps a pandas batch of prompts to reply
    texts; it runs once per Arrow batch inside each task (load a model
    per partition in it)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "pred": generator(b).astype(object)})
    return prompts.select(id_col, prompt_col).mapInPandas(run, f"{id_col} long, pred string")


def sampler_entries(model: DataFrame, by: str = "author_id", limit: int = TOP_K + MAX_LENGTH,
                    salts: int = 16) -> DataFrame:
    """The ``limit`` most likely tokens of each prefix, not yet cut: the repeat
    ban runs before the top-k and nucleus cut, and a history of at most
    ``MAX_LENGTH`` tokens bans at most that many, so ``TOP_K`` always remain
    to choose from.  One ranked array per prefix, cut per slice first."""
    salt = F.abs(F.xxhash64("token")) % salts
    sliced = Window.partitionBy(by, "prefix", "_salt").orderBy(F.col("p").desc(), F.col("token"))
    ranked = Window.partitionBy(by, "prefix").orderBy(F.col("p").desc(), F.col("token"))
    pre = model.select(by, "prefix", "token", "p", salt.alias("_salt")) \
               .withColumn("_r", F.row_number().over(sliced)).where(F.col("_r") <= limit)
    top = pre.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)
    return top.groupBy(by, "prefix").agg(
        F.array_sort(F.collect_list(F.struct("rank", "token", "p"))).alias("cands"))


def generate_replies(prompts: DataFrame, entries: DataFrame, n: int = 2, by: str = "author_id",
                     id_col: str = "seq", prompt_col: str = "prompt", seed: int = 0,
                     max_length: int = MAX_LENGTH, no_repeat: int = NO_REPEAT_NGRAM,
                     top_k: int = TOP_K, top_p: float = TOP_P, temperature: float = TEMPERATURE,
                     bucket_tokens: int = BUCKET_TOKENS, task_prompts: int = TASK_PROMPTS) -> DataFrame:
    """R4 (built-in): seeded sampling from ``sampler_entries``, token by token.

    Per step: tokens that would repeat an ``no_repeat``-gram of prompt and reply
    are banned; of the rest the ``top_k`` most likely are re-weighted by
    temperature and kept while the mass before them is below ``top_p``; a
    uniform from md5(seed:id:step) picks one.  A reply ends at the end marker,
    when nothing is left, or when prompt (words and message ends) and reply
    together have ``max_length`` tokens.

    Of the asked authors' entries those likeliest to be visited, at most
    ``bucket_tokens`` candidates, are held by every task; a prompt takes steps as
    long as they have its prefix.  All other entries stay a table: at a prefix of
    theirs a prompt stops, a join fetches that entry for the next round.  A model
    of up to ``bucket_tokens`` takes one round, a larger one at most
    ``max_length``; a round reads the table's keys and moves the asked entries only.
    """
    spark = prompts.sparkSession
    ends = F.size(F.split(F.col(prompt_col), r"\Q" + tx.EOS + r"\E", -1)) - 1
    words = F.coalesce(tx.word_tokens(F.regexp_replace(F.col(prompt_col), r"\Q" + tx.EOS + r"\E", " ")),
                       F.array().cast("array<string>"))
    # the reply is a new message: its first prefix is the start marker; the
    # prompt's words stay in the history for the no-repeat rule
    state = materialize(prompts.select(
        F.col(id_col).cast("string").alias("_id"), F.col(id_col), F.col(by).cast("string").alias("_by"),
        F.concat(words, F.array_repeat(F.lit(BOS), n - 1)).alias("_ctx"),
        (F.size(words) + F.coalesce(ends, F.lit(0))).alias("_len"), F.array().cast("array<string>").alias("_out"),
        F.lit(False).alias("_done"), F.lit(None).cast("string").alias("_prefix")))
    authors = materialize(state.groupBy("_by").agg(F.count(F.lit(1)).alias("_asked")))
    model = entries.select(F.col(by).cast("string").alias("by"), "prefix", "cands")
    model = materialize(model.join(counted_broadcast(authors), F.col("by").eqNullSafe(F.col("_by")))
                        .withColumn("_heat", _heat(F.col("cands"), F.col("_asked"))).drop("_by", "_asked"))
    least, whole = _head_heat(model, bucket_tokens)
    head = spark.sparkContext.broadcast(_Head(
        model.where(F.col("_heat") >= least).select("by", "prefix", "cands").toArrow(), whole))
    rest = model.where(F.col("_heat") < least).select("by", "prefix", "cands")
    rule = _Rule(n, seed, max_length, no_repeat, top_k, top_p, temperature)
    schema = state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = [rule.steps(head.value, **r)
                    for r in b.select(["_id", "_by", "_ctx", "_len", "_out", "_prefix", "_cands"]).to_pylist()]
            b = b.drop_columns(["_cands"])
            for i, c in enumerate(("_out", "_done", "_prefix")):
                at = b.schema.get_field_index(c)
                b = b.set_column(at, b.schema.field(at), pa.array([m[i] for m in mine], b.schema.field(at).type))
            yield b

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/replies-{uuid.uuid4().hex}"
    live, rounds = state.withColumn("_cands", F.lit(None).cast(model.schema["cands"].dataType)), 0
    total = state.count()
    while total or not rounds:
        tasks = -(-total // max(TASK_LEAST, min(task_prompts, -(-total // parallelism(spark)))))
        live.repartition(max(1, tasks)).mapInArrow(run, schema).write.parquet(f"{path}/round={rounds}")
        state = spark.read.schema(schema).parquet(f"{path}/round={rounds}").where("NOT _done")
        rounds += 1
        total = state.count()
        asked = state.select(F.col("_by").alias("_a"), F.col("_prefix").alias("_p")).distinct()
        found = rest.join(F.broadcast(asked) if total <= BROADCAST_ROWS else asked,
                          F.col("by").eqNullSafe(F.col("_a")) & (F.col("prefix") == F.col("_p"))) \
            .select("by", "prefix", F.col("cands").alias("_cands"))
        live = state.join(found, F.col("_by").eqNullSafe(F.col("by")) & (F.col("_prefix") == F.col("prefix")), "left") \
            .select(*schema.names, "_cands")
    out = spark.read.schema(T.StructType([*schema.fields, T.StructField("round", T.IntegerType())])).parquet(path)
    return out.where("_done").select(id_col, F.array_join("_out", " ").alias("pred"))


def _heat(cands: Column, asked: Column) -> Column:
    """How worth holding an entry is: the candidates' mean probability (which grows
    with the times its prefix was seen, per candidate), times the author's prompts;
    in eighths of a power of two, so that its values are few."""
    mean = F.aggregate(cands, F.lit(0.0), lambda a, c: a + c["p"]) / F.size(cands)
    return F.floor(F.log2(mean * asked) * 8).cast("int")


def _head_heat(model: DataFrame, limit: int) -> tuple[int, bool]:
    """(least heat of the entries that tasks hold, whether these are all)."""
    sizes = model.groupBy("_heat").agg(F.sum(F.size("cands")).alias("n")).orderBy(F.desc("_heat")).collect()
    least, held = 2 ** 31 - 1, 0
    for r in sizes:                               # a few hundred values
        if held + r["n"] > limit:
            return least, False
        least, held = r["_heat"], held + r["n"]
    return least, True


class _Head:
    """The entries that every task holds, as Arrow columns; a prefix's candidates
    become Python objects when it is visited."""

    def __init__(self, table: pa.Table, whole: bool):
        self.table, self.whole, self.rows = table.combine_chunks(), whole, None

    def get(self, by: str | None, prefix: str) -> list[tuple[str, float]] | None:
        if self.rows is None:
            self.rows, self.used, self.held = {}, {}, 0
            keys = zip(self.table.column("by").to_pylist(), self.table.column("prefix").to_pylist())
            for i, (b, p) in enumerate(keys):
                self.rows.setdefault(b, {})[p] = i
        i = self.rows.get(by, {}).get(prefix)
        if i is None:
            return [] if self.whole else None
        if i not in self.used:
            if self.held > HELD_OBJECTS:
                self.used, self.held = {}, 0
            self.used[i] = _pairs(self.table.column("cands")[i].as_py())
            self.held += len(self.used[i])
        return self.used[i]


def _pairs(cands: list[dict] | None) -> list[tuple[str, float]]:
    return [(c["token"], c["p"]) for c in cands or []]


class _Rule:
    """The sampling rule over the candidates at hand."""

    def __init__(self, n, seed, max_length, no_repeat, top_k, top_p, temperature):
        self.n, self.seed, self.max_length, self.no_repeat = n, seed, max_length, no_repeat
        self.top_k, self.top_p, self.temperature = top_k, top_p, temperature

    def steps(self, head, _id, _by, _ctx, _len, _out, _prefix, _cands):
        """(reply so far, finished, prefix to fetch) after the steps that the head's
        entries and the fetched one of ``_prefix`` allow."""
        k = self.no_repeat
        hist, out = _ctx + _out, list(_out)
        if len(out) + _len >= self.max_length:
            return out, True, None
        seen = {tuple(hist[i:i + k]) for i in range(len(hist) - k + 1)}
        fetched = _pairs(_cands)
        while len(out) + _len < self.max_length:
            prefix = " ".join(hist[len(hist) - self.n + 1:])
            cands = fetched if prefix == _prefix else head.get(_by, prefix)
            if cands is None:
                return out, False, prefix
            last = tuple(hist[len(hist) - k + 1:])
            free = (c for c in cands if k <= 1 or (*last, c[0]) not in seen)
            token = self.draw(list(itertools.islice(free, self.top_k)), _id, len(out))
            if token is None or token == EOS_TOKEN:
                break
            out.append(token)
            hist.append(token)
            seen.add(tuple(hist[len(hist) - k:]))
        return out, True, None

    def draw(self, cands: list[tuple[str, float]], rid: str, step: int) -> str | None:
        w = [math.exp(math.log(p) / self.temperature) for _, p in cands]
        total = sum(w)
        kept, mass = [], 0.0
        for x in w:
            if mass >= self.top_p:
                break
            kept.append(x / total)
            mass += x / total
        u = int(hashlib.md5(f"{self.seed}:{rid}:{step}".encode()).hexdigest()[:8], 16) / 2 ** 32
        run = 0.0
        for (token, _), q in zip(cands, kept):
            run += q
            if run >= u * mass:
                return token
        return None
