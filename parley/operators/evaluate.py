"""Evaluation E1..E7: ROUGE per pair and per corpus, perplexity, loss curve.

ROUGE-N is computed inside each row (sorted n-gram arrays merged by a
fold), so no n-gram ever shuffles.  ROUGE-L needs an LCS per pair, which
runs in an Arrow-batched pandas UDF.  Corpus scores are aggregations; the
bootstrap "mid" score keeps one vector of replicate sums per task, and only these
vectors are shuffled and added up, element by element.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import lcs as L
from parley.functions import text as tx
from parley.session import parallelism

# fixed values of the original tool and its scorer: 30 benchmark rows,
# 1000 bootstrap samples, loss logged every 1000 steps
BENCH_ROWS = 30
BOOTSTRAP_SAMPLES = 1000
LOG_EVERY = 1000
PRIME = 2 ** 31 - 1      # of the bootstrap's uniforms
MERGE_WAYS = 64          # tasks that add up the vectors of all others
CHUNK_ROWS = 256         # rows whose replicate weights are held at a time


def benchmark_sample(test: DataFrame, order: list[Column], n: int | None = BENCH_ROWS) -> DataFrame:
    """The first ``n`` test rows in their (shuffled) order."""
    return test if n is None else test.orderBy(*order).limit(n)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, in order."""
    if n == 1:
        return tokens
    cnt = F.size(tokens) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(cnt, F.lit(1))),
                        lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(cnt > 0, grams).otherwise(F.array().cast("array<string>"))


def multiset_overlap(sa: str, sb: str) -> Column:
    """Size of the multiset intersection of two *sorted* array columns:
    one linear merge fold (the lambda only reads the columns by index)."""
    a, b = F.col(sa), F.col(sb)
    na, nb = F.size(a), F.size(b)
    init = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("o"))

    def step(s, _):
        x = F.element_at(a, s["i"])
        y = F.element_at(b, s["j"])
        done = (s["i"] > na) | (s["j"] > nb)
        return F.when(done, s) \
            .when(x == y, F.struct((s["i"] + 1).alias("i"), (s["j"] + 1).alias("j"), (s["o"] + 1).alias("o"))) \
            .when(x < y, F.struct((s["i"] + 1).alias("i"), s["j"].alias("j"), s["o"].alias("o"))) \
            .otherwise(F.struct(s["i"].alias("i"), (s["j"] + 1).alias("j"), s["o"].alias("o")))

    steps = F.sequence(F.lit(1), F.greatest(na + nb, F.lit(1)))
    return F.aggregate(steps, init, step)["o"]


def rouge_n(df: DataFrame, n: int | tuple[int, ...], pred: str = "pred", ref: str = "label",
            prefix: str | None = None) -> DataFrame:
    """ROUGE-n precision / recall / F per row (clipped counts) for one n
    or several (the texts are tokenised once for all of them)."""
    ns = (n,) if isinstance(n, int) else tuple(n)
    # tokens become columns first: the n-gram lambdas then only slice them
    x = df.withColumn("_tp", tx.rouge_tokens(F.col(pred))).withColumn("_tr", tx.rouge_tokens(F.col(ref)))
    for k in ns:
        p = prefix if (prefix and len(ns) == 1) else f"rouge{k}"
        x = x.withColumn("_gp", F.array_sort(ngrams(F.col("_tp"), k))) \
             .withColumn("_gr", F.array_sort(ngrams(F.col("_tr"), k)))
        ov = multiset_overlap("_gp", "_gr")
        prec = ov / F.greatest(F.size("_gp"), F.lit(1))
        rec = ov / F.greatest(F.size("_gr"), F.lit(1))
        x = x.withColumn(f"{p}_p", prec.cast("double")).withColumn(f"{p}_r", rec.cast("double"))
        f = F.when(F.col(f"{p}_p") + F.col(f"{p}_r") > 0,
                   2 * F.col(f"{p}_p") * F.col(f"{p}_r") / (F.col(f"{p}_p") + F.col(f"{p}_r"))) \
             .otherwise(F.lit(0.0))
        x = x.withColumn(f"{p}_f", f).drop("_gp", "_gr")
    return x.drop("_tp", "_tr")


_TOK = re.compile(r"[a-z0-9]+")
_LSCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in
                         ("rougeL_p", "rougeL_r", "rougeL_f", "rougeLsum_p", "rougeLsum_r", "rougeLsum_f")])


@F.pandas_udf(_LSCHEMA)
def _rouge_l_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = []
    for p, r in zip(pred, ref):
        p = p or ""
        r = r or ""
        pt, rt = _TOK.findall(p.lower()), _TOK.findall(r.lower())
        a = L.rouge_l(rt, pt)
        ps = [_TOK.findall(s.lower()) for s in p.split("\n") if len(s)]
        rs = [_TOK.findall(s.lower()) for s in r.split("\n") if len(s)]
        b = L.rouge_lsum(rs, ps)
        rows.append(a + b)
    return pd.DataFrame(rows, columns=_LSCHEMA.fieldNames())


def rouge_l(df: DataFrame, pred: str = "pred", ref: str = "label") -> DataFrame:
    """ROUGE-L and ROUGE-Lsum per row."""
    return df.withColumn("_l", _rouge_l_udf(F.col(pred), F.col(ref))).select("*", "_l.*").drop("_l")


def _poisson_cdf(resolution: float = 2.0 ** -32) -> list[float]:
    """CDF of Poisson(1) at 0, 1, .. as far as a uniform of this resolution reaches."""
    out, acc = [], 0.0
    while acc < 1 - resolution:
        acc += math.exp(-1) / math.factorial(len(out))
        out.append(acc)
    return out


def bootstrap_weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights, rows by replicates, from reproducible uniforms: two
    rounds of x^5 (a bijection modulo the prime) over id, replicate and seed."""
    def fifth(x):
        y = x * x % PRIME
        return y * y % PRIME * x % PRIME

    a, r = (ids % PRIME)[:, None], reps[None, :]
    h = fifth((a * 48271 + r * 69621 + seed) % PRIME)
    h = fifth((h + a * 16807 + r) % PRIME)
    return np.searchsorted(np.array(_poisson_cdf()), h / PRIME, side="right")


def rouge_mid(scores: DataFrame, cols: list[str], id_col: str = "seq", seed: int = 0,
              samples: int = BOOTSTRAP_SAMPLES) -> DataFrame:
    """Corpus score per metric = median of ``samples`` Poisson-bootstrap
    means, x100, 4 decimals.  Also the plain mean.  Integer ids weigh by their
    value, others by a hash; a null score counts in neither sum.

    Every task adds its rows into one vector (a sum of scores and of weights per
    metric and replicate; replicate 0 weighs every row once), the vectors are
    dealt to ``MERGE_WAYS`` tasks and the sums of these to one.
    """
    spark = scores.sparkSession
    width = len(cols)
    integral = isinstance(scores.schema[id_col].dataType, T.IntegralType)
    number = F.coalesce(F.col(id_col).cast("long") if integral else F.xxhash64(id_col), F.lit(0))
    reps = np.arange(1, samples + 1, dtype=np.int64)

    def vector(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    def add_rows(batches):
        total = np.zeros((2, width, samples + 1))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]])
            for i in range(0, len(ids), CHUNK_ROWS):
                part = x[i:i + CHUNK_ROWS].T
                known = ~np.isnan(part)
                w = np.ones((part.shape[1], samples + 1))
                w[:, 1:] = bootstrap_weights(ids[i:i + CHUNK_ROWS], reps, seed)
                total[0] += np.where(known, part, 0.0) @ w
                total[1] += known.astype(float) @ w
        yield vector(total)

    def add_vectors(batches):
        total = np.zeros(2 * width * (samples + 1))
        for b in batches:
            for v in b.column(0):
                total += v.values.to_numpy()
        yield vector(total)

    sums = scores.select(F.pmod(number, F.lit(PRIME)), *[F.col(c).cast("double") for c in cols]) \
        .mapInArrow(add_rows, "v array<double>")
    ways = min(MERGE_WAYS, parallelism(spark))
    merged = sums.repartition(ways).mapInArrow(add_vectors, "v array<double>") \
        .repartition(1).mapInArrow(add_vectors, "v array<double>")
    size = samples + 1
    rep = F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("rep")
    at = lambda half, i: F.get("v", F.lit((half * width + i) * size) + F.col("rep"))
    means = merged.select("v", rep).select("rep", *[
        F.try_divide(at(0, i), at(1, i)).alias(c) for i, c in enumerate(cols)])
    long = means.select("rep", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("m")) for c in cols])).alias("s")).select("rep", "s.*")
    kind = F.when(F.col("rep") == 0, F.lit("mean")).otherwise(F.lit("mid"))
    return long.groupBy("metric", kind.alias("kind")).agg(
        F.round(F.percentile("m", F.lit(0.5)) * 100, 4).alias("value"))


def perplexity(losses: DataFrame, loss_col: str = "loss") -> DataFrame:
    """E5: exp of the unweighted mean of per-batch mean losses; no batches
    gives null instead of a division by zero."""
    m = F.avg(F.col(loss_col))
    return losses.agg(F.count(F.lit(1)).alias("batches"), m.alias("mean_loss")) \
        .select("batches", F.round("mean_loss", 9).alias("mean_loss")) \
        .withColumn("perplexity", F.round(F.exp("mean_loss"), 2))


def loss_curve(log: DataFrame, every: int = LOG_EVERY, step_col: str = "step",
               loss_col: str = "loss") -> DataFrame:
    """Mean loss of every complete block of ``every`` steps."""
    blk = F.floor((F.col(step_col) - 1) / every).cast("long")
    return log.groupBy(blk.alias("block")) \
        .agg(F.count(F.lit(1)).alias("_n"), F.avg(loss_col).alias("mean_loss")) \
        .where(F.col("_n") == every) \
        .select("block", ((F.col("block") + 1) * every).alias("step"),
                F.round("mean_loss", 9).alias("mean_loss"))


def loss_summary(log: DataFrame, step_col: str = "step", loss_col: str = "loss") -> DataFrame:
    """The number of steps and the mean loss over all of them (null: none)."""
    return log.agg(F.max(step_col).cast("long").alias("steps"),
                   F.round(F.try_divide(F.sum(loss_col), F.max(step_col)), 9).alias("mean_loss"))


ROUGE = ["rouge1", "rouge2", "rougeL", "rougeLsum"]


def score_replies(pairs: DataFrame, pred: str = "pred", ref: str = "label") -> DataFrame:
    """ROUGE-1, -2, -L and -Lsum of every pair."""
    return rouge_l(rouge_n(pairs, (1, 2), pred, ref), pred, ref)


def reply_report(pairs: DataFrame, perplexity_table: DataFrame | None = None, id_col: str = "seq", seed: int = 0,
                 samples: int = BOOTSTRAP_SAMPLES) -> DataFrame:
    """E7 -> S8: ``(metric, value)``: the mid F of the four ROUGE scores over all
    pairs, and the perplexity."""
    mids = rouge_mid(score_replies(pairs), [f"{m}_f" for m in ROUGE], id_col, seed, samples)
    out = mids.where(F.col("kind") == "mid").select(F.regexp_replace("metric", "_f$", "").alias("metric"), "value")
    if perplexity_table is not None:
        out = out.unionByName(perplexity_table.select(F.lit("perplexity").alias("metric"),
                                                      F.col("perplexity").alias("value")))
    return out


def label_pred_table(labels: DataFrame, preds: DataFrame, id_col: str = "seq") -> DataFrame:
    """The reference answer beside the prediction, by row id."""
    return labels.select(id_col, F.col("response").alias("label")) \
                 .join(preds.select(id_col, "pred"), id_col, "inner")


def write_eval_report(scores: DataFrame, path: str) -> None:
    """Sorted ``metric = value`` lines (one small file)."""
    scores.select(F.concat_ws(" = ", "metric", F.col("value").cast("string")).alias("line"),
                  "metric").orderBy("metric").select("line") \
          .coalesce(1).write.mode("overwrite").text(path)
