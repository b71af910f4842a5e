"""Approximate nearest neighbours with randomly rotated one-bit codes (op 5).

The index stores for every vector, after subtracting a centre and a random
rotation, one sign bit per dimension (packed), its distance to the centre and a
correction scalar: the inner product of the unit residual with its code.  For a
query, packed bits and scalars give an unbiased estimate of the distance
and an error bound; in each block of vectors only those whose lower bound is
not above the k-th smallest upper bound are measured exactly (double
precision, original values).  Every block returns its k best per query, and
these are merged.

Queries are a stated set; they are taken against all rows in blocks of
``query_block`` times ``block`` vectors, so no task holds more than one block of
either.  A block's result is at most k rows per query.

Defined results for odd input
- null or empty vectors, vectors of length zero, or with a null or non-finite
  component: take no part, neither as query nor as candidate
- vectors of another dimension than the most common one: take no part (ties:
  the larger dimension)
- null id: takes no part;  repeated ids: every row is a candidate; no candidate
  shares the query's id; a query id that repeats, with equal or other values, is
  answered as one query, and a candidate row found once, by the nearest of them
- ties: the smaller id;  fewer candidates than k: all of them
- empty table: an empty result;  extra columns: not returned
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.scratch import keep

BLOCK = 4096
QUERY_BLOCK = 512
EPSILON = 3.0               # error bound in standard deviations
CENTRE_SAMPLE = 20_000      # bound of the sample the centre is fitted on
SEED = 5


def usable(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, v): the rows that take part, components as doubles."""
    v = F.col(vec).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) \
        & F.exists(v, lambda x: x != 0)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")) \
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    dims = base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), F.desc("d")).first()
    return base.where(F.size("v") == (dims["d"] if dims else 0))


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, distance to the centre, <code, unit residual>)."""
    r = (x - centre) @ turn
    norm = np.sqrt((r * r).sum(axis=1))
    unit = r / np.where(norm > 0, norm, 1)[:, None]
    bits = np.packbits(r > 0, axis=1)
    corr = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return bits, norm, np.where(norm > 0, corr, 1.0)


def build(rows: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(index, centre, rotation); an index row is one numbered block of vectors: ids,
    the original values, packed bits and scalars."""
    first = rows.select(F.size("v").alias("d")).first()
    dims = first["d"] if first else 0
    n = rows.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0) < min(1.0, CENTRE_SAMPLE / max(n, 1))
    mean = {r["i"]: r["m"] for r in rows.where(draw).select(F.posexplode("v").alias("i", "x"))
            .groupBy("i").agg(F.avg("x").alias("m")).collect()}
    centre = np.array([mean.get(i, 0.0) for i in range(dims)])
    turn = rotation(dims, seed) if dims else np.zeros((0, 0))

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                x = _matrix(part.column(1))
                bits, norm, corr = encode(x, centre, turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.asarray(a, t).tobytes()], pa.binary()) for a, t in (
                        (part.column(0).to_numpy(), "<i8"), (x, "<f8"), (bits, "u1"), (norm, "<f8"), (corr, "<f8"))],
                    names=["ids", "x", "bits", "norm", "corr"])

    index = rows.select("id", "v").mapInArrow(pack, "ids binary, x binary, bits binary, norm binary, corr binary")
    return keep(index.withColumn("no", F.monotonically_increasing_id()), "ann-index"), centre, turn


def bounds(q: np.ndarray, bits: np.ndarray, norm: np.ndarray, corr: np.ndarray, centre: np.ndarray,
           turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bound of the squared distance, queries by vectors."""
    dims = len(centre)
    rq = (q - centre) @ turn
    nq = np.sqrt((rq * rq).sum(axis=1))
    unit = rq / np.where(nq > 0, nq, 1)[:, None]
    sign = np.unpackbits(bits, axis=1)[:, :dims].astype(np.float32) * 2 - 1
    dot = (unit.astype(np.float32) @ sign.T).astype(np.float64) / np.sqrt(dims)
    est = dot / corr
    err = epsilon * np.sqrt(np.maximum(1 - corr ** 2, 0) / corr ** 2 / max(dims - 1, 1)) + 1e-6
    both = nq[:, None] ** 2 + norm ** 2
    cross = 2 * nq[:, None] * norm
    return both - cross * np.minimum(est + err, 1), both - cross * np.maximum(est - err, -1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distance in double precision, summed dimension by dimension."""
    d = np.zeros(len(x))
    for j in range(x.shape[1]):
        t = x[:, j] - q[j]
        d += t * t
    return np.sqrt(d)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec: str = "embedding", *,
           block: int = BLOCK, query_block: int = QUERY_BLOCK, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query."""
    rows = usable(vectors, id_col, vec)
    index, centre, turn = build(rows, block)
    wanted = usable(vectors.where(is_query), id_col, vec).where(F.size("v") == len(centre)).distinct()

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, query_block):
                part = b.slice(i, query_block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                     pa.array([_matrix(part.column(1)).astype("<f8").tobytes()], pa.binary())], names=["qid", "q"])

    # few rows per task are packed together: the queries are dealt to as many tasks as blocks are needed
    n_query = wanted.count()
    packed = wanted.select("id", "v").repartition(max(1, -(-n_query // query_block)), "id") \
        .mapInArrow(pack, "qid binary, q binary")
    # the stated query set against all rows, block by block; neither side is broadcast
    pairs = index.crossJoin(keep(packed, "ann-queries").hint("shuffle_replicate_nl")) \
        .select("ids", "x", "bits", "norm", "corr", "qid", "q", "no")
    dims = len(centre)

    def run(batches):
        for b in batches:
            for ids, x, bits, norm, corr, qid, q, no in zip(*(b.column(i).to_pylist() for i in range(8))):
                ids, qid = np.frombuffer(ids, "<i8"), np.frombuffer(qid, "<i8")
                x, q = np.frombuffer(x, "<f8").reshape(-1, dims), np.frombuffer(q, "<f8").reshape(-1, dims)
                bits = np.frombuffer(bits, np.uint8).reshape(len(ids), -1)
                norm, corr = np.frombuffer(norm, "<f8"), np.frombuffer(corr, "<f8")
                out_q, out_v, out_d, out_at = [], [], [], []
                for i in range(0, len(qid), 64):
                    low, high = bounds(q[i:i + 64], bits, norm, corr, centre, turn, epsilon)
                    own = ids[None, :] == qid[i:i + 64, None]
                    high[own] = np.inf
                    kth = np.partition(high, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                    for r in range(len(low)):
                        cand = np.flatnonzero((low[r] <= kth[r] + 1e-9) & ~own[r])
                        if not len(cand):
                            continue
                        d = exact(q[i + r], x[cand])
                        best = np.lexsort((ids[cand], d))[:k]
                        out_q.append(np.full(len(best), qid[i + r]))
                        out_v.append(ids[cand][best])
                        out_d.append(d[best])
                        out_at.append(cand[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out_q), pa.int64()), pa.array(np.concatenate(out_v), pa.int64()),
                         pa.array(np.concatenate(out_d), pa.float64()),
                         pa.array(np.full(sum(map(len, out_at)), no), pa.int64()),
                         pa.array(np.concatenate(out_at), pa.int64())],
                        names=["query_id", "vec_id", "score", "no", "at"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double, no long, at long") \
        .groupBy("query_id", "no", "at", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
