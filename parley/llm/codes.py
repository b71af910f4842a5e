"""Vector code compression with an exact limb-split GEMM (op 11).

A vector is scaled to integers, cut into equal consecutive parts, and each part
is replaced by the index of its nearest codebook entry.  Assignment is exact:
integers are broken into limbs so small that every sum of limb products stays
below 2^53, so the float64 matrix products are exact; their sums are put
together again in int64, and the first smallest squared distance wins.

Training and encoding are passes of narrow tasks over the vectors.  A round
gives one row of sums per used entry and task, added up by Spark; the driver
holds the codebooks alone (``parts * entries`` rows, whatever the corpus size).

Defined results for odd input
- vector null, or with a null or non-finite component: dropped
- vector of another length than the most common one (ties: the longer), or of a
  length that ``parts`` does not divide, the empty vector included: dropped
- null id: encoded, but never a starting entry;  repeated ids: every row is
  encoded; starting entries are taken in order of id, then of the vector
- fewer kept rows than entries: as many entries as rows; no row: no entry and an
  empty result
- ties: the lower entry
- integers so large that a summed squared distance leaves int64: an error that
  says so, never a wrong code
- extra columns: returned where named in ``carry``, else not
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CHUNK = 2_048            # vectors whose distances are held at a time
LONG = (1 << 63) - 1


def usable(vectors: DataFrame, vec: str, parts: int) -> DataFrame:
    """The rows that take part, their vector as doubles in ``_v``."""
    v = F.col(f"`{vec}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.withColumn("_v", v).where(F.col("_v").isNotNull() & good)
    size = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), F.desc("d")).first()
    width = size["d"] if size else 0
    return rows.where(F.lit(width > 0 and width % parts == 0) & (F.size("_v") == width))


def integers(col: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, one row per vector."""
    if len(col) == 0:
        return np.zeros((0, 0), np.int64)
    x = np.floor(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) * scale)
    if np.abs(x).max(initial=0.0) >= 2.0 ** 62:
        raise ValueError("a scaled component does not fit a long")
    return x.astype(np.int64)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs, lowest first: ``x == sum(limb_i * 2**(bits * i))``.  Lower limbs
    lie in [0, 2^bits), the last one carries the sign."""
    out, rest, low = [], x, np.int64((1 << bits) - 1)
    while rest.size and (rest.max() > low or rest.min() < -low):
        out.append((rest & low).astype(np.float64))
        rest = rest >> np.int64(bits)
    return [*out, rest.astype(np.float64)]


def limb_bits(width: int) -> int:
    """Widest limb for which ``width`` products sum to less than 2^53."""
    return (53 - int(width).bit_length()) // 2


def exact_dots(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``a @ b.T`` of int64 matrices by float64 products of limbs, summed in int64."""
    bits = bits or limb_bits(a.shape[1])
    right = [x.T for x in limbs(b, bits)]
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                out += (x @ y).astype(np.int64) << np.int64(bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, its squared distance) of every row of ``x``."""
    d = (x * x).sum(axis=1)[:, None] - 2 * exact_dots(x, book, bits) + (book * book).sum(axis=1)[None, :]
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _checked(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """``x``; an error where distances to ``books`` might leave int64."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if 4 * top * top * x.shape[1] > LONG:
        raise ValueError(f"integers up to {top} give squared distances beyond a long")
    return x


def fit(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", *, parts: int = PARTS,
        entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks, int64 of shape (parts, entries, width of a part)."""
    rows = usable(vectors, vec, parts)
    seeds = rows.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), "_v") \
        .orderBy("_id", "_v").limit(entries).collect()
    if not seeds:
        return np.zeros((parts, 0, 0), np.int64)
    start = integers(pa.array([r["_v"] for r in seeds], pa.list_(pa.float64())), scale)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for part, entry, n, sums in _sums(rows, books, scale):
            books[part, entry] = [s // n for s in sums]      # Python integers: the floor is exact
    return books


def _sums(rows: DataFrame, books: np.ndarray, scale: int) -> list:
    """(part, entry, rows assigned, component sums) of every used entry."""
    parts, entries, width = books.shape

    def add(batches):
        n = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                x = _checked(integers(b.column(0).slice(i, CHUNK), scale), books)
                for p in range(parts):
                    own = x[:, p * width:(p + 1) * width]
                    best, _ = nearest(own, books[p])
                    n[p] += np.bincount(best, minlength=entries)
                    np.add.at(total[p], best, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]),
             pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    found = rows.select("_v").mapInArrow(add, "part int, entry int, n long, s array<long>")
    sums = [F.sum(F.get("s", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    return [(r["part"], r["entry"], r["n"], [int(r[f"s{j}"]) for j in range(width)])
            for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()]


def encode(vectors: DataFrame, books: np.ndarray, vec: str = "embedding", carry: Sequence[str] = ("vec_id",), *,
           scale: int = SCALE) -> DataFrame:
    """The ``carry`` columns, ``codes`` (entry per part) and ``error`` (squared
    distances summed over the parts) of every row that takes part."""
    parts, entries, width = books.shape
    rows = usable(vectors, vec, parts).select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), "_v")
    if not entries:
        rows = rows.where(F.lit(False))
    schema = T.StructType([rows.schema["_row"], T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("error", T.LongType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                x = _checked(integers(part.column(1), scale), books)
                code, error = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64)
                for p in range(parts):
                    code[:, p], d = nearest(x[:, p * width:(p + 1) * width], books[p])
                    error += d
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()),
                                                pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat, pa.array(error)],
                                                 names=["_row", "codes", "error"])

    taken = {"codes", "error"}
    return rows.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in carry if c not in taken],
                                               "codes", "error")


def hex_code(codes: Column) -> Column:
    """Entries as text, two hex digits each (one more per further byte is never cut)."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
