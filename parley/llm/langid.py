"""Language identification by nearest centroid (op 10).

A text becomes a vector of hashed character 2- and 3-grams (letters lower-cased,
every other run of characters one blank), weighted by sublinear term
frequency times inverse document frequency and scaled to length one.  Every
language has several centroids, found by spherical k-means over a bounded
sample of labelled texts; a text takes the language of the centroid with the
largest cosine.  Rejection is by distance: a text whose best cosine lies below
its language's radius (a low quantile of the best cosines of the language's
labelled sample, relaxed by ``slack``) is rejected.

Defined results for odd input
- null or empty text, or a text without a letter: ``und``, score 0, rejected
- ties between centroids: the smallest language name, then the first centroid
- repeated rows: each gets its own, equal, result
- no labelled row at all: every text is ``und``
- extra columns: kept by ``identify`` unless they clash with its outputs,
  which replace them
- very long texts: vectorised whole, in slices of bounded size

The sample: at most ``sample_per_lang`` different labelled texts of each language,
those with the smallest hashes (all, if there are no more), so the model does
not follow the corpus size, and a text that repeats counts once.
Counting languages, predicting and rejecting cover every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.scratch import keep

DIMS = 4096                 # hashed n-gram space, a power of two
SAMPLE_PER_LANG = 1500      # bound of the labelled sample, per language
CENTROIDS = 4               # clusters per language
ROUNDS = 12                 # k-means rounds
RADIUS_QUANTILE = 0.01
SLACK = 0.35
CHUNK_CHARS = 400_000       # characters vectorised at once
UND = "und"

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Code point -> 0 for a non-letter, else a letter number (lower case)."""
    global _CLASS
    if _CLASS is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                table[cp] = ord(low[0])
        _CLASS = table
    return _CLASS


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def count_vectors(texts: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts of shape (rows, dims), has-a-letter flag per row)."""
    n = len(texts)
    out = np.zeros((n, dims), dtype=np.float32)
    has = np.zeros(n, dtype=bool)
    table = _classes()
    i = 0
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j]) <= CHUNK_CHARS) and j - i < 256:
            size += len(texts[j])
            j += 1
        if j == i + 1 and size > CHUNK_CHARS:
            # one long text: pieces overlap by two characters, so every n-gram is counted once
            row = np.zeros((1, dims), dtype=np.float32)
            t = texts[i]
            last_blank = True
            carry = np.zeros(0, np.uint32)
            for at in range(0, len(t), CHUNK_CHARS):
                c = table[_code_points(t[at:at + CHUNK_CHARS])]
                has[i] |= bool(c.any())
                c = _squeeze(c, np.zeros(0, np.int64), last_blank)
                last_blank = len(c) == 0 and last_blank or (len(c) > 0 and c[-1] == 0)
                joined = np.concatenate([carry if at else np.zeros(1, np.uint32), c])
                final = at + CHUNK_CHARS >= len(t)
                if final and joined[-1] != 0:
                    joined = np.append(joined, np.uint32(0))
                new_from = len(carry) if at else 0
                _add(row, joined, np.zeros(len(joined), np.int64), dims, new_from)
                carry = joined[-2:]
            out[i] = row[0]
        else:
            joined = " " + " ".join(texts[i:j]) + " "
            c = table[_code_points(joined)]
            lengths = np.array([len(t) + 1 for t in texts[i:j]])
            row_of = np.repeat(np.arange(j - i), lengths)
            # the leading blank belongs to row 0, each blank after a text to that text
            row_of = np.concatenate([[0], row_of])
            letters = np.bincount(row_of, weights=(c != 0), minlength=j - i)
            has[i:j] = letters > 0
            keep_at = np.ones(len(c), dtype=bool)
            keep_at[1:] = (c[1:] != 0) | (c[:-1] != 0)
            _add(out[i:j], c[keep_at], row_of[keep_at], dims, 0)
        i = j
    return out, has


def _squeeze(c: np.ndarray, _unused: np.ndarray, after_blank: bool) -> np.ndarray:
    mask = np.ones(len(c), dtype=bool)
    if len(c):
        mask[1:] = (c[1:] != 0) | (c[:-1] != 0)
        mask[0] = c[0] != 0 or not after_blank
    return c[mask]


def _add(out: np.ndarray, c: np.ndarray, row: np.ndarray, dims: int, new_from: int) -> None:
    """Counts of 2- and 3-grams ending at positions >= ``new_from``; a gram
    belongs to the row of its last character but one (its middle)."""
    mask = np.uint32(dims - 1)
    a = c * np.uint32(0x9E3779B1)
    b = c * np.uint32(0x85EBCA77)
    d = c * np.uint32(0xC2B2AE3D)
    rows = len(out)
    flat = out.reshape(-1)
    if len(c) >= 2:
        h2 = a[:-1] ^ (b[1:] + np.uint32(0x27D4EB2F))
        h2 ^= h2 >> np.uint32(15)
        lo = max(0, new_from - 1)
        idx = (row[1:] * dims + (h2 & mask))[lo:]
        # a pair that only spans the blank between two texts is not a gram of either
        ok = (c[:-1] != 0) | (c[1:] != 0)
        flat += np.bincount(idx[ok[lo:]], minlength=rows * dims).astype(np.float32)
    if len(c) >= 3:
        h3 = a[:-2] + (b[1:-1] ^ np.uint32(0x165667B1)) + (d[2:] >> np.uint32(3)) * np.uint32(31)
        h3 ^= h3 >> np.uint32(13)
        h3 *= np.uint32(0x2C1B3C6D)
        h3 ^= h3 >> np.uint32(16)
        lo = max(0, new_from - 2)
        idx = (row[1:-1] * dims + (h3 & mask))[lo:]
        ok = (c[1:-1] != 0)
        flat += np.bincount(idx[ok[lo:]], minlength=rows * dims).astype(np.float32)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass
class CentroidModel:
    """Centroids (rows of length one), their languages and their radii."""
    langs: list[str] = field(default_factory=list)
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS, np.float32))
    dims: int = DIMS

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) per text."""
        n = len(texts)
        lang, score, rejected = [UND] * n, np.zeros(n), np.ones(n, dtype=bool)
        if not self.langs:
            return lang, score, rejected
        for i in range(0, n, 256):
            part = [t or "" for t in texts[i:i + 256]]
            counts, has = count_vectors(part, self.dims)
            cos = np.clip(tfidf(counts, self.idf) @ self.centroids.T, 0.0, 1.0)
            best = cos.argmax(axis=1)
            for k in np.flatnonzero(has):
                b = int(best[k])
                lang[i + k] = self.langs[b]
                score[i + k] = float(cos[k, b])
                rejected[i + k] = cos[k, b] < self.radius[b]
        return lang, score, rejected


def _pack(v: np.ndarray) -> bytes:
    idx = np.flatnonzero(v).astype(np.uint16 if len(v) <= 65536 else np.uint32)
    return idx.tobytes() + v[idx].astype(np.float32).tobytes()


def _unpack(data: bytes, dims: int) -> np.ndarray:
    it = np.dtype(np.uint16 if dims <= 65536 else np.uint32)
    n = len(data) // (it.itemsize + 4)
    out = np.zeros(dims, np.float32)
    out[np.frombuffer(data, it, n)] = np.frombuffer(data, np.float32, n, offset=n * it.itemsize)
    return out


def _cluster(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first seeding (deterministic)."""
    mean = x.mean(axis=0)
    seeds = [x[int((x @ mean).argmax())]]
    while len(seeds) < min(k, len(x)):
        near = np.max(np.stack([x @ s for s in seeds]), axis=0)
        # a quantile rather than the extreme: an outlier makes a poor seed
        seeds.append(x[int(np.argsort(near, kind="stable")[len(near) // 20])])
    c = np.stack(seeds)
    own = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    own = (x @ c.T).argmax(axis=1)
    return c, own


def fit(train: DataFrame, text: str = "text", lang: str = "lang", *, dims: int = DIMS,
        sample_per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS,
        rounds: int = ROUNDS, quantile: float = RADIUS_QUANTILE, slack: float = SLACK) -> CentroidModel:
    """Fit on labelled rows (rows with a null language or text take no part)."""
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text"))
    # per language the largest hash to take: each task sends no more than the sample's hashes
    rank = Window.partitionBy("lang").orderBy("h")
    last = {r["lang"]: r["h"] for r in rows.select("lang", "h").distinct()
            .withColumn("r", F.row_number().over(rank)).where(F.col("r") <= sample_per_lang)
            .groupBy("lang").agg(F.max("h").alias("h")).collect()}           # one row per language
    if not last:
        return CentroidModel(dims=dims, idf=np.ones(dims, np.float32))
    limit = F.create_map(*[x for name, h in sorted(last.items()) for x in (F.lit(name), F.lit(h))])
    sample = rows.where(F.col("h") <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def vectors(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i:i + 256]
                v, has = count_vectors(part["text"].tolist(), dims)
                names = part["lang"].tolist()
                yield pd.DataFrame({"lang": [names[k] for k in range(len(names)) if has[k]],
                                    "v": [_pack(v[k]) for k in range(len(names)) if has[k]]})

    vec = keep(sample.mapInPandas(vectors, "lang string, v binary"), "langid-sample")

    def frequencies(batches):
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for data in b["v"]:
                df += _unpack(data, dims) > 0
                n += 1
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"k": np.append(hit, -1), "n": np.append(df[hit], n)})

    counts = {r["k"]: r["n"] for r in vec.mapInPandas(frequencies, "k long, n long")
              .groupBy("k").agg(F.sum("n").alias("n")).collect()}       # at most dims + 1 rows
    total = counts.pop(-1, 0)
    if not total:
        return CentroidModel(dims=dims, idf=np.ones(dims, np.float32))
    df = np.zeros(dims)
    df[list(counts)] = list(counts.values())
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)

    def clusters(pdf: pd.DataFrame) -> pd.DataFrame:
        # one language's bounded sample
        pdf = pdf.sort_values("v")
        x = tfidf(np.stack([_unpack(v, dims) for v in pdf["v"]]), idf)
        c, own = _cluster(x, centroids, rounds)
        cos = (x * c[own]).sum(axis=1)
        radius = float(np.quantile(cos, quantile) * slack)
        out = [(pdf["lang"].iloc[0], j, c[j].astype(np.float32).tobytes(), radius)
               for j in range(len(c)) if (own == j).any()]
        return pd.DataFrame(out, columns=["lang", "j", "c", "radius"])

    got = vec.groupBy("lang").applyInPandas(clusters, "lang string, j int, c binary, radius double") \
        .collect()                                       # centroids per language: a few rows each
    got.sort(key=lambda r: (r["lang"], r["j"]))
    return CentroidModel(langs=[r["lang"] for r in got],
                         centroids=np.stack([np.frombuffer(bytes(r["c"]), np.float32) for r in got]),
                         radius=np.array([r["radius"] for r in got], np.float32), idf=idf, dims=dims)


def identify(docs: DataFrame, model: CentroidModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (Arrow batches, no shuffle)."""
    base = docs.drop(*[c for c in ("lang_pred", "score", "rejected") if c != text])
    if text in ("lang_pred", "score", "rejected"):
        raise ValueError(f"the text column must not be named {text}")
    schema = T.StructType(list(base.schema.fields)).add("lang_pred", "string") \
        .add("score", "double").add("rejected", "boolean")
    spec = base.sparkSession.sparkContext.broadcast(model)     # bounded: languages x centroids x dims
    at = base.columns.index(text)

    def run(batches):
        m = spec.value
        for b in batches:
            lang, score, rejected = m.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected, pa.bool_())], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return base.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string")) % parts == part
