"""Language-model scoring with a log-frequency Bloom filter (op 4).

Tokens are words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end per
text.  The texts are packed into chunks of bounded size, written once.  Every
chunk's distinct uni- and bigrams, with their counts in training texts, are
dealt by hash block and merged, block by block; with a block's counts come the
replies to its chunks: for each n-gram the chunk sent, the count (unigrams) or
the level (bigrams).  An n-gram with count c >= ``min_count`` gets the level
``1 + floor(log_b(c / min_count))`` and is put into the filter once per level
up to its own; a probe walks up the levels until one is missing, which bounds
the count within a factor b.  The filter is broadcast.  Its size is bounded by
``max_bytes``: where the n-grams need more, those of the lowest levels stay out
of it.  A chunk is scored beside its replies: an n-gram for which the filter
holds no count takes the level in them, if that is one of those left out.
So a bounded filter gives the scores of one with room for all n-grams, but for
its false positives.

    P(w | h) = weight * c(h w) / c(h) + (1 - weight) * (c(w) + 0.1) / (N + 0.1 (V + 1))

with every c read from the filter or, where left out of it, from the replies.
The exact unigram score (``base_score``) is kept apart: its counts are those in
the replies.

Defined results for odd input
- null or empty text: one token, the end
- null id: not held out, learned from; repeated rows: each scored
- no training text: N and V are 0, nothing is known
- empty table: an empty result;  ties: none
- very long texts: whole, one to a chunk
- extra columns: not returned by ``score``
- n-grams are told apart by 64 bits (unigrams) and 48 bits within a block
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import words as W
from parley.llm.scratch import keep

MAX_FILTER_BYTES = 32_000_000
BITS_PER_KEY = 10
PROBES = 6
LEVEL_BASE = 1.5
MIN_BIGRAM = 2              # bigrams seen once are not kept, at any size
WEIGHT = 0.3
DOCS_PER_BLOCK = 4_000
MAX_BLOCK_BITS = 16         # a bigram's key holds its block above 48 bits
CHUNK_BYTES = 6_000_000     # text a task combines at once
CHUNK_ROWS = 100_000
FEW = 256                   # numbers that are not compressed
FIRST = 255                 # in place of the level of the token before a text's first

END = np.uint64(0x5A5A17E9C3D4B2F1)
BEGIN = np.uint64(0x1B873593CC9E2D51)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW48 = np.uint64((1 << 48) - 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def tokens(raw, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of the texts, each followed by its end; tokens per text)."""
    h, n = W.word_hashes(raw, starts, ends, lower=True)
    out = np.empty(len(h) + len(n), np.uint64)
    at = np.cumsum(n + 1) - 1
    inside = np.ones(len(out), bool)
    inside[at] = False
    out[inside] = h
    out[at] = END
    return out, n + 1


def bigrams(tok: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with the one before it, that history)."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[np.cumsum(n) - n] = BEGIN
    return W.mix64(before * _ODD + tok), before


def _block(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _keys(kind: int, h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes as they are told apart, in an order in which blocks are ranges: a bigram's
    block above its low 48 bits."""
    return h if kind == 1 else (_block(h, bits).astype(np.uint64) << np.uint64(48)) | (h & _LOW48)


def _key_blocks(kind: int, key: np.ndarray, bits: int) -> np.ndarray:
    return _block(key, bits) if kind == 1 else (key >> np.uint64(48)).astype(np.int64)


def _squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of equal weight, without high bytes that are all zero;
    compressed unless few (their number grows with chunks times blocks: they must be cheap)."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    if len(x) < FEW:
        return bytes([width]) + planes
    return bytes([width | 128]) + len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    width = data[0] & 127
    planes = data[1:]
    if data[0] & 128:
        planes = pa.decompress(data[9:], width * int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True)
    planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _pack(batches):
    """Arrow batches (id, learn, text) -> chunks of whole texts."""
    from pyspark import TaskContext
    at = TaskContext.get().partitionId() << 32
    ids, learn, texts, lengths = [], [], [], []

    def flush():
        nonlocal at
        at += 1
        flags, size, raw = np.concatenate(learn), np.concatenate(lengths), b"".join(texts)
        both = pa.concat_arrays(ids)
        out = pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([len(flags)], pa.int64()), pa.array([int(flags.sum())], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), both),
             pa.array([np.packbits(flags).tobytes()], pa.binary()), pa.array([_squeeze(size)], pa.binary()),
             pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())],
            names=["chunk", "n", "n_learn", "ids", "learn", "lengths", "text"])
        for x in (ids, learn, texts, lengths):
            x.clear()
        return out

    rows = held = 0
    for b in batches:
        raw, s, e = W.text_buffers(b.column(2))
        flags = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in W.slices(s, e):
            for k in range(i, j, CHUNK_ROWS):
                to = min(j, k + CHUNK_ROWS)
                ids.append(b.column(0).slice(k, to - k))
                learn.append(flags[k:to])
                texts.append(raw[s[k]:e[to - 1]].tobytes())
                lengths.append(e[k:to] - s[k:to])
                rows, held = rows + to - k, held + len(texts[-1])
                if held >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                    yield flush()
                    rows = held = 0
    if rows:
        yield flush()


def pack(docs: DataFrame, id_col: str | None = None, text: str = "text", learn: Column | None = None) -> DataFrame:
    """Chunks of the texts, kept: each with its rows' ids and which of them are learned from."""
    flag = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select((F.col(id_col) if id_col else F.lit(0)).alias("id"), flag.alias("learn"),
                       F.coalesce(text, F.lit("")).alias("text"))
    return keep(rows.mapInArrow(_pack, f"chunk long, n long, n_learn long, ids array<{rows.schema['id'].dataType.simpleString()}>, "
                                       "learn binary, lengths binary, text binary"), "lm-texts")


def _chunk_tokens(lengths: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of a chunk."""
    size = _unsqueeze(lengths).astype(np.int64)
    e = np.cumsum(size)
    s = e - size
    raw = np.frombuffer(pa.decompress(text, int(e[-1]), codec="zstd", asbytes=True), np.uint8)
    got = [tokens(raw, s[i:j], e[i:j]) for i, j in W.slices(s, e)]
    return np.concatenate([t for t, _ in got]), np.concatenate([n for _, n in got])


def _gather(bits: int):
    """Chunks (chunk, learn, lengths, text) -> per block and kind, its distinct n-grams
    (ascending keys, as gaps) and their counts in training texts."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                chunk, learn, lengths, text = (b.column(i)[r].as_py() for i in range(4))
                tok, n = _chunk_tokens(lengths, text)
                flags = np.repeat(np.unpackbits(np.frombuffer(learn, np.uint8))[:len(n)].astype(bool), n)
                for kind, h in ((1, tok), (2, bigrams(tok, n)[0])):
                    key = _keys(kind, h, bits)
                    known, times = np.unique(key[flags], return_counts=True)
                    u = np.unique(np.concatenate([known, np.unique(key[~flags])]))
                    c = np.zeros(len(u), np.int64)
                    c[np.searchsorted(u, known)] = times
                    edge = np.searchsorted(_key_blocks(kind, u, bits), np.arange((1 << bits) + 1))
                    blocks = np.flatnonzero(np.diff(edge))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(blocks), kind), pa.int32()), pa.array(blocks, pa.int64()),
                         pa.array(np.full(len(blocks), chunk), pa.int64()),
                         pa.array([_squeeze(np.diff(u[edge[x]:edge[x + 1]], prepend=np.uint64(0))) for x in blocks], pa.binary()),
                         pa.array([_squeeze(c[edge[x]:edge[x + 1]]) for x in blocks], pa.binary())],
                        names=["kind", "block", "chunk", "h", "c"])
    return run


def _merge(min_bigram: int, bits: int):
    """All n-grams of one block -> its merged counts (no chunk), and a reply to each chunk."""
    def run(key, table):
        kind, block = key[0].as_py(), key[1].as_py()
        hs = [np.cumsum(_unsqueeze(x.as_py()), dtype=np.uint64) for x in table.column("h")]
        cs = [_unsqueeze(x.as_py()).astype(np.int64) for x in table.column("c")]
        ends = np.cumsum([len(x) for x in hs])
        h, c = np.concatenate(hs), np.concatenate(cs)
        del hs, cs
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        new = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
        first = np.flatnonzero(new)
        h, c = sorted_h[first], np.add.reduceat(c[order], first)
        least = 1 if kind == 1 else min_bigram
        told = np.where(c >= least, c if kind == 1 else level_of(c, least), 0)
        reply = np.empty(len(order), np.int64)
        reply[order] = told[np.cumsum(new) - 1]
        h, c = h[c >= least], c[c >= least]
        if kind == 2:
            h = (h & _LOW48) | (np.uint64(block) << np.uint64(64 - bits) if bits else np.uint64(0))
        chunks = table.column("chunk").to_pylist()
        n = 1 + len(chunks)
        return pa.table({"kind": pa.array([kind] * n, pa.int32()), "block": pa.array([block] * n, pa.int64()),
                         "chunk": pa.array([None, *chunks], pa.int64()),
                         "h": pa.array([h.astype("<u8").tobytes()] + [None] * len(chunks), pa.binary()),
                         "c": pa.array([c.astype("<i8").tobytes()] + [_squeeze(reply[i:j]) for i, j in
                                                                       zip(np.concatenate([[0], ends[:-1]]), ends)], pa.binary())})
    return run


def _histogram(batches):
    for b in batches:
        for kind, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v, n = np.unique(np.frombuffer(c, "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), kind), pa.int32()), pa.array(v, pa.int64()), pa.array(n, pa.int64())],
                names=["kind", "c", "n"])


def level_of(c: np.ndarray, least: int, base: float = LEVEL_BASE) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(c, least) / least) / math.log(base) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray, least: int, base: float = LEVEL_BASE) -> np.ndarray:
    """The middle of the counts that share a level (0 for level 0)."""
    low = np.ceil(least * base ** (np.maximum(level, 1) - 1.0) - 1e-9)
    high = np.maximum(np.ceil(least * base ** np.maximum(level, 1).astype(float) - 1e-9) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


@dataclass
class Part:
    """One order's filter: a bitmap per block, all of ``size`` bits, with the levels
    (of counts from ``low`` on) from ``first`` to ``top``; ``least`` is the smallest
    count in it."""
    kind: int
    block_bits: int
    size: int
    least: int
    top: int
    low: int = 1
    first: int = 1
    data: bytes = b""

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Largest level present for each n-gram hash, by repeated probes."""
        out = np.zeros(len(h), np.int64)
        if not self.size or not self.top:
            return out
        bits = np.frombuffer(self.data, np.uint8)
        base = _block(h, self.block_bits) * self.size
        low = h & _LOW48
        todo = np.arange(len(h))
        for j in range(self.first, self.top + 1):
            for p in range(PROBES):
                at = base[todo] + probe(low[todo], j, p, self.size)
                todo = todo[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
            out[todo] = j
            if not len(todo):
                break
        return out


def probe(low: np.ndarray, level: int, p: int, size: int) -> np.ndarray:
    k = W.mix64(low * np.uint64(2 * level + 1) + np.uint64(level * int(_ODD) % 2**64))
    step = (k >> np.uint64(33)) | np.uint64(1)
    return (((k & np.uint64(0xFFFFFFFF)) + np.uint64(p) * step) % np.uint64(size)).astype(np.int64)


def _fill(kind_size: dict[int, int], least: dict[int, int], low: dict[int, int], first: dict[int, int]):
    """(kind, filter block, its packed counts) -> the block's bitmap."""
    def run(key, table):
        kind, block = key[0].as_py(), key[1].as_py()
        size = kind_size[kind]
        on = np.zeros(size, bool)
        for h, c in zip(table.column("h").to_pylist(), table.column("c").to_pylist()):
            c = np.frombuffer(c, "<i8")
            h = np.frombuffer(h, "<u8") & _LOW48
            h, c = h[c >= least[kind]], c[c >= least[kind]]
            lev = level_of(c, low[kind])
            for j in range(first[kind], int(lev.max(initial=0)) + 1):
                h, lev = h[lev >= j], lev[lev >= j]
                for p in range(PROBES):
                    on[probe(h, j, p, size)] = True
        return pa.table({"kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int64()),
                         "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})
    return run


def _fill_rows(fill):
    """``fill`` where every row is a filter block."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                one = pa.Table.from_batches([b.slice(r, 1)])
                yield from fill((one.column("kind")[0], one.column("block")[0]), one).to_batches()
    return run


@dataclass
class BloomModel:
    tokens: int
    types: int
    texts: int
    parts: dict[int, Part]
    weight: float = WEIGHT

    def level(self, kind: int, h: np.ndarray, told: np.ndarray) -> np.ndarray:
        """Levels of n-grams: the filter's or, where it holds none, that ``told`` of those
        left out of it."""
        p = self.parts[kind]
        out = p.levels(h)
        if p.first > 1:
            none = out == 0
            out[none] = np.where(told[none] < p.first, told[none], 0)
        return out

    def counts_of(self, kind: int) -> np.ndarray:
        """The count of every level; that of ``FIRST`` is the number of texts."""
        out = count_of(np.arange(FIRST + 1), self.parts[kind].low)
        out[FIRST] = self.texts
        return out

    def log10(self, l1: np.ndarray, lh: np.ndarray, l2: np.ndarray) -> np.ndarray:
        """log10 probability of every token after the one before it."""
        c1, ch, c2 = self.counts_of(1)[l1], self.counts_of(1)[lh], self.counts_of(2)[l2]
        follow = np.minimum(c2 / np.maximum(ch, np.maximum(c2, 1.0)), 1.0)
        single = (c1 + 0.1) / (self.tokens + 0.1 * (self.types + 1))
        return np.log10(self.weight * follow + (1 - self.weight) * np.minimum(single, 1.0))


def count_ngrams(chunks: DataFrame, min_bigram: int = MIN_BIGRAM,
                 docs_per_block: int = DOCS_PER_BLOCK) -> tuple[DataFrame, int, int, int]:
    """(merged packed counts and replies by kind and block, bits of a filter block, bits
    of a block, number of training texts)."""
    r = chunks.agg(F.sum("n_learn").alias("learn"), F.sum("n").alias("n")).first()
    n, rows = r["learn"] or 0, r["n"] or 0
    bits = min(MAX_BLOCK_BITS, max(0, math.ceil(math.log2(max(1, n / docs_per_block)))))
    # few training texts of many: smaller blocks, each part of a filter block
    deal = min(MAX_BLOCK_BITS, max(bits, math.ceil(math.log2(max(1, rows / docs_per_block))) - 1))
    sent = chunks.select("chunk", "learn", "lengths", "text") \
        .mapInArrow(_gather(deal), "kind int, block long, chunk long, h binary, c binary")
    merged = sent.groupBy("kind", "block").applyInArrow(
        _merge(min_bigram, deal), "kind int, block long, chunk long, h binary, c binary")
    return keep(merged, "ngram-counts"), bits, deal, n


def fit(train: DataFrame, text: str = "text", **options) -> tuple[BloomModel, DataFrame, dict[int, dict[int, int]]]:
    """(model, merged counts, histogram of counts by kind)."""
    model, merged, hist, _ = fit_chunks(pack(train, text=text), **options)
    return model, merged.where("chunk is null").drop("chunk"), hist


def fit_chunks(chunks: DataFrame, *, max_bytes: int = MAX_FILTER_BYTES, bits_per_key: int = BITS_PER_KEY,
               min_bigram: int = MIN_BIGRAM, weight: float = WEIGHT, docs_per_block: int = DOCS_PER_BLOCK,
               ) -> tuple[BloomModel, DataFrame, dict[int, dict[int, int]], int]:
    """(model, merged counts and replies, histogram of counts by kind, bits of a block)."""
    merged, bits, deal, n = count_ngrams(chunks, min_bigram, docs_per_block)
    counts = merged.where("chunk is null").select("kind", "block", "h", "c")
    hist: dict[int, dict[int, int]] = {1: {}, 2: {}}
    # one row per distinct count value: grows like the square root of the tokens
    for r in counts.select("kind", "c").mapInArrow(_histogram, "kind int, c long, n long") \
            .groupBy("kind", "c").agg(F.sum("n").alias("n")).collect():
        hist[r["kind"]][r["c"]] = r["n"]
    size, least, top, low, first = {}, {}, {}, {1: 1, 2: min_bigram}, {1: 1, 2: 1}
    for kind in (1, 2):
        c = np.array(sorted(hist[kind]), np.int64)
        m = np.array([hist[kind][int(x)] for x in c], np.int64)
        lev = level_of(c, low[kind])
        while True:
            ok = lev >= first[kind]
            keys = int(((lev[ok] - first[kind] + 1) * m[ok]).sum())
            per_block = -(-int(keys * bits_per_key * 1.05) // (1 << bits))
            per_block = max(64, -(-per_block // 8) * 8) if keys else 0
            if per_block * (1 << bits) // 8 <= max_bytes // 2 or not keys:
                break
            first[kind] += 1                            # the level below is left to the replies
        size[kind], top[kind] = per_block, int(lev[ok].max(initial=0))
        least[kind] = int(c[ok].min(initial=1 + int(c.max(initial=0)))) if first[kind] > 1 else low[kind]
    parts = {k: Part(k, bits, size[k], least[k], top[k], low[k], first[k], bytes(size[k] // 8 << bits)) for k in (1, 2)}
    data = {k: bytearray(p.data) for k, p in parts.items()}
    fill, schema = _fill(size, least, low, first), "kind int, block long, bits binary"
    blocks = counts.mapInArrow(_fill_rows(fill), schema) if deal == bits else \
        counts.withColumn("block", F.shiftright("block", deal - bits)).groupBy("kind", "block").applyInArrow(fill, schema)
    for r in blocks.collect():
        step = size[r["kind"]] // 8                     # all rows together: at most max_bytes
        data[r["kind"]][r["block"] * step:(r["block"] + 1) * step] = r["bits"]
    for k, p in parts.items():
        p.data = bytes(data[k])
    model = BloomModel(sum(c * m for c, m in hist[1].items()), sum(hist[1].values()), n, parts, weight)
    return model, merged, hist, deal


def _score(known, bits: int):
    """A chunk and its replies -> its rows' scores."""
    def run(chunk, replies):
        m = known.value
        tok, n = _chunk_tokens(chunk.column("lengths")[0].as_py(), chunk.column("text")[0].as_py())
        start = np.cumsum(n) - n
        told = {1: [], 2: []}
        for kind, _, c in sorted(zip(*(replies.column(x).to_pylist() for x in ("kind", "block", "c")))):
            told[kind].append(_unsqueeze(c).astype(np.int64))
        u, back = np.unique(tok, return_inverse=True)
        c = np.concatenate(told[1])
        l1 = m.level(1, u, np.where(c > 0, level_of(c, m.parts[1].low), 0))[back]
        logs, c = np.where(c > 0, np.log10(c + 0.1), -1.0)[back], c[back]
        lh = np.empty_like(l1)
        lh[1:] = l1[:-1]
        lh[start] = FIRST
        u, back = np.unique(_keys(2, bigrams(tok, n)[0], bits), return_inverse=True)
        h = (u & _LOW48) | ((u >> np.uint64(48)) << np.uint64(64 - bits) if bits else np.uint64(0))
        l2 = m.level(2, h, np.concatenate(told[2]) if told[2] else np.zeros(len(u), np.int64))[back]
        return pa.table({
            "id": chunk.column("ids").combine_chunks().flatten(), "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), start), pa.int64()),
            "logs": pa.array(np.add.reduceat(logs, start), pa.float64()),
            "score": pa.array(np.add.reduceat(m.log10(l1, lh, l2), start), pa.float64())})
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, learn: Column | None = None,
          hot_types: int | None = None, **options) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row; the
    model is learned from the rows where ``learn`` holds (all by default).
    ``hot_types`` (types whose counts were broadcast) has no effect any more: every
    chunk gets its counts with the replies."""
    chunks = pack(docs, id_col, text, learn)
    model, merged, _, bits = fit_chunks(chunks, **options)
    known = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [1, 2] if model.parts[2].first > 1 else [1]
    replies = merged.where(F.col("chunk").isNotNull() & F.col("kind").isin(kinds)).select("chunk", "kind", "block", "c")
    part = chunks.select("chunk", "ids", "lengths", "text").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _score(known, bits), f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, "
                             "logs double, score double")
    norm = math.log10(model.tokens + 0.1 * (model.types + 1))
    return part.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                       (F.col("logs") - F.col("n_tokens") * norm).alias("base_score"), "score")
