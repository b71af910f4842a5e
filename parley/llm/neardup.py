"""Near-duplicate groups by Order MinHash and banded alignment (op 7).

A text is a sequence of words.  Its k-word shingles (k = 2) are labelled with
their occurrence number; each of ``bands`` random orders selects the ``keep``
smallest labelled shingles, and these, in text order, form the band's key.  At
similarity 0.8 by scattered substitutions 0.64 of the shingles stay, a band's key
agrees with a chance of about 0.22 and one of 32 with 0.9997 (0.9985 if every
fifth word is replaced).  A short text has too few shingles for that; up to
``SHORT`` of them it has the keys of single minima as well.
Texts that share a key are candidates; a candidate pair is verified by a banded
alignment of the two word sequences: edit similarity
``1 - edits / max(words)`` of at least ``similarity`` (0.8).  Groups are the
connected components of verified pairs.

Texts with equal word sequences are one node from the start.  In a bucket
every text is compared with the bucket's centre (the text that shares the most
keys with others).  A bucket whose texts are not all in one group by then stays
open, with all its texts, and is gone through once more: two of its texts in
different groups are compared if lengths allow and they share a word among the
rarest fifth of each (with fewer than four fifths of the words in common none of that fifth need
be shared, and a passage that all texts of the bucket hold is not rare in it),
and if they have enough words in common.  So no pair of a bucket that could be
similar is left out, and a common passage alone makes no pair.

Defined results for odd input
- null, empty or blank text: all of them count as equal (no words)
- null id: the row is returned with class null and takes no part
- repeated rows and ids: each row is returned; an id is one document
- ties: the centre and the class are the smallest id
- fewer than five words: no edit is within the similarity, so such a text only
  joins texts with the same words
- empty table: an empty result
- extra columns: not returned by ``near_duplicates``; ``drop_duplicates`` keeps
  every column of its input
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import words as W
from parley.llm.scratch import keep

SHINGLE = 2
BANDS = 32
KEEP = 2                    # shingles retained per band
SHORT = 24                  # shingles up to which a text has keys of single minima too
SIMILARITY = 0.8
BLOCK = 500                 # texts of an open bucket in a block; two blocks are one piece of work
BLOCK_WORDS = 400_000       # words in a block, about
CLASSES = 512               # classes of words in a text's signature
FULL = 15                   # count of a class from which it is not told how many
COARSE = 2_048              # words up to which a text's words are compared by 16 bits of their hashes
BROADCAST_IDS = 2_000_000   # id lists up to this (counted) length are broadcast

_RNG = np.random.default_rng(20240607)
_ODD = _RNG.integers(1, 2**63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS = np.uint64(0x9E3779B97F4A7C15)


def labelled_shingles(h: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled shingle hashes in text order, shingles per text)."""
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not int(n.sum()):
        return np.zeros(0, np.uint64), n
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[doc]
    room = ends[doc] - at                       # words from here to the end of the text
    sh = np.zeros(len(at), np.uint64)
    last = len(h) - 1
    for j in range(k):
        w = h[np.minimum(at + j, last)] * _ODD[j]
        sh += np.where(room > j, W.mix64(w + np.uint64(j + 1)), np.uint64(0))
    sh = W.mix64(sh)
    own = W.mix64(sh ^ (doc.astype(np.uint64) * _POS))
    order = np.argsort(own, kind="stable")
    s = own[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    run = np.flatnonzero(first)
    occ = np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))
    label = np.empty(len(s), np.uint64)
    label[order] = occ.astype(np.uint64)
    return W.mix64(sh + label * _POS), n


def order_keys(x: np.ndarray, bands: int, kept: int) -> np.ndarray:
    """One key per band: the ``kept`` smallest labelled shingles in text order."""
    salt = np.arange(1, bands + 1, dtype=np.uint64) * _POS
    if len(x) <= kept:
        key = salt.copy()
        for v in x:
            key = W.mix64(key * np.uint64(3) + v)
        return key
    out = np.empty(bands, np.uint64)
    step = max(1, 2_000_000 // len(x))          # bounded memory for very long texts
    for b in range(0, bands, step):
        v = x[None, :] * _ODD[64 + b:64 + min(bands, b + step), None]
        v ^= v >> np.uint64(29)
        if kept == 2:
            rows = np.arange(len(v))
            i = v.argmin(axis=1)
            v[rows, i] = np.uint64(2**64 - 1)
            j = v.argmin(axis=1)
            at = np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1)
        else:
            at = np.sort(np.argpartition(v, kept - 1, axis=1)[:, :kept], axis=1)
        key = salt[b:b + len(v)].copy()
        for c in range(at.shape[1]):
            key = W.mix64(key * np.uint64(3) + x[at[:, c]])
        out[b:b + len(v)] = key
    return out


def text_keys(x: np.ndarray, bands: int, kept: int) -> np.ndarray:
    """All keys of a text; none if it is a single shingle."""
    if len(x) < 2:
        return np.zeros(0, np.uint64)
    keys = order_keys(x, bands, kept)
    return np.concatenate([keys, order_keys(x, bands, 1)]) if len(x) <= SHORT and kept > 1 else keys


def _digests(h: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128-bit digest of each word sequence."""
    n = len(counts)
    starts = np.cumsum(counts) - counts
    pos = (np.arange(len(h)) - np.repeat(starts, counts)).astype(np.uint64)
    out = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        for c, odd in enumerate((_ODD[8], _ODD[9])):
            v = W.mix64((h + np.uint64(c)) * odd + W.mix64(pos * _POS + odd))
            out[full, c] = np.add.reduceat(v, starts[full])
    out[:, 1] += counts.astype(np.uint64)
    return [r.tobytes() for r in out]


def signatures(h: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The words of each text counted by class, up to ``FULL``, two classes to a byte."""
    out = []
    for q, m in zip(np.cumsum(counts).tolist(), counts.tolist()):
        c = np.bincount((h[q - m:q] >> np.uint64(32)).astype(np.int64) % CLASSES, minlength=CLASSES)
        c = np.minimum(c, FULL).astype(np.uint8)
        out.append((c[0::2] | (c[1::2] << 4)).tobytes())
    return out


def _classes(signs: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1)
    return np.concatenate([packed & 15, packed >> 4], axis=1)


def may_share(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Row by row: the class counts allow ``need`` words in common."""
    least = np.minimum(x, y)
    return (least.sum(axis=1, dtype=np.int64) >= need) | (least == FULL).any(axis=1)


def words_needed(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    longest = np.maximum(a, b)
    return longest - np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)


def sketch_batches(bands: int, kept: int, shingle: int):
    """Arrow batches (id, text) -> (id, digest, keys, number of words, signature)."""
    def run(batches):
        for b in batches:
            raw, s, e = W.text_buffers(b.column(1))
            for i, j in W.slices(s, e):
                h, c = W.word_hashes(raw, s[i:j], e[i:j])
                x, n = labelled_shingles(h, c, shingle)
                ends = np.cumsum(n)
                keys = [text_keys(x[q - m:q], bands, kept) for q, m in zip(ends.tolist(), n.tolist())]
                flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(_digests(h, c), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64))), pa.array(c.astype(np.int64)),
                    pa.array(signatures(h, c), pa.binary())], names=["id", "digest", "keys", "len", "sign"])
    return run


def word_batches(batches):
    """Arrow batches (node, text) -> (node, words as packed 32-bit hashes)."""
    for b in batches:
        raw, s, e = W.text_buffers(b.column(1))
        for i, j in W.slices(s, e):
            h, c = W.word_hashes(raw, s[i:j], e[i:j])
            h32 = (h >> np.uint64(32)).astype(np.uint32)
            ends = np.cumsum(c)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i),
                 pa.array([h32[q - m:q].tobytes() for q, m in zip(ends.tolist(), c.tolist())], pa.binary())],
                names=["node", "words"])


def sign_batches(batches):
    """Arrow batches (node, text) -> (node, number of words, signature)."""
    for b in batches:
        raw, s, e = W.text_buffers(b.column(1))
        for i, j in W.slices(s, e):
            h, c = W.word_hashes(raw, s[i:j], e[i:j])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(c.astype(np.int64)), pa.array(signatures(h, c), pa.binary())],
                names=["node", "len", "sign"])


def bag_batches(batches):
    """Arrow batches (node, text) -> (node, its words' hashes, sorted and packed:
    32 bits each, 16 for texts of up to ``COARSE`` words)."""
    for b in word_batches(batches):
        bags = []
        for w in b.column(1).to_pylist():
            h = np.frombuffer(w, np.uint32)
            bags.append((np.sort(h) if len(h) > COARSE else np.sort(h >> 16).astype(np.uint16)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.binary())], names=["node", "bag"])


def banded_edits(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Word edits that turn ``a`` into ``b`` if at most ``limit``, else None.

    Only diagonals within ``limit`` of the main one are followed; on each the
    furthest row reached with 0, 1, 2 .. edits is kept.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    la, lb = a.tolist(), b.tolist()

    def slide(i: int, k: int) -> int:
        j = i + k
        stop = min(n, m - k, i + 8)
        while i < stop and la[i] == lb[j]:
            i += 1
            j += 1
        if i < stop or i >= min(n, m - k):
            return i
        step = 64
        while i < n and j < m:
            u, v = a[i:i + step], b[j:j + step]
            q = min(len(u), len(v))
            diff = u[:q] != v[:q]
            hit = int(diff.argmax())
            if diff[hit]:
                return i + hit
            i += q
            j += q
            step *= 4
        return i

    goal = m - n
    reach = {0: slide(0, 0)}
    if goal == 0 and reach[0] >= n:
        return 0
    for d in range(1, limit + 1):
        new = {}
        room = limit - d
        for k in range(max(-d, goal - room, -n), min(d, goal + room, m) + 1):
            best = -1
            x = reach.get(k)
            if x is not None:
                best = x + 1
            x = reach.get(k - 1)
            if x is not None and x > best:
                best = x
            x = reach.get(k + 1)
            if x is not None and x + 1 > best:
                best = x + 1
            if best < 0:
                continue
            best = min(best, n, m - k)
            if best < 0 or best + k < 0:
                continue
            new[k] = slide(best, k)
        if new.get(goal, -1) >= n:
            return d
        reach = new
    return None


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    longest = max(len(a), len(b))
    if longest == 0:
        return True
    limit = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    # words in common, order aside: a cheap upper bound of the matches
    if longest > 64:
        u, cu = np.unique(a, return_counts=True)
        v, cv = np.unique(b, return_counts=True)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        common = int(np.minimum(cu[i], cv[j]).sum())
    else:
        common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
    if longest - common > limit:
        return False
    return banded_edits(a, b, limit) is not None


def _verify(pairs: DataFrame, words: DataFrame, similarity: float, name: str) -> DataFrame:
    """Pairs (a, b) with ``ok``; a node in many pairs is split by AQE's skew join."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def run(batches):
        for t in batches:
            ok = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity)
                  for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(ok, pa.bool_())],
                                             names=["a", "b", "ok"])

    return keep(both.mapInArrow(run, "a long, b long, ok boolean"), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component.

    Alternating large-star and small-star steps; every step is a grouped
    minimum (combined before the shuffle) and a join, its result a table.  Done when
    every node points to one that points nowhere.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .where("u != v").distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        # large star: every neighbour above u points to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e1 = keep(both.where("v > u").join(low, "u").where("v != m")
                  .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        # small star: u and its neighbours below u point to the smallest of them
        low1 = e1.groupBy("u").agg(F.min("v").alias("m"))
        e = keep(e1.join(low1, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u != v").select("u", "v")
                 .unionByName(low1.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # one row per node that points somewhere; a row more if it points to a second node or is pointed to
        bad = e.select("u", F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct()) \
            .groupBy("u").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0 AND rows > 1")
        if bad.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _ids_join(docs: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """``docs`` semi/anti join an id list, broadcast if its count is small."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, on, how)


def _comparable(a: str, b: str, similarity: float) -> str:
    """SQL: lengths ``a`` and ``b`` allow the similarity."""
    longest = f"greatest({a}, {b})"
    return f"least({a}, {b}) >= {longest} - floor({1 - similarity!r}D * {longest} + 1e-9D)"


def _tokens(bag: bytes, length: int, coarse: bool) -> np.ndarray:
    """Distinct tokens of a sorted bag: a word's hash and its occurrence."""
    if length <= COARSE:
        h = np.frombuffer(bag, np.uint16).astype(np.uint64)
    else:
        h = np.frombuffer(bag, np.uint32).astype(np.uint64)
        h = h >> np.uint64(16) if coarse else h
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    run = np.flatnonzero(first)
    occ = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    return (h << np.uint64(32)) | occ.astype(np.uint64)


def unit_pairs(key: int, crossed: bool, block: np.ndarray, node: np.ndarray, label: np.ndarray, length: np.ndarray,
               keys: list, bags: list, similarity: float) -> list[tuple[int, int]]:
    """Pairs of different labels that can be similar, in one piece of an open bucket;
    of different blocks if ``crossed``, and only those whose smallest common open
    key is ``key`` (the pair's other buckets leave it to this one)."""
    values, counts = np.unique(label, return_counts=True)
    home = values[counts.argmax()]
    others = np.flatnonzero(label != home)
    if not len(others):
        return []
    coarse = bool((length <= COARSE).any())
    tokens = [_tokens(b, n, coarse) for b, n in zip(bags, length.tolist())]
    size = np.array([len(t) for t in tokens])
    at = np.concatenate([[0], np.cumsum(size)])
    _, word, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(node)), size)
    order = np.lexsort((word, often[word], owner))              # each text's words, the rarest of this bucket first
    place = np.arange(len(order)) - np.repeat(at[:-1], size)
    rare = (place <= np.floor((1 - similarity) * length + 1e-9)[owner]) & (often[word[order]] > 1)
    rare_word, rare_owner = word[order][rare], owner[rare]
    by_word = np.argsort(rare_word, kind="stable")
    texts = rare_owner[by_word]
    begin = np.searchsorted(rare_word[by_word], np.arange(len(often) + 1))
    own = np.searchsorted(rare_owner, np.arange(len(node) + 1))
    has = np.zeros(len(often), bool)
    out = []
    for o in others.tolist():
        lists = [texts[begin[w]:begin[w + 1]] for w in rare_word[own[o]:own[o + 1]]]
        if not lists:
            continue
        c = np.unique(np.concatenate(lists))
        need = words_needed(length[c], length[o], similarity)
        fine = (label[c] != label[o]) & (np.minimum(length[c], length[o]) >= need) & ((label[c] == home) | (c > o))
        if crossed:
            fine &= block[c] != block[o]
        c, need = c[fine], need[fine]
        if not len(c):
            continue
        has[word[at[o]:at[o + 1]]] = True
        mine = set(keys[o])
        for x, n in zip(c.tolist(), need.tolist()):
            if int(np.count_nonzero(has[word[at[x]:at[x + 1]]])) >= n and min(mine.intersection(keys[x])) == key:
                out.append((min(int(node[o]), int(node[x])), max(int(node[o]), int(node[x]))))
        has[word[at[o]:at[o + 1]]] = False
    return out


def with_partner(crossed: bool, block: np.ndarray, label: np.ndarray, length: np.ndarray, signs: list[bytes],
                 similarity: float) -> np.ndarray:
    """Which texts of a piece of an open bucket have another one that lengths and
    signatures allow to be similar."""
    counts, has = _classes(signs), np.zeros(len(label), bool)
    for o in range(len(label)):
        c = np.arange(o + 1, len(label))
        c = c[(label[c] != label[o]) & ~(has[c] & has[o])]
        if crossed:
            c = c[block[c] != block[o]]
        need = words_needed(length[c], length[o], similarity)
        fine = np.minimum(length[c], length[o]) >= need
        c, need = c[fine], need[fine]
        if len(c) and (fine := may_share(counts[c], counts[o][None, :], need)).any():
            has[o] = True
            has[c[fine]] = True
    return has


def _units(batches):
    """((key, i, j), rows) of batches sorted by key, i and j."""
    now, rows = None, []
    for b in batches:
        for key, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (key, i, j) != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = (key, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield now, rows


def partner_batches(similarity: float):
    """Arrow batches (key, i, j, block, node, label, len, sign), sorted by key, i and j ->
    the rows of texts that have a possible partner there, without the signature."""
    def run(batches):
        for (key, i, j), rows in _units(batches):
            block, node, label, length = (np.array([r[c] for r in rows], np.int64) for c in range(4))
            has = with_partner(i != j, block, label, length, [r[4] for r in rows], similarity)
            n = int(has.sum())
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, j, np.int32)),
                     pa.array(block[has].astype(np.int32)), pa.array(node[has]), pa.array(label[has]), pa.array(length[has])],
                    names=["key", "i", "j", "block", "node", "label", "len"])
    return run


def unit_batches(similarity: float):
    """Arrow batches (key, i, j, block, node, label, len, keys, bag), sorted by key, i and
    j -> pairs (a, b) to verify."""
    def run(batches):
        for (key, i, j), rows in _units(batches):
            block, node, label, length = (np.array([r[c] for r in rows], np.int64) for c in range(4))
            got = unit_pairs(key, i != j, block, node, label, length, [r[4] for r in rows], [r[5] for r in rows], similarity)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()),
                                                  pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])
    return run


def _open_pairs(open_: DataFrame, docs: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """Pairs to verify in the open buckets ``open_`` (key, node, label, len): texts
    without a possible partner by signature go first, the others' words are compared."""
    blocks = open_.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK),
                                                 F.ceil(F.sum("len") / BLOCK_WORDS), F.lit(1)).cast("int").alias("blocks"))
    # block i and block j of a bucket are one piece of work, i and i another
    i = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = open_.join(blocks, "key").withColumn("block", i) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node",
                "label", "len")
    unit = "key long, i int, j int, block int, node long, label long, len long"
    left = keep(dealt.join(signs.select("node", "sign"), "node")
                .select("key", "i", "j", "block", "node", "label", "len", "sign")
                .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                .mapInArrow(partner_batches(similarity), unit), "open-rows")
    own = left.groupBy("node").agg(F.collect_set("key").alias("keys"))            # at most the keys of a text
    bags = _ids_join(docs, left.select("node").distinct(), "node", "left_semi").select("node", "text") \
        .mapInArrow(bag_batches, "node long, bag binary")
    return left.join(own, "node").join(bags, "node") \
        .select("key", "i", "j", "block", "node", "label", "len", "keys", "bag") \
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j") \
        .mapInArrow(unit_batches(similarity), "a long, b long")


def _by_signature(pairs: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that signatures allow to be similar."""
    left = signs.select(F.col("node").alias("a"), F.col("len").alias("la"), F.col("sign").alias("sa"))
    right = signs.select(F.col("node").alias("b"), F.col("len").alias("lb"), F.col("sign").alias("sb"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                need = words_needed(t.column(2).to_numpy(), t.column(3).to_numpy(), similarity)
                ok = may_share(_classes(t.column(4).to_pylist()), _classes(t.column(5).to_pylist()), need)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb", "sa", "sb") \
        .mapInArrow(run, "a long, b long")


def _open_runs(member: DataFrame, label: DataFrame, size: DataFrame, centre: DataFrame, similarity: float) -> DataFrame:
    """(key, node, label, len): what is left to compare.  The texts of a bucket, in order
    of length, are cut where two neighbours' lengths rule the similarity out; each
    run is a bucket of its own, if it has texts of several groups and is not one
    pair that its centre has made."""
    rows = member.where("n > 2").select("key", "node").join(label, "node", "left").join(size, "node") \
        .select("key", "node", F.coalesce("label", "node").alias("label"), "len")
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    by_length = Window.partitionBy("key").orderBy("len", "node")
    before = F.lag("len").over(by_length)
    cut = rows.join(mixed, "key").withColumn("before", before) \
        .withColumn("cut", (~F.coalesce(F.expr(_comparable("before", "len", similarity)), F.lit(False))).cast("int")) \
        .withColumn("run", F.sum("cut").over(by_length.rowsBetween(Window.unboundedPreceding, 0)))
    cut = keep(cut.select("key", "run", "node", "label", "len"), "runs")
    runs = cut.join(centre.select("key", F.col("c.node").alias("c")), "key").groupBy("key", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.max(F.col("node") == F.col("c")).alias("met")).where("lo != hi AND NOT (n = 2 AND met)").select("key", "run")
    return keep(cut.join(runs, ["key", "run"]).select(F.xxhash64("key", "run").alias("key"), "node", "label", "len"), "open")


def link(nodes: DataFrame, docs: DataFrame, signs: DataFrame | None = None, *, similarity: float) -> DataFrame:
    """Verified pairs (a, b) among ``nodes`` (node, keys) that connect all similar nodes of
    a bucket; ``docs`` is (node, text), ``signs`` (node, len, sign) if it is known."""
    if signs is None:
        signs = keep(docs.select("node", "text").mapInArrow(sign_batches, "node long, len long, sign binary"), "signs")
    entry = nodes.select(F.explode("keys").alias("key"), "node")
    multi = keep(entry.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    member = keep(entry.join(multi, "key"), "members")
    rank = member.groupBy("node").agg(F.sum("n").alias("pop"))
    rank = keep(rank.join(signs.select("node", "len"), "node"), "popularity")
    ranked = member.select("key", "node").join(rank, "node")
    centre = keep(ranked.groupBy("key").agg(
        F.max_by(F.struct("node", "len"), F.struct(F.col("pop"), -F.col("node"))).alias("c")), "centres")
    pairs = ranked.join(centre, "key").where("node != c.node").where(_comparable("len", "c.len", similarity)) \
        .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
    pairs = keep(_by_signature(pairs, signs, similarity), "pairs")
    first = _verified(pairs, docs, similarity, "checked")
    label = components(first)
    # a bucket of two has met its only pair
    open_ = _open_runs(member, label, rank.select("node", "len"), centre, similarity)
    if open_.isEmpty():
        return first
    pairs = keep(_open_pairs(open_, docs, signs, similarity), "open-pairs")
    return first.unionByName(_verified(pairs, docs, similarity, "checked-open"))


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float, name: str) -> DataFrame:
    """The similar ones of ``pairs`` (a, b); only texts that occur in a pair are read as words."""
    ids = keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{name}-ids")
    words = keep(_ids_join(docs, ids, "node", "left_semi").select("node", "text")
                 .mapInArrow(word_batches, "node long, words binary"), f"{name}-words")
    return _verify(pairs, words, similarity, name).where("ok").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, bands: int = BANDS,
                    kept: int = KEEP, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id): one row per row of ``docs``; the class is its smallest id."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sk = keep(base.where("id IS NOT NULL").mapInArrow(sketch_batches(bands, kept, shingle),
                                                      "id long, digest binary, keys array<long>, len long, sign binary"),
              "sketch")
    nodes = keep(sk.groupBy("digest").agg(F.min("id").alias("node"), F.min_by(F.struct("keys", "len", "sign"), "id").alias("x"))
                 .select("digest", "node", "x.*"), "nodes")
    edges = link(nodes.select("node", "keys"), base.select(F.col("id").alias("node"), "text"),
                 nodes.select("node", "len", "sign"), similarity=similarity)
    label = components(edges)
    by_digest = keep(nodes.select("digest", "node").join(label, "node", "left")
                     .select("digest", F.coalesce("label", "node").alias("class_id")), "classes")
    out = sk.select("id", "digest").join(by_digest, "digest").select("id", "class_id")
    lost = base.where("id IS NULL").select("id", F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(lost).withColumnRenamed("id", id_col)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group: the one with the smallest id (rows with a
    null id stay; of rows that repeat an id one stays)."""
    found = keep(near_duplicates(docs, id_col, text, **options), "near-duplicates")
    gone = found.where(f"{id_col} != class_id").select(id_col).distinct()
    out = _ids_join(docs, gone, id_col, "left_anti")
    twice = keep(found.where(f"{id_col} IS NOT NULL").groupBy(id_col).count().where("count > 1")
                 .select(id_col), "repeated-ids")
    if twice.isEmpty():
        return out
    again = _ids_join(out, twice, id_col, "left_semi").dropDuplicates([id_col])
    return _ids_join(out, twice, id_col, "left_anti").unionByName(again)
