"""Benchmark decontamination with a generalised suffix automaton (op 13).

The words of all test items make one suffix automaton per bounded block of
items.  A document's words are streamed through it, which gives at every word the
length of the longest item passage that ends there: where it reaches ``window``,
the last ``window`` words are an item window, and a state's item list names the
items that hold it.  An item shorter than that is one window, found as the state
that ends it.  Words inside windows are hit; ``clean`` cuts the spans of hit words
out and drops the documents they cover too much of.

A word unknown to the items, or a pair of words that no item has in a row, ends
every match, so only runs of known pairs are streamed; they are found by word
hashes in whole Arrow batches and the automaton then compares the words
themselves, so equal hashes never make a match.

Blocks: a block holds about ``block_words`` item words and is broadcast; items longer
than that are cut into passages that overlap by a window less one word.  A
further block is a further pass over the documents, whose rows carry the spans
found so far; one block is the usual case and needs no shuffle of documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined results for odd input
- null or empty text: no words, nothing hit;  item without a word: takes no part
- null item id: named by the empty string;  repeated items: one name each
- repeated rows and ids of documents: every row gets its own, equal, result
- empty tables: an empty result, or documents without hits
- extra columns: kept by ``scan``, unless they clash with an output column, which
  replaces them
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.scratch import keep
from parley.llm.words import mix64, slices, text_buffers

WINDOW = 10
BLOCK_WORDS = 200_000
MAX_COVERAGE = 0.5       # `clean` drops a document of which more is hit
MAX_SPAN = 200           # ... or one with a longer hit span
SPACES = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = ["n_words", "n_hit", "longest", "spans", "items"]
_FOUND_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("longest", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField(c, T.LongType()) for c in ("first_word", "n", "start", "end")]))),
    T.StructField("items", T.ArrayType(T.StringType()))])

_CODE = np.arange(256, dtype=np.uint8)
_CODE[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_SALT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SALT[~_IS_WORD] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: Column) -> Column:
    """Normalised words of a text."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SPACES), "")


# --- the automaton of a block of items ---------------------------------------------

class Automaton:
    """Generalised suffix automaton of word sequences, with the items of every
    ``window``-word passage and of every shorter whole item."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: dict[int, set[str]] = {}      # window states
        self.whole: dict[int, set[str]] = {}      # states that end a short item
        self.last: list[int] = []                 # per state: the state of its last `window` words
        self.mark: list[int] = []                 # nearest state with `whole`, itself included

    def _state(self, length: int, link: int = -1, moves: dict | None = None) -> int:
        self.next.append(dict(moves or {}))
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        """The state of p's word extended by w, cut out of q where q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[str]) -> None:
        last = 0
        for w in words:
            if w in self.next[last]:
                last = self._split(last, w, self.next[last][w])
                continue
            new, p = self._state(self.length[last] + 1), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            self.link[new] = 0 if p < 0 else self._split(p, w, self.next[p][w])
            last = new

    def step(self, state: int, length: int, w: str) -> tuple[int, int]:
        """Longest match that ends with ``w``, after one of ``length`` words at ``state``."""
        while w not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return self.next[state][w], length + 1

    def name_all(self, passages: list[tuple[str, list[str]]]) -> None:
        """Note the items at their windows, once all passages are in."""
        by_length = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.last, self.mark = list(range(len(self.link))), [-1] * len(self.link)
        for s in by_length[1:]:
            if self.length[self.link[s]] >= self.window:
                self.last[s] = self.last[self.link[s]]
        for item, words in passages:
            state = length = 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= self.window:
                    self.items.setdefault(self.last[state], set()).add(item)
            if len(words) < self.window:
                self.whole.setdefault(state, set()).add(item)
        for s in by_length[1:]:
            self.mark[s] = s if s in self.whole else self.mark[self.link[s]]

    def matches(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str], int]:
        """(hit spans [from, to), names of the items, longest match) of a run of words."""
        state = length = longest = 0
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        seen: set[int] = set()

        def hit(i: int, n: int) -> None:
            start = i + 1 - n
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, i + 1))

        for i, w in enumerate(words):
            state, length = self.step(state, length, w)
            found = 0
            if length >= self.window:
                found, s = self.window, self.last[state]
                if s not in seen:
                    seen.add(s)
                    names |= self.items.get(s, set())
            s = self.mark[state]
            if s >= 0 and self.length[s] > length:         # only a part of that item was read
                s = self.mark[self.link[s]]
            while s > 0:
                found = max(found, self.length[s])
                if s not in seen:
                    seen.add(s)
                    names |= self.whole[s]
                s = self.mark[self.link[s]]
            if found:
                hit(i, found)
                longest = max(longest, length)
        return spans, names, longest


# --- words of Arrow batches ----------------------------------------------------------

def spans_of_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, words per row) of all words of some adjacent rows."""
    base = int(starts[0])
    b = _CODE[raw[base:int(ends[-1])]]
    inside = _IS_WORD[b]
    for k in np.flatnonzero(starts[1:] > ends[:-1]):
        inside[ends[k] - base:starts[k + 1] - base] = False     # bytes below a null row
    edge = np.zeros(len(b) + 1, bool)
    edge[starts - base] = True
    first = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    if not len(first):
        return np.zeros(0, np.uint64), first, first, np.zeros(len(starts), np.int64)
    span = np.diff(np.append(first, len(b)))
    pos = np.arange(first[0], len(b)) - np.repeat(first, span)
    power = np.ones(int(span.max()) + 1, np.uint64)
    power[1:] = np.cumprod(np.full(len(power) - 1, _BASE, np.uint64))
    body = inside[first[0]:]
    code = np.where(body, _SALT[b[first[0]:]], np.uint64(0)) * power[pos]
    size = np.add.reduceat(body.astype(np.int64), first - first[0])
    counts = np.searchsorted(first, ends - base) - np.searchsorted(first, starts - base)
    return mix64(np.add.reduceat(code, first - first[0])), first + base, first + size + base, counts


def _points(raw: np.ndarray) -> int:
    """Code points that begin in these bytes."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def hashes_of(words: list[str]) -> np.ndarray:
    col = pa.array(words, pa.string())
    return spans_of_words(*text_buffers(col))[0] if words else np.zeros(0, np.uint64)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * np.uint64(0x9E3779B97F4A7C15) ^ right)


def _known(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values lie in the sorted table; a bit array rules most of them out."""
    if not len(table):
        return np.zeros(len(values), bool)
    bits = np.zeros(1 << 20, bool)
    bits[(table >> np.uint64(44)).astype(np.int64)] = True
    out = bits[(values >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    found = np.minimum(np.searchsorted(table, values[at]), len(table) - 1)
    out[at] = table[found] == values[at]
    return out


class Matcher:
    """An automaton with the sorted hashes of its words and pairs, made once in
    every Python worker from the passages of a broadcast block."""

    _made: dict[str, "Matcher"] = {}

    def __init__(self, passages: list[tuple[str, list[str]]], window: int):
        auto = self.auto = Automaton(window)
        for _, words in passages:
            auto.add(words)
        auto.name_all(passages)
        vocab = sorted({w for _, words in passages for w in words})
        h = dict(zip(vocab, hashes_of(vocab).tolist()))
        pairs = {(h[a], h[b]) for _, words in passages for a, b in zip(words, words[1:])}
        both = np.array(sorted(pairs), np.uint64).reshape(-1, 2)
        self.words = np.sort(np.array(list(h.values()), np.uint64))
        self.pairs = np.sort(pair_hash(both[:, 0], both[:, 1]))
        self.shortest = min((min(len(w), window) for _, w in passages), default=window)

    @classmethod
    def of(cls, block) -> "Matcher":
        key, window, passages = block.value
        if key not in cls._made:
            cls._made.clear()                              # one block in memory at a time
            cls._made[key] = cls(passages, window)
        return cls._made[key]

    def runs(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) of the runs of known words in known pairs, within a row each."""
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chained = np.zeros(len(h), bool)                    # word i goes on from word i - 1
        chained[1:] = _known(pair_hash(h[:-1], h[1:]), self.pairs)
        edge = np.cumsum(counts)[:-1]
        chained[edge[edge < len(h)]] = False
        begin = np.flatnonzero(~chained)
        end = np.append(begin[1:], len(h))
        if self.shortest <= 1:                              # a single word may be an item
            fine = (end - begin > 1) | _known(h[begin], self.words)
        else:
            fine = end - begin >= self.shortest
        return begin[fine], end[fine]

    def rows(self, col: pa.Array) -> list[tuple[int, list, set, int]]:
        """(words, hit spans with their bytes, item names, longest match) per row."""
        out = []
        raw, starts, ends = text_buffers(col)
        for i, j in slices(starts, ends):
            h, at, to, counts = spans_of_words(raw, starts[i:j], ends[i:j])
            begin, end = self.runs(h, counts)
            row_at = np.concatenate([[0], np.cumsum(counts)])
            of = np.searchsorted(row_at, begin, side="right") - 1
            found = [(int(n), [], set(), 0) for n in counts]
            read = {}                                       # row: (byte, code points before it)
            for b, e, r in zip(begin.tolist(), end.tolist(), of.tolist()):
                words = [_CODE[raw[x:y]].tobytes().decode("utf-8", "replace")
                         for x, y in zip(at[b:e].tolist(), to[b:e].tolist())]
                spans, names, longest = self.auto.matches(words)
                if not spans:
                    continue
                n, all_spans, all_names, top = found[r]
                first = int(row_at[r])
                byte, point = read.get(r, (int(starts[i + r]), 0))
                for x, y in spans:
                    p, q = int(at[b + x]), int(to[b + y - 1])
                    before = point + _points(raw[byte:p])
                    byte, point = q, before + _points(raw[p:q])
                    all_spans.append((b + x - first, y - x, before, point))
                read[r] = (byte, point)
                found[r] = (n, all_spans, all_names | names, max(top, longest))
            out += found
        return out


# --- the operator --------------------------------------------------------------------

def passages(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
             id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(block, item, words): items cut into passages of at most ``block_words``, dealt
    to blocks of about as many words."""
    w = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
                     words_of(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0).distinct()
    step = max(1, block_words - window + 1)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))
    cut = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, step + window - 1))).alias("words"))
    total = w.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    return cut.select(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int").alias("block"), "item", "words")


def scan(docs: DataFrame, items: DataFrame, text: str = "text", *, window: int = WINDOW,
         block_words: int = BLOCK_WORDS, item_id: str = "item_id", item_text: str = "text",
         return_text: bool = True) -> DataFrame:
    """``docs`` (without the text where ``return_text`` is off) plus ``n_words``, ``n_hit``,
    ``longest`` (longest match that holds a window), ``spans`` (hit words: first_word, n, and
    their start and end in code points) and ``items`` (names, sorted)."""
    spark = docs.sparkSession
    cut = keep(passages(items, window, block_words, item_id, item_text), "passages")
    numbers = [r[0] for r in cut.select("block").distinct().orderBy("block").collect()] or [None]
    rest = [c for c in docs.columns if c not in FOUND and c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("_none"))
    rows = docs.select(row.alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"),
                       F.lit(None).cast(_FOUND_TYPE).alias("_found"))
    for i, number in enumerate(numbers):
        last = i == len(numbers) - 1
        own = cut.where(F.col("block") == number).select("item", "words").collect() if number is not None else []
        block = spark.sparkContext.broadcast((uuid.uuid4().hex, window, [(r[0], list(r[1])) for r in own]))
        rows = _pass(rows, block, with_text=return_text or not last)
        if not last:
            rows = keep(rows, "scanned")                    # the next block starts from a table
    text_back = [F.col("_text").alias(text)] if return_text and text not in FOUND else []
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in rest], *text_back, "_found.*")


def _pass(rows: DataFrame, block, with_text: bool) -> DataFrame:
    fields = [rows.schema["_row"], *([rows.schema["_text"]] if with_text else []), T.StructField("_found", _FOUND_TYPE)]

    def run(batches):
        matcher = Matcher.of(block)
        for b in batches:
            before = b.column(2).to_pylist() if b.column(2).null_count < b.num_rows else [None] * b.num_rows
            found = [merged(x, old) for x, old in zip(matcher.rows(b.column(1)), before)]
            cols = [b.column(0), *([b.column(1)] if with_text else []), pa.array(found, _ARROW_FOUND)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


_SPAN = pa.struct([(c, pa.int64()) for c in ("first_word", "n", "start", "end")])
_ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()),
                          ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def merged(found: tuple[int, list, set, int], old: dict | None) -> dict:
    """A row's result joined with that of the blocks before; spans that touch are one."""
    n, spans, names, longest = found
    if old is not None:
        spans = spans + [(s["first_word"], s["n"], s["start"], s["end"]) for s in old["spans"]]
        names, longest = names | set(old["items"]), max(longest, old["longest"])
    out: list[list[int]] = []
    for w, k, s, e in sorted(spans):
        if out and w <= out[-1][0] + out[-1][1]:
            if w + k > out[-1][0] + out[-1][1]:
                out[-1][1], out[-1][3] = w + k - out[-1][0], e
        else:
            out.append([w, k, s, e])
    return {"n_words": n, "n_hit": sum(x[1] for x in out), "longest": longest,
            "spans": [dict(zip(("first_word", "n", "start", "end"), x)) for x in out], "items": sorted(names)}


def clean(scanned: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE,
          max_span: int = MAX_SPAN) -> DataFrame:
    """Scanned documents with their hit spans cut out; those of which more than
    ``max_coverage`` is hit, or with a hit span of more than ``max_span`` words, go."""
    fine = (F.col("n_hit") <= max_coverage * F.col("n_words")) & ~F.exists("spans", lambda s: s["n"] > max_span)
    t = F.col(f"`{text}`")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], piece).alias("out"))

    whole = F.aggregate("spans", start, cut, lambda a: F.concat(
        a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    return scanned.where(fine).withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(t))
