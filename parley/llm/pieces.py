"""SentencePiece encoding and decoding by streaming Viterbi (op 2).

The encoder walks the text once.  For every position it keeps the best last
piece that ends there and a back pointer; a piece is at most ``longest``
characters, so only that many positions can still be continued.  Whenever all
their back-pointer paths run through one boundary, the ids before it are
committed and the window moves on.  (Where no piece spans a boundary, as
between a letter and a following blank mark, all paths run through it, so words
are encoded apart and their ids remembered.)

Two kinds of model:
- unigram: the best path has the largest sum of piece scores (a tie goes to
  the longer last piece);
- BPE: a piece may follow another only if merging their joint string gives
  exactly these two pieces.  Every prefix then has one last piece, and the path
  equals the merge result.

Characters without a piece become byte pieces.  A literal U+2581 in the text
is also written as bytes, so decoding returns every text exactly.

Defined results for odd input
- null text: null ids, null decoded text;  empty text: no ids
- very long texts and words: encoded whole, window and memory bounded
- repeated rows: each encoded; ties as above; empty table: an empty result
- extra columns: kept, unless they clash with an output column (replaced)
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 250_000             # remembered words per generation (two generations)
FITS = 250_000              # remembered piece pairs
CACHED_CHARS = 48           # longer words are encoded anew each time
COMMIT_EVERY = 64

_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LOADED: dict[bytes, "PieceModel"] = {}


class PieceModel:
    """Pieces of a SentencePiece model and the two directions."""

    def __init__(self, proto: bytes, cache: int = CACHE):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if sp.decode(sp.encode("Ab  ½ Ａ")) != "Ab  ½ Ａ":
            raise ValueError("only models without text normalisation are supported")
        self.text_piece: dict[str, int] = {}
        self.byte_id = [sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.unknown = sp.unk_id()
        self.out: list[bytes] = []
        scores = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                self.text_piece[piece] = i
                self.out.append(piece.replace(MARK, " ").encode())
                scores.append((i, sp.get_score(i)))
        self.score = dict(scores)
        values = [s for _, s in scores]
        # merge ranks are whole numbers; log probabilities are not
        self.bpe = all(s == int(s) for s in values)
        self.floor = min(values, default=0.0) - 10       # score of a character without a piece
        self.longest = max(map(len, self.text_piece), default=1)
        self.spans_mark = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.text_piece)
        self.units, self.joins = self._cuts()
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        # pieces that merging their own characters gives back
        self.whole = {p for p in self.text_piece if len(p) == 1 or self._merged(p) == [p]} if self.bpe \
            else set(self.text_piece)
        self.prefix: dict[str, bool] = {}
        for p in self.whole:
            for j in range(1, len(p)):
                self.prefix.setdefault(p[:j], False)
            self.prefix[p] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = cache

    def _cuts(self) -> tuple[re.Pattern, re.Pattern | None]:
        """How a text falls into runs that no piece crosses.

        Punctuation and line ends that no piece joins to a letter are cut off
        as runs of their own; a text with one of the few other characters that
        some piece does join to them is only cut at blank marks.
        """
        pairs = {p[i:i + 2] for p in self.text_piece for i in range(len(p) - 1)}
        marks = {chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) != " "}
        joins: set[str] = set()
        while True:
            out = {x for a, b in pairs if (a in marks) != (b in marks) and MARK not in (a, b) for x in (a, b)}
            bad = {x for x in marks & out if any(
                (a == x and b not in marks and b.isascii()) or (b == x and a not in marks and a.isascii() and a != MARK)
                for a, b in pairs)}
            if not bad:
                joins = out - marks
                break
            marks -= bad
        if not marks:
            return _UNITS, None
        k = "".join(re.escape(c) for c in sorted(marks))
        return (re.compile(f"{MARK}*[^{MARK}{k}]+|{MARK}*[{k}]+|{MARK}+"),
                re.compile("[" + "".join(map(re.escape, sorted(joins))) + "]") if joins else None)

    # --- one step of the lattice -------------------------------------------
    def _merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first, leftmost among equals."""
        parts, score, known = list(text), self.score, self.text_piece
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = known.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or score[p] > best):
                    best, at = score[p], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, a: str, b: str) -> bool:
        d = self.fits.get(a)
        if d is None:
            d = self.fits[a] = {}
        got = d.get(b)
        if got is None:
            self.n_fits += 1
            if self.n_fits > FITS:
                for x in self.fits.values():      # in place: a walk may hold on to them
                    x.clear()
                self.n_fits = 0
            got = d[b] = self._merged(a + b) == [a, b]
        return got

    def _last_piece(self, s: str, j: int, last: list, best: list) -> tuple[str, float]:
        """The last piece of the best path to position ``j`` (and its score)."""
        known = self.text_piece
        if self.bpe:
            for i in range(max(0, j - self.longest), j):
                p = s[i:j]
                if p in self.whole and (i == 0 or last[i] is None or self._follows(last[i], p)):
                    return p, 0.0
            return s[j - 1], 0.0
        top, piece = None, s[j - 1]
        for i in range(max(0, j - self.longest), j):
            p = s[i:j]
            k = known.get(p)
            if k is None and i < j - 1:
                continue
            v = best[i] + (self.score[k] if k is not None else self.floor)
            if top is None or v > top:
                top, piece = v, p
        return piece, top

    # --- encoding -----------------------------------------------------------
    def _emit(self, pieces: list[str], out: array) -> None:
        for p in pieces:
            k = self.text_piece.get(p)
            if k is not None:
                out.append(k)
            else:
                raw = p.encode("utf-8", "surrogatepass")
                ids = [self.byte_id[c] for c in raw]
                out.extend(ids if self.unknown not in ids else [self.unknown])

    def stream(self, text: str) -> array:
        """Ids of a run of characters, window bounded by the longest piece."""
        out = array("i")
        s, last, best = "", [None], [0.0]
        for at in range(0, len(text), COMMIT_EVERY):
            s += text[at:at + COMMIT_EVERY]
            for j in range(len(last), len(s) + 1):
                p, v = self._last_piece(s, j, last, best)
                last.append(p)
                best.append(v)
            done = at + COMMIT_EVERY >= len(text)
            cut = len(s) if done else self._boundary(last)
            if cut:
                path, j = [], cut
                while j > 0 and last[j] is not None:
                    path.append(last[j])
                    j -= len(last[j])
                self._emit(path[::-1], out)
                # position ``cut`` stays as the start of the window; what ends there is kept
                s, tail, base = s[cut:], last[cut:], best[cut]
                before = last[cut]
                best = [v - base for v in best[cut:]]
                last = tail
                if self.bpe and not done:
                    # the committed piece still decides what may follow it
                    s, last, best = before + s, [None] * len(before) + last, [0.0] * len(before) + best
                    last[len(before)] = before
                    out_drop = array("i")
                    self._emit([before], out_drop)
                    del out[len(out) - len(out_drop):]
                else:
                    last[0] = None
        return out

    def _boundary(self, last: list) -> int:
        """The largest boundary that the paths of all live positions share."""
        n = len(last) - 1
        live = set(range(max(0, n - self.longest + 1), n + 1))
        while len(live) > 1:
            j = max(live)
            live.discard(j)
            if last[j] is None:
                return 0
            live.add(j - len(last[j]))
        return live.pop()

    def _short(self, s: str) -> array:
        """``stream`` for a merge model and a run that fits one window.

        ``ends[j]`` holds the pieces that end at ``j``, longest first; when the
        walk reaches ``j`` the one that may follow its own start's last piece
        is the last piece there.
        """
        n = len(s)
        last: list[str] = [""] * (n + 1)
        after: list[dict] = [{}] * (n + 1)
        ends: list[list] = [[] for _ in range(n + 1)]
        prefix, fits = self.prefix, self.fits
        for i in range(n + 1):
            if i:
                for k, p in ends[i]:
                    if k == 0:
                        break
                    ok = after[k].get(p)
                    if ok or (ok is None and self._follows(last[k], p)):
                        break
                else:
                    p = s[i - 1]
                last[i] = p
                d = fits.get(p)
                if d is None:
                    d = fits[p] = {}
                after[i] = d
            for j in range(i + 1, n + 1):
                p = s[i:j]
                whole = prefix.get(p)
                if whole is None:
                    break
                if whole:
                    ends[j].append((i, p))
        path, j = [], n
        while j > 0:
            path.append(last[j])
            j -= len(last[j])
        out = array("i")
        self._emit(path[::-1], out)
        return out

    def _unit(self, unit: str) -> bytes:
        got = self.old.get(unit)
        if got is None:
            got = (self._short(unit) if self.bpe and len(unit) <= COMMIT_EVERY else self.stream(unit)).tobytes()
        if len(unit) <= CACHED_CHARS:
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        if not text:
            return b""
        if MARK in text:
            mark = array("i", [self.byte_id[c] for c in MARK.encode()]).tobytes()
            first, *rest = text.split(MARK)
            head = self._run(MARK + first.replace(" ", MARK))
            return head + b"".join(mark + self._run(x.replace(" ", MARK)) for x in rest)
        return self._run(MARK + text.replace(" ", MARK))

    def _run(self, s: str) -> bytes:
        if self.spans_mark:
            return self.stream(s).tobytes()
        new, unit = self.new.get, self._unit
        units = _UNITS if self.joins is not None and self.joins.search(s) else self.units
        return b"".join([new(u) or unit(u) for u in units.findall(s)])

    # --- decoding -----------------------------------------------------------
    def decode(self, ids) -> str:
        """Text of ids; the blank that encoding put in front is taken off."""
        table = self.out
        raw = b"".join([table[i] for i in ids])
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _model(proto: bytes) -> PieceModel:
    if proto not in _LOADED:
        _LOADED.clear()
        _LOADED[proto] = PieceModel(proto)
    return _LOADED[proto]


def read_model(path: str = MODEL) -> bytes:
    """The model file (a fixed vocabulary, under a megabyte for 32 000 pieces)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL,
           exact: str | None = None) -> DataFrame:
    """``docs`` plus the ids of its text.  With ``exact`` the ids are decoded
    again in the same pass, and that column says whether the text came back."""
    if text in (ids, exact):
        raise ValueError("an output must not replace the text column")
    base = docs.drop(ids, exact) if exact else docs.drop(ids)
    proto = docs.sparkSession.sparkContext.broadcast(read_model(model))
    at = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if exact:
        schema = schema.add(exact, "boolean")

    def run(batches):
        m = _model(proto.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(at).to_pylist()
                packed = [m.encode(t) if t else b"" for t in texts]
                off = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), np.int32)
                null = np.array([t is None for t in texts])
                col = pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=pa.array(null)) \
                    if null.any() else pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
                cols, names = [*part.columns, col], [*part.schema.names, ids]
                if exact:
                    same = [t is None or m.decode(np.frombuffer(p, np.int32).tolist()) == t
                            for t, p in zip(texts, packed)]
                    cols, names = [*cols, pa.array(same, pa.bool_())], [*names, exact]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return base.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` plus the text of its ids."""
    if ids == text:
        raise ValueError("text must not replace the id column")
    base = rows.drop(text)
    proto = rows.sparkSession.sparkContext.broadcast(read_model(model))
    at = base.columns.index(ids)
    schema = T.StructType([*base.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        m = _model(proto.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                col = part.column(at)
                got = [None if not col[k].is_valid else m.decode(col[k].values.to_pylist())
                       for k in range(len(col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())],
                                                 names=[*part.schema.names, text])

    return base.mapInArrow(run, schema)
