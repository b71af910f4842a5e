"""Main-text extraction with a linear-chain CRF over DOM leaf blocks (op 9).

A page is read once into leaf blocks: runs of text between block-level tags,
each with its open elements.  A binary conditional random field labels the
sequence of blocks main or not; features are the ancestors' tags, their class
and id words, link share, length and punctuation, and the label before.
It is trained by gradient ascent on labelled pages (forward-backward) and
decoded by Viterbi.  The blocks labelled main, in page order, are the text.

Labelled pages: generated layouts whose blocks are known (``training_pages``),
and a bounded sample of the table's own pages that mark their article up.

Defined results for odd input
- null or empty html, or no main block: empty text
- character references are decoded, white space in a block becomes one blank;
  unclosed tags, comments and scripts end with the page
- ties in decoding: not main;  repeated rows: each extracted
- very long pages: whole (memory follows the page);  empty table: an empty result
- extra columns: kept unless named as the output (replaced)
"""

from __future__ import annotations

import html as _html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PAGES = 150          # bound of the sample of the table's own pages
GENERATED_PAGES = 400
ROUNDS = 80

# fixed values: element names
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt "
                       "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe "
                       "legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea "
                       "tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|svg|math|canvas|object|xmp|noembed|noframes"
CLOSES_P = BLOCK_TAGS - frozenset("body html head title button option optgroup".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"},
         "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW_TAGS})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    link_share: float


def leaf_blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    in_link = 0

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), tuple(n for _, ns in stack for n in ns),
                                 min(1.0, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    def close_to(k: int):
        nonlocal in_link
        for t, _ in stack[k:]:
            if t == "a":
                in_link -= 1
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m.group(3) or m.group(6)
        if tag is None:
            continue
        tag = tag.lower()
        closing = m.group(2) if m.group(3) else m.group(5)
        attrs = m.group(4) if m.group(3) else m.group(7)
        block = tag in BLOCK_TAGS
        if closing:
            if block:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if block:
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close_to(k)
                        break
                    if stack[k][0] in BLOCK_TAGS:
                        break
            same = SAME_CLOSES.get(tag)
            if same:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in same:
                        close_to(k)
                        break
                    if stack[k][0] in SCOPE[tag]:
                        break
        if tag in VOID_TAGS or attrs.endswith("/") and tag not in BLOCK_TAGS:
            continue
        names: tuple[str, ...] = ()
        if attrs and "=" in attrs:
            found = []
            for _, a, b, c in _NAMES.findall(attrs):
                found += _WORDS.findall(_CAMEL.sub(" ", a or b or c).lower())
            names = tuple(x for x in found if not x.isdigit())
        if attrs and _HIDDEN.search(attrs):
            names += ("hidden",)
        stack.append((tag, names))
        if tag == "a":
            in_link += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def features(b: Block, before: Block | None) -> list[str]:
    f = ["bias", "parent:" + (b.tags[-1] if b.tags else "")]
    f += {"tag:" + t for t in b.tags}
    f += {"name:" + n for n in b.names}
    n = len(b.text)
    f.append("len:%d" % (0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3 if n < 250 else 4))
    f.append("link:%d" % (0 if b.link_share == 0 else 1 if b.link_share < 0.3 else 2 if b.link_share < 0.7 else 3))
    if b.text[-1] in ".!?…":
        f.append("ended")
    if b.text[:1] == "©" or "©" in b.text:
        f.append("copyright")
    if before is not None and before.tags == b.tags and before.names == b.names:
        f.append("same-place")
    return f


@dataclass
class Crf:
    """Weights for the main label (the other label's are zero) and transitions."""
    weight: dict[str, float]
    start: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, blocks: list[Block]) -> list[bool]:
        if not blocks:
            return []
        get, step = self.weight.get, self.step
        back, prev = [], None
        s0 = s1 = 0.0
        for b in blocks:
            e = 0.0
            for f in features(b, prev):
                e += get(f, 0.0)
            if prev is None:
                s0, s1 = self.start[0], self.start[1] + e
            else:
                a0, b0 = s0 + step[0][0], s1 + step[1][0]
                a1, b1 = s0 + step[0][1], s1 + step[1][1]
                back.append((b0 > a0, b1 > a1))
                s0, s1 = max(a0, b0), max(a1, b1) + e
            prev = b
        y = s1 > s0
        out = [y]
        for b0, b1 in reversed(back):
            y = b1 if y else b0
            out.append(y)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        if not page:
            return ""
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, y in zip(blocks, self.decode(blocks)) if y)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS, l2: float = 0.002) -> Crf:
    """Maximum likelihood by AdaGrad over all pages at once (padded)."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    flat_f, flat_b = [], []
    longest = max(len(b) for b, _ in pages)
    n = len(pages)
    y = np.zeros((n, longest), int)
    here = np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        prev = None
        for t, b in enumerate(blocks):
            for f in features(b, prev):
                flat_f.append(names.setdefault(f, len(names)))
                flat_b.append(i * longest + t)
            prev = b
        y[i, :len(blocks)] = labels
        here[i, :len(blocks)] = True
    ff, fb = np.array(flat_f), np.array(flat_b)
    w, a, s = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    gw, ga, gs = np.full(len(names), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
    for _ in range(rounds):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(fb, weights=w[ff], minlength=n * longest).reshape(n, longest)
        fwd = np.zeros((n, longest, 2))
        fwd[:, 0] = s + e[:, 0]
        for t in range(1, longest):
            z = np.logaddexp.reduce(fwd[:, t - 1, :, None] + a, axis=1) + e[:, t]
            fwd[:, t] = np.where(here[:, t, None], z, fwd[:, t - 1])
        bwd = np.zeros((n, longest, 2))
        trans = np.zeros((2, 2))
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            on = here[:, t + 1, None]
            nxt = e[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.where(on, np.logaddexp.reduce(a + nxt[:, None, :], axis=2), bwd[:, t + 1])
            p = np.exp(fwd[:, t, :, None] + a + nxt[:, None, :] - total[:, None, None])
            trans += (p * on[:, :, None]).sum(axis=0)
        post = np.exp(fwd + bwd - total[:, None, None])[:, :, 1]
        diff = np.where(here, y - post, 0.0).reshape(-1)
        dw = np.bincount(ff, weights=diff[fb], minlength=len(names)) - l2 * n * w
        seen = np.zeros((2, 2))
        pair = here[:, 1:]
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        da = seen - trans - l2 * n * a
        p0 = np.exp(fwd[:, 0] + bwd[:, 0] - total[:, None])
        ds = np.bincount(y[:, 0], minlength=2) - p0.sum(axis=0) - l2 * n * s
        for v, g, d in ((w, gw, dw), (a, ga, da), (s, gs, ds)):
            g += d * d
            v += 0.5 * d / np.sqrt(g)
    return Crf({k: float(w[i]) for k, i in names.items()}, (float(s[0]), float(s[1])),
               ((float(a[0, 0]), float(a[0, 1])), (float(a[1, 0]), float(a[1, 1]))))


# fixed values: containers and names that pages use for main text and for the rest
MAIN_BOXES = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"',
              'div class="entry-content"', 'section class="article-body"', 'div class="article"', 'div role="main"',
              "div", "section", 'div class="story text"', 'div itemprop="articleBody"']
REST_BOXES = [("nav", "links"), ("header", "links"), ("footer", "short"), ("aside", "mixed"), ('div class="ad"', "prose"),
              ('div class="sidebar"', "mixed"), ('div class="cookie-notice"', "prose"), ('div class="menu"', "links"),
              ('div class="banner"', "prose"), ("form", "form"), ('section class="comments"', "prose"),
              ('div id="comments"', "prose"), ('div class="related"', "links"), ('div class="share"', "links"),
              ('div class="newsletter"', "form"), ('div class="breadcrumb"', "links"), ('ul class="tags"', "links"),
              ('div class="advert"', "prose"), ('div class="popup notice"', "prose"), ('div class="footer"', "short"),
              ('div class="header"', "links"), ('ol class="commentlist"', "prose"), ('div class="comment"', "prose"),
              ('div class="promo sponsored"', "prose"), ('div class="widget"', "mixed"), ('div role="navigation"', "links"),
              ('div class="consent gdpr"', "prose"), ('div class="subscribe"', "form"), ('div class="copyright"', "short")]


def training_pages(count: int = GENERATED_PAGES, seed: int = 3) -> list[tuple[list[Block], list[bool]]]:
    """Generated pages with known labels: a main container among others, in
    many orders; the words are random, so only layout and shape tell."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices("aeioulnrstd", k=rng.randrange(2, 9)))
                        for _ in range(rng.randrange(lo, hi)))

    def prose(mark: str, tag: str | None = None) -> str:
        t = tag or pick(["p", "p", "p", "p", "li", "blockquote", "h2", "td", "pre", "div"])
        text = words(2, 9) if t == "h2" else words(1, 70)
        return f"<{t}>{mark}{text}{pick(['.', '.', '.', '', '!', '?', '&amp;'])}" + (f"</{t}>" if rng.random() < .9 else "")

    def rest(box: tuple[str, str]) -> str:
        name, kind = box
        if kind == "links":
            inner = "<ul>" + "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(rng.randrange(2, 8))) \
                + "</ul>"
        elif kind == "short":
            inner = f"&copy; {words(1, 4)} &middot; {words(1, 8)}."
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button><p>{words(2, 12)}.</p>"
        elif kind == "mixed":
            inner = f"<h3>{words(1, 4)}</h3>" + "".join(prose("", pick(["p", "li"])) for _ in range(rng.randrange(1, 4)))
        else:
            inner = words(3, 30) + "." if rng.random() < .5 else \
                "".join(prose("", pick(["p", "p", "li", "div"])) for _ in range(rng.randrange(1, 5)))
        return f"<{name}>{inner}</{name.split()[0]}>"

    out = []
    mark = ""
    for _ in range(count):
        box = pick(MAIN_BOXES)
        title = words(3, 10)
        body = [f"<h1>{mark}{title}</h1>"] + [prose(mark) for _ in range(rng.randrange(1, 12))]
        if rng.random() < .25:
            body.insert(rng.randrange(1, len(body) + 1), rest(pick([x for x in REST_BOXES if "ad" in x[0]
                                                                        or "aside" in x[0] or "form" in x[0]])))
        if rng.random() < .2:
            body.append(rest(pick([x for x in REST_BOXES if "comment" in x[0]])))
        top = [rest(pick(REST_BOXES)) for _ in range(rng.randrange(0, 4))]
        end = [rest(pick(REST_BOXES)) for _ in range(rng.randrange(0, 4))]
        page = (f"<html><head><title>{title}</title></head><body>{''.join(top)}<{box}>{''.join(body)}</{box.split()[0]}>"
                f"{''.join(end)}</body></html>")
        blocks = leaf_blocks(page)
        labels = [b.text.startswith(mark) for b in blocks]
        for b in blocks:
            b.text = b.text.removeprefix(mark) or "x"
        out.append((blocks, labels))
    return out


_REST_WORDS = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie consent copyright footer "
                        "header menu nav navigation newsletter notice popup promo related share sidebar sponsored "
                        "subscribe widget".split())
_REST_TAGS = frozenset("nav aside footer form header head".split())


def marked_up(page: str) -> tuple[list[Block], list[bool]] | None:
    """Blocks and labels of a page that marks its article up, else None."""
    if "<article" not in page and "<main" not in page:
        return None
    blocks = leaf_blocks(page)
    return blocks, [bool({"article", "main"} & set(b.tags)) and not _REST_TAGS & set(b.tags)
                    and not _REST_WORDS & set(b.names) for b in blocks]


def fit(pages: DataFrame, html: str = "html", *, sample: int = SAMPLE_PAGES, generated: int = GENERATED_PAGES,
        rounds: int = ROUNDS) -> Crf:
    n = pages.count()
    draw = F.pmod(F.xxhash64(html), F.lit(1_000_003)) / F.lit(1_000_003.0) < min(1.0, 1.5 * sample / max(n, 1))
    own = pages.where(draw & F.col(html).isNotNull()).select(F.col(html).alias("h"), F.xxhash64(html).alias("k")) \
        .orderBy("k", "h").limit(sample).collect()
    labelled = [m for m in (marked_up(r["h"]) for r in own) if m]
    return train([*training_pages(generated), *labelled], rounds)


def extract(pages: DataFrame, model: Crf, html: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` plus the main text of each page."""
    if out == html:
        raise ValueError("the output must not replace the html column")
    base = pages.drop(out)
    spec = pages.sparkSession.sparkContext.broadcast(model)      # some hundred weights
    at = base.columns.index(html)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        m = spec.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [m.main_text(p.as_py()) for p in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())],
                                                 names=[*part.schema.names, out])

    return base.mapInArrow(run, schema)
