import re
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, n_chars long"


def rows():
    out = [(1, None, "a", "x", 0), (2, "", "a", "x", 0), (None, "w " * 30, "a", "x", 60), (4, "w " * 500, None, "x", 1000),
           (5, "long " * 20000, "b", "x", 100000), (6, "same text", "c", "x", 9), (6, "same text", "c", "x", 9)]
    out += [(100 + i, f"t{i} " * (i % 90), "abcde"[i % 5], "x", 0) for i in range(400)]
    return out


def plain_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    return target


def test_counts(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = M.document_counts(df).collect()
    again = M.document_counts(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    src, size = {r[0]: r[2] for r in rows()}, defaultdict(int)
    for r in rows():
        size[r[2]] += len(WORD.findall(r[1] or ""))
    target = plain_targets(size)
    taken = defaultdict(int)
    assert len(got) == len(rows())
    for r in got:
        s = src[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[s]
        assert r["target"] == pytest.approx(target[s])
    for s in size:
        assert abs(taken[s] - target[s]) <= 3 * M.BLOCK


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        k = np.full(n, 99, np.uint64)
        got = M._feistel(np.arange(n), np.full(n, n), k)
        assert sorted(got.tolist()) == list(range(n))
        other = M._feistel(np.arange(n), np.full(n, n), k + np.uint64(1))
        assert n < 8 or got.tolist() != other.tolist()


def test_every_slot_is_filled_once(spark):
    targets = [{"source": s, "no": i, "size": z, "docs": 1, "weight": 1, "target": t}
               for i, (s, z, t) in enumerate((("a", 5000, 9000.0), ("b", 700, 1400.0), ("c", 20000, 3000.0), ("d", 0, 0.0)))]
    got = M.draw_slots(spark, targets, block=8, slots=50).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
    uses = defaultdict(int)
    for r in got:
        uses[r["source_no"], r["block_no"]] += 1
    assert max(uses.values()) <= 2
    by = defaultdict(int)
    for (s, _), n in uses.items():
        by[s] += n
    assert by == {0: round(9000 * 625 / 5000), 1: round(1400 * 88 / 700), 2: 375}
    shares = [sum(r["source_no"] == 0 for r in got if r["shard"] == k) for k in range(4)]
    assert len(set(shares)) > 1                       # multinomial, not one fixed share


def test_remix_takes_the_words_it_counts(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = M.remix(df)
    assert out.columns == df.columns
    words, want = defaultdict(int), defaultdict(int)
    text = {r[0]: r[1] for r in rows()}
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
        if len(WORD.findall(r["text"])) == len(WORD.findall(text[r["doc_id"]])):
            assert r["text"] == text[r["doc_id"]]
    for r in M.document_counts(df).collect():
        want[r["doc_id"]] += r["taken"]
    assert words == {k: v for k, v in want.items() if v}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.document_counts(df).count() == 0
    blank = spark.createDataFrame([(1, " ", "a", "x", 1)], SCHEMA)
    assert [r["taken"] for r in M.document_counts(blank).collect()] == [0]
