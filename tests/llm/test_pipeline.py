"""Every stage against a plain version on its own input."""

import numpy as np
import sentencepiece

import corpus_pipeline as C
from parley.llm import mixing, neardup, pieces, quality
from parley.llm.scratch import keep

from .test_quality import WORD, brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in C.STAGES] == ["language ID", "quality rules", "near duplicates", "source mixing", "SentencePiece"]
    seen = {}
    for name, stage in C.STAGES:
        out = keep(stage(spark, docs, SF), "test-stage")
        seen[name] = (docs.collect(), out.collect())
        if name != "SentencePiece":
            assert out.columns == columns
        docs = out

    before, after = seen["language ID"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    text = {r["doc_id"]: r["text"] for r in before}
    assert all(len(WORD.findall(text[i] or "")) < 50 for i in gone)          # clean, longer texts stay

    before, after = seen["quality rules"]
    kept = {r["doc_id"] for r in after}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in before:
        n, _, _, _, rep = brute(r["text"])
        if n < 50 or 100 * rep > 50 * n or labels.get(r["doc_id"]) == 0:
            assert r["doc_id"] not in kept
        elif labels.get(r["doc_id"]) == 1:
            assert r["doc_id"] in kept

    before, after = seen["near duplicates"]
    ids = {}
    arrays = {r["doc_id"]: np.array([ids.setdefault(w, len(ids)) for w in WORD.findall(r["text"])], np.uint32)
              for r in before}
    parent = {i: i for i in arrays}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in arrays:
        for b in arrays:
            if a < b and neardup.similar(arrays[a], arrays[b], 0.8):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(r["doc_id"] for r in after) == sorted({root(i) for i in arrays})

    before, after = seen["source mixing"]
    size, taken = {}, {}
    for r in before:
        size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"]))
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
        assert set(WORD.findall(r["text"])) <= set(WORD.findall(text[r["doc_id"]]))
    weight = dict(zip(sorted(size), (3, 1, 2) * len(size)))
    unit = min(taken[s] / weight[s] for s in size if taken[s] < 1.9 * size[s])
    for s in size:
        assert taken[s] <= 2 * size[s]
        assert abs(taken[s] - min(2 * size[s], unit * weight[s])) <= 0.05 * taken[s] + 3 * mixing.BLOCK

    before, after = seen["SentencePiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(before) == len(after) and all(r["exact"] for r in after)
    key = lambda i, s: (i, tuple(s))
    assert sorted(key(r["doc_id"], sp.encode(r["text"])) for r in before) == \
        sorted(key(r["doc_id"], r["ids"]) for r in after)
    assert quality and C.ORACLE_SQL is None


def test_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, repeated rows, clashing extra columns, an empty table."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, score string, rejected string, "
              "kept string, n_words string, class_id string, row_no string, pass_no string, ids string, size string")
    good = " ".join(a + b + c for a in ("plain", "text", "word") for b in "aeiou" for c in ("ly", "ness", "ed", "ing"))
    good += ". "
    extra = ("x",) * 9
    rows = [(i, f"{good} Number {i} {'abc ' * i}.", "en", "s", 9, *extra) for i in range(12)]
    rows += [(None, good + "null id here.", "en", None, None, *extra), (3, None, None, None, None, *(None,) * 9),
             (4, "", "en", "s", 0, *extra), (5, f"{good} Number 5 {'abc ' * 5}.", "en", "s", 9, *extra),
             (6, "word and text of that " * 30_000, "en", "s", 9, *extra)]
    for data in (rows, []):
        docs = keep(spark.createDataFrame(data, schema), "odd")
        for name, stage in C.STAGES:
            out = keep(stage(spark, docs, SF), "odd-stage")
            if name != "SentencePiece":
                assert out.columns == docs.columns
                assert out.where("score != 'x' OR row_no != 'x' OR kept != 'x'").count() == 0
            docs = out
        assert (docs.count() > 0) == bool(data)
