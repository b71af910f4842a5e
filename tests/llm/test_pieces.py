import random

import numpy as np
import sentencepiece

from parley.llm import pieces as P

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", " a  b", "a\n\tb  ", "日本x", "a\x00b", "x" * 5000, "ab" * 3000, " " * 100, "é́ﬁ①²", "😀😀" * 30,
       "http://www.example.com/aaabbb" * 40, "don't  stop!!!!!!!!", "2². x²y", "한국어 텍스트"]


def test_ids_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdeéèt th ing\n_=-*#0123 ") for _ in range(rng.randrange(1, 300)))
                   for _ in range(80)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    m = P.PieceModel(P.read_model(), cache=50)         # small: generations change often
    for t in texts:
        ids = np.frombuffer(m.encode(t), np.int32).tolist()
        assert ids == sp.encode(t), t[:60]
        assert m.decode(ids) == t


def test_literal_mark_comes_back():
    m = P.PieceModel(P.read_model())
    for t in ("▁", "a▁b", "▁▁ x ▁", " ▁"):
        assert m.decode(np.frombuffer(m.encode(t), np.int32).tolist()) == t


def test_unigram_path_is_the_best_one():
    m = object.__new__(P.PieceModel)
    score = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.0, "aba": -5.0, "bb": -4.2, "abab": -9.0}
    m.text_piece = {p: i for i, p in enumerate(score)}
    m.score = {i: score[p] for p, i in m.text_piece.items()}
    m.bpe, m.longest, m.floor, m.byte_id, m.unknown = False, 4, -20.0, [99] * 256, 98
    names = list(score)

    def best(s):
        if not s:
            return 0.0
        return max(score[s[:k]] + best(s[k:]) for k in range(1, 5) if s[:k] in score)

    rng = random.Random(3)
    for _ in range(40):
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        ids = m.stream(s)
        assert "".join(names[i] for i in ids) == s
        assert abs(sum(score[names[i]] for i in ids) - best(s)) < 1e-9
    long = "".join(rng.choice("ab") for _ in range(700))
    assert "".join(names[i] for i in m.stream(long)) == long


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the  cat\n", "x"), (3, "the  cat\n", "x"), (4, "w" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = P.decode(P.encode(df)).collect()
    assert [r["decoded"] for r in got] == [r[1] for r in rows]
    assert got[0]["ids"] is None and got[1]["ids"] == [] and got[2]["ids"] == got[3]["ids"]
    assert all(r["exact"] for r in P.encode(df, exact="exact").collect())
    assert P.decode(P.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
