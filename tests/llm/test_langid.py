import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import langid as L

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return L.fit(docs.where(~L.held_out(F.col("doc_id"), 3, 1)))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(L.held_out(F.col("doc_id"), 3, 1))
    got = L.identify(docs, model).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len(set(model.langs)) > 1 and len(model.langs) > len(set(model.langs))    # several centroids


def test_edges(spark, model):
    rows = [(1, None, None, "x"), (2, "", "en", "x"), (3, "123 -- !!", None, "x"), (None, "the of and to", None, "x"),
            (5, "the of and to", None, "x"), (5, "the of and to", None, "x"), (6, "漢字 仮名", None, "x")]
    got = L.identify(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and all(r["rejected"] for r in got[:3])
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[3]["lang_pred"] == "en"
    assert isinstance(got[0]["score"], float)                       # a clashing column is replaced
    assert got[6]["rejected"]                                       # far from every centroid
    assert L.identify(spark.createDataFrame([], SCHEMA), model).count() == 0
    empty = L.fit(spark.createDataFrame([], SCHEMA))
    assert L.identify(spark.createDataFrame(rows, SCHEMA), empty).where("lang_pred != 'und'").count() == 0


def test_long_text_in_pieces_counts_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcé  .\n1"), 700)) for _ in range(20)] + ["  a  ", "b", " " * 50, "a" * 300]
    whole, has = L.count_vectors(texts, 512)
    monkeypatch.setattr(L, "CHUNK_CHARS", 37)
    parts, has2 = L.count_vectors(texts, 512)
    assert np.array_equal(whole, parts) and np.array_equal(has, has2)


def test_counts_match_a_plain_loop():
    text = "Ab, ab c"
    got, _ = L.count_vectors([text, "xyz"], 4096)
    squeezed = " ab ab c "
    assert got[0].sum() == (len(squeezed) - 1) + sum(squeezed[i + 1] != " " for i in range(len(squeezed) - 2))
    alone, _ = L.count_vectors([text], 4096)
    assert np.array_equal(alone[0], got[0])


def test_repeated_texts_are_learned_and_bounded(spark):
    import random
    rnd = random.Random(2)
    word = lambda abc: "".join(rnd.choice(abc) for _ in range(rnd.randint(2, 7)))
    texts = [(" ".join(word("aeionrst") for _ in range(60)), "xa") for _ in range(300)]
    for trial in range(4):
        one = " ".join(word("bdfgukmw") for _ in range(60))
        df = spark.createDataFrame(texts + [(one, "yb")] * 700, "text string, lang string").repartition(4)
        model = L.fit(df, sample_per_lang=50)
        assert set(model.langs) == {"xa", "yb"}, trial
        lang, _, rejected = model.predict([one, texts[0][0]])
        assert list(lang) == ["yb", "xa"] and not any(rejected)


def test_nearest_centroid_by_hand(spark, model):
    import math
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    for r in L.identify(docs, model).collect()[::7]:
        counts, has = L.count_vectors([r["text"]], model.dims)
        v = [math.log1p(c) * float(w) for c, w in zip(counts[0], model.idf)]
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        cos = [sum(x * float(y) for x, y in zip(v, c) if x) / norm for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        if not has[0]:
            assert r["lang_pred"] == "und" and r["rejected"]
            continue
        assert abs(r["score"] - cos[best]) < 1e-5
        near = [k for k, c in enumerate(cos) if c > cos[best] - 1e-6]          # float32 may break a tie
        assert r["lang_pred"] in {model.langs[k] for k in near}
        assert r["rejected"] == (r["score"] < model.radius[near[0]]) or len(near) > 1
