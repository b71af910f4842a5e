import random
import re
from collections import Counter

from parley.llm import quality as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "a", "a b a b a b", "x\n\n x\nx\n", "é ü |#", "same line.\nsame line.\r\nsame line.",
           "word " * 3000]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    out += ["".join(rng.choice("ab \n\t\x0b#é😀") for _ in range(rng.randrange(90))) for _ in range(60)]
    return out


def check(spark):
    rows = [(i, t, 7) for i, t in enumerate(texts())]
    got = Q.measure(spark.createDataFrame(rows, "id int, text string, n_words int")).collect()
    for r in got:
        assert tuple(r[c] for c in BASE) == brute(r["text"]), repr(r["text"])


def test_measures_match_brute_force(spark):
    check(spark)


def test_pairs_beyond_the_key_limit(spark, monkeypatch):
    monkeypatch.setattr(Q, "LOW", 7)          # texts of more than seven words take the other way
    check(spark)


def test_verdicts_follow_the_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = Q.measure(docs.select("doc_id", "text")).drop("text")
    model = Q.fit(m)
    j = Q.judge(m, model).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(not r["kept"] for r in j if r["quality"] == 0)
    assert all(r["kept"] for r in j if r["quality"] == 1 and not r["base_failed"])
    assert all(0.5 <= a <= 0.99 for a in model.accuracy.values())


def test_em_finds_the_unreliable_rule():
    class Row(dict):
        def __str__(self):
            return str(sorted(self.items(), key=str))

    names = list(Q.rules())
    rng = random.Random(2)
    counts = Counter()
    for _ in range(4000):
        good = rng.random() < 0.6
        vote = {k: None for k in names}
        for k, acc in zip(names[:4], (0.95, 0.95, 0.9, 0.6)):
            vote[k] = int(good if rng.random() < acc else not good)
        counts[tuple(vote[k] for k in names)] += 1

    class Fake:
        def select(self, *_):
            return self
        groupBy = agg = select

        def collect(self):
            return [Row(dict(zip(names, v)), n=n) for v, n in counts.items()]

    a = Q.fit(Fake()).accuracy
    assert abs(a[names[0]] - 0.95) < 0.03 and abs(a[names[3]] - 0.6) < 0.05


def test_empty_table(spark):
    m = Q.measure(spark.createDataFrame([], "id int, text string"))
    assert Q.judge(m, Q.fit(m)).count() == 0


def test_texts_without_words_get_no_vote(spark):
    texts = [None, "", " ", "\n\n", "...", "a " * 9, "a | " * 20, "One line of plain words that ends here. " * 3]
    m = Q.measure(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    m = m.localCheckpoint()                   # the rules on stored columns, as the queries run them
    votes = m.select("id", *[v.alias(k) for k, v in Q.rules().items()]).collect()
    assert all(x is None for r in votes if r["id"] < 6 for x in r[1:])
    assert all(any(x is not None for x in r[1:]) for r in votes if r["id"] >= 6)
    got = {r["id"]: r for r in Q.judge(m, Q.fit(m)).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["base_failed"] and not got[i]["kept"] and got[i]["p_good"] == 0.5 for i in range(6))


def test_query_with_texts_without_words(spark, tmp_path):
    from parley.llm.queries import QUERIES

    rows = [(i, t) for i, t in enumerate([None, "", "\t", "plain words " * 4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, str(tmp_path)).collect()}
    assert [got[i]["n_words"] for i in range(4)] == [0, 0, 0, 8]
    assert all(got[i]["p_good"] == 0.5 and not got[i]["kept"] for i in range(4))
