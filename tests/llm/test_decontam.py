import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, items string, note string"
ITEMS = "item_id long, text string, extra string"


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[a:a + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a:a + k])) in grams:
                    hit |= set(range(a, a + k))
                    names |= grams[g]
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def cases(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "d", "É1", "naïve", "zz9"]
    item = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, item(rng.choice([12, 20, 9, 4, 2, 1 if seed % 2 else 3]))) for i in range(12)]
    items += [(3, items[3][1]), (50, items[0][1]), (None, item(11)), (60, ""), (61, None), (62, "x y z x y z x y z x y z")]
    docs = []
    for i in range(60):
        body = [rng.choice(vocab + ["new", "other"]) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            t = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(t) + 1)
            body[rng.randrange(len(body) + 1):0] = t[a:a + rng.randrange(1, 15)]
        docs.append((i, rng.choice([" ", ", ", "\n-", "|"]).join(w.upper() if rng.random() < .2 else w for w in body)))
    docs += [(1, docs[1][1]), (None, docs[2][1]), (70, None), (71, ""), (72, " .,;\x00 "), (73, docs[4][1] * 60),
             (74, "X, y.Z x-y z " * 9)]
    return docs, items


def test_against_every_window(spark):
    for seed, window, block in ((1, 10, 200_000), (2, 10, 30), (4, 3, 25)):
        docs, items = cases(seed)
        d = spark.createDataFrame([(*r, "mine", "n") for r in docs], DOCS).repartition(3)
        x = spark.createDataFrame([(*r, "e") for r in items], ITEMS).repartition(2)
        got = decontam.scan(d, x, window=window, block_words=block)
        assert got.columns == ["doc_id", "note", "text", *decontam.FOUND]
        rows = got.collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows], key=repr) == \
            brute(docs, items, window), (seed, window, block)
        for r in rows:                                     # spans: words and code points agree
            w = words(r["text"])
            assert sum(s["n"] for s in r["spans"]) == r["n_hit"]
            for s in r["spans"]:
                assert words(r["text"][s["start"]:s["end"]]) == w[s["first_word"]:s["first_word"] + s["n"]]
        one = decontam.scan(d, x, window=window, return_text=False)
        assert "text" not in one.columns and one.count() == len(docs)


def test_clean_cuts_spans(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    body = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, f"Ünder {body}, {passage.upper()}! {body}", "", ""), (2, passage, "", ""),
                               (3, body, "", ""), (4, None, "", "")], DOCS)
    x = spark.createDataFrame([(1, passage, "")], ITEMS)
    out = {r["doc_id"]: r["text"] for r in decontam.clean(decontam.scan(d, x)).collect()}
    assert out == {1: f"Ünder {body}, ! {body}", 3: body, 4: None}
    assert {r["doc_id"] for r in decontam.clean(decontam.scan(d, x), max_span=11).collect()} == {3, 4}


def test_empty_tables(spark):
    d, x = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontam.scan(d, x).count() == 0
    one = spark.createDataFrame([(1, "a b", "", "")], DOCS)
    row = decontam.scan(one, x).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (2, 0, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=5),
       st.lists(st.sampled_from("abcd"), max_size=25), st.integers(1, 5))
def test_automaton_against_all_passages(items, text, window):
    auto = decontam.Automaton(window)
    for w in items:
        auto.add(w)
    auto.name_all([(str(i), w) for i, w in enumerate(items)])
    spans, names, _ = auto.matches(text)
    want = brute([(0, " ".join(text))], [(i, " ".join(w)) for i, w in enumerate(items)], window)[0]
    assert (sum(b - a for a, b in spans), sorted(names)) == want[2:]
    state = length = 0
    joined = ["\0".join(["", *w, ""]) for w in items]
    for i, w in enumerate(text):                           # the longest passage that ends here
        state, length = auto.step(state, length, w)
        has = [n for n in range(i + 2) if n == 0 or any("\0".join(["", *text[i + 1 - n:i + 1], ""]) in j for j in joined)]
        assert length == max(has)
