import random

import numpy as np

from parley.llm import neardup as N


def plain_edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[j - 1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_edits():
    rng = random.Random(1)
    for _ in range(600):
        a = [rng.randrange(7) for _ in range(rng.randrange(25))]
        b = list(a)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(b) + 1)
            if rng.random() < 0.4 and b:
                b.pop(min(i, len(b) - 1))
            else:
                b.insert(i, rng.randrange(7))
        d, limit = plain_edits(a, b), rng.randrange(13)
        got = N.banded_edits(np.array(a, np.uint32), np.array(b, np.uint32), limit)
        assert got == (d if d <= limit else None)


def corpus():
    """Groups of edited copies, unrelated texts that share a passage, odd rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    docs, group = [], {}
    for g in range(6):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for c in range(rng.choice([1, 2, 5])):
            t = list(base)
            for _ in range(int(0.05 * len(t)) if c else 0):
                t[rng.randrange(len(t))] = word()
            group[len(docs)] = g
            docs.append(" ".join(t))
    base = [word() for _ in range(120)]                      # one large group of near copies
    for _ in range(40):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = word()
        group[len(docs)] = "large"
        docs.append(" ".join(t))
    for i in range(40):                                      # a passage of half the text, nothing else shared
        group[len(docs)] = f"alone{i}"
        docs.append(" ".join([word() for _ in range(25)] + passage + [word() for _ in range(25)]))
    return docs, group


def classes(docs):
    arrays, ids = [], {}
    for t in docs:
        arrays.append(np.array([ids.setdefault(w, len(ids)) for w in (t or "").split()], np.uint32))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            if N.similar(arrays[a], arrays[b], 0.8):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(i) for i in range(len(docs))]


def test_classes_match_brute_force(spark):
    docs, group = corpus()
    docs += [docs[0], docs[0] + " \n", None, "", "one two", "one two", "one three"]
    want = classes(docs)
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(None, "a b c", "x"), (3, docs[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(3)
    got = sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)
    assert len(got) == len(rows)
    assert {i: c for i, c in got if i is not None} == dict(enumerate(want))
    assert (None, None) in got and sum(i == 3 for i, _ in got) == 2
    large = [c for i, c in got if group.get(i) == "large"]
    assert len(set(large)) == 1
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in N.drop_duplicates(df).collect())
    assert [i for none, i in kept if not none] == sorted(set(want)) and kept[-1][0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(50, 40), (40, 60)], "a long, b long")
    got = dict(N.components(edges).collect())
    assert got == {**{i: 1 for i in range(2, 13)}, 50: 40, 60: 40}
