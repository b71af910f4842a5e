import random

from parley.llm import neardup as N


def linked(spark, texts, keys):
    """Labels of the texts by ``link``, all of them given the same ``keys``."""
    nodes = spark.createDataFrame([(i, keys) for i in range(len(texts))], "node long, keys array<long>")
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    label = dict(N.components(N.link(nodes, docs, similarity=0.8)).collect())
    return [label.get(i, i) for i in range(len(texts))]


def edited(words, share, rng):
    """The words, a share of them replaced by new ones."""
    out = list(words)
    for i in rng.sample(range(len(out)), round(share * len(out))):
        out[i] = f"new{rng.random()}"
    return out


def test_explained_members_stay_in_the_bucket(spark):
    a = [f"w{i}" for i in range(100)]
    c = ["x"] * 15 + a[15:]                     # 15 edits from a
    b = a[:85] + ["y"] * 15                     # 15 edits from a, 30 from c
    assert linked(spark, [" ".join(t) for t in (c, a, b)], [1]) == [0, 0, 0]


def test_large_drifting_family_is_one_group(spark):
    rng = random.Random(3)
    at, family = [f"w{i}" for i in range(100)], []
    for _ in range(60):
        family.append(" ".join(at))
        at = edited(at, 0.15, rng)
    assert linked(spark, family, [1, 2]) == [0] * 60


def test_many_groups_in_one_bucket(spark):
    rng, texts = random.Random(4), []
    passage = [f"p{i}" for i in range(40)]
    for g in range(30):                         # pairs with 18% of their words edited, and a passage that all share
        base = passage + [f"g{g}w{i}" for i in range(80)]
        texts += [" ".join(base), " ".join(edited(base, 0.18, rng))]
    assert linked(spark, texts, [1]) == [i - i % 2 for i in range(60)]


def test_recall_near_the_threshold(spark):
    rng, docs = random.Random(7), []
    for i in range(300):
        n = rng.choice([5, 10, 15, 25, 60, 150])
        a = [f"t{i}w{j}" for j in range(n)]
        b = edited(a, int((1 - rng.choice([0.8, 0.8, 0.85, 0.9])) * n + 1e-9) / n, rng)
        if i % 3 == 0:                          # evenly spread instead
            b = [f"new{i}w{j}" if j % 5 == 2 else w for j, w in enumerate(a)]
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = dict(N.near_duplicates(df).collect())
    assert all(got[2 * i] == 2 * i for i in range(300))
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) >= 297
