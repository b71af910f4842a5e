import math

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, extra string"


def brute(rows, parts, entries, rounds, scale=256):
    """Plain Python integers; rows: (id, vector, label)."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    w = 8 // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    seeds = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[v[p * w:(p + 1) * w] for _, v in seeds] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        got = [[near(c[p], books[p])[0] for c in cut] for p in range(parts)]
        books = [[[sum(col) // len(own) for col in zip(*own)] if (own := [c[p] for c, e in zip(cut, got[p]) if e == k])
                  else books[p][k] for k in range(len(seeds))] for p in range(parts)]
    out = []
    for (i, _, lab), c in zip(kept, cut):
        ns = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, [e for e, _ in ns], sum(d for _, d in ns)))
    return books, out


def test_equals_plain_integers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * (1 + i % 3)).tolist(), i % 4 or None) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)]                    # a third are copies
    rows += [(0, [0.5] * 8, 2), (None, [-0.001] * 8, 2), (2000, None, 1), (2001, [], 1), (2002, [1.0] * 7, 1),
             (2003, [None] + [1.0] * 7, 1), (2004, [float("nan")] + [1.0] * 7, 1), (2005, [float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    books = codes.fit(df, parts=4, entries=16)
    got = codes.encode(df, books, carry=("vec_id", "label", "codes", "extra")).collect()
    want_books, want = brute([(i, v, lab) for i, v, lab in rows], 4, 16, 2)
    assert books.tolist() == want_books
    key = lambda r: (r[0] is None, r[0], str(r))
    assert sorted([(r["vec_id"], r["label"], r["codes"], r["error"]) for r in got], key=key) == sorted(want, key=key)
    assert got[0]["extra"] == "y"                                              # a clashing column is replaced, others stay


def test_limbs_are_exact():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-2**27, 2**27, (40, 5)), rng.integers(-2**27, 2**27, (30, 5))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    for bits in (None, 4, 9, 13):
        assert codes.exact_dots(a, b, bits).tolist() == want
        assert sum(x.astype(object) * 2 ** (8 * i) for i, x in enumerate(codes.limbs(a, 8))).tolist() == a.tolist()
    wide = codes.limb_bits(5)
    assert 5 * (2 ** wide - 1) ** 2 < 2 ** 53
    best, d = codes.nearest(np.array([[1, 1], [5, 5]]), np.array([[0, 0], [2, 2], [0, 2], [5, 5]]))
    assert best.tolist() == [0, 3] and d.tolist() == [2, 0]                    # ties: the first
    assert codes.integers(pa.array([[-0.001, 0.5]]), 256).tolist() == [[-1, 128]]


def test_few_none_and_too_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    books = codes.fit(empty)
    assert codes.encode(empty, books).count() == 0 and codes.digest(books) == codes.hashlib.sha256(b"").hexdigest()
    one = spark.createDataFrame([(5, [float(i) for i in range(16)], 1, "", "")], SCHEMA)
    books = codes.fit(one)
    row = codes.encode(one, books).select(codes.hex_code(codes.F.col("codes")).alias("c"), "error").first()
    assert books.shape == (16, 1, 1) and row["c"] == "00" * 16 and row["error"] == 0
    huge = spark.createDataFrame([(5, [1e12] * 16, 1, "", ""), (6, [-1e12] * 16, 1, "", "")], SCHEMA)
    with pytest.raises(Exception, match="beyond a long"):
        codes.fit(huge)
