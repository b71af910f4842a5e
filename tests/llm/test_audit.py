import itertools
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from parley.llm import audit

DOCS = "doc_id long, text string, lang string, source string, mask int, part string, good string"
LABELS = "doc_id long, quality int, toxic int, extra string"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((lang or "", i in good, i in toxic, [
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), copy]))
    out = defaultdict(Counter)
    shapley = Counter()
    for part, g, x, f in rows:
        for o in itertools.permutations(range(5)):
            name, gone = "".join("ABCDE"[k] for k in o), False
            for s, k in enumerate(o):
                c = out[part, name, s + 1]
                here = f[k] and not gone
                c["removed"] += here
                c["redundant"] += f[k] and gone
                c["unique_fails"] += f[k] and sum(f) == 1
                c["good_lost"] += here and g
                c["toxic_lost"] += here and x
                shapley[part, k] += here
                gone |= f[k]
                c["kept"] += not gone
    return {(p, o, s): tuple(c[k] for k in audit.COUNTS) + (shapley[p, "ABCDE".index(o[s - 1])],)
            for (p, o, s), c in out.items()}


def test_against_every_order(spark):
    many = " ".join(f"w{i}" for i in range(120))
    texts = [many, many + " #", many.upper(), "a " * 150, "short", "", None, "A B C", " \t\x0b\n ", "é x " * 120,
             many + " " + "Z" * 400]
    docs = [(i, texts[i % len(texts)], ["en", "de", None][i % 3]) for i in range(60)]
    docs += [(100 + i, many, "en") for i in range(40)]                       # a large group of copies
    docs += [(0, many, "en"), (0, many, "de"), (None, many, "en"), (None, None, None), (7, "only once", "fr")]
    labels = [(i, i % 2, (i % 5 == 0) * 1) for i in range(0, 120, 2)] + [(1, None, 1), (1, 1, None), (None, 1, 1), (0, 1, 0)]
    d = spark.createDataFrame([(*r, "s", 3, "p", "g") for r in docs], DOCS).repartition(5)
    x = spark.createDataFrame([(*r, "e") for r in labels], LABELS).repartition(3)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in [*audit.COUNTS, "shapley"])
           for r in audit.audit(audit.cells(d, x)).collect()}
    assert got == brute(docs, labels) and len(got) == 600 * 4


def test_empty(spark):
    d, x = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(audit.cells(d, x)).count() == 0
    one = spark.createDataFrame([(1, None, None, "s", 0, "", "")], DOCS)
    rows = audit.audit(audit.cells(one, x)).collect()
    assert len(rows) == 600 and sum(r["removed"] for r in rows) == 120 and {r["part"] for r in rows} == {""}


def test_no_python_and_copies_summed_first(spark):
    d = spark.createDataFrame([(i, "same", "en", "", 0, "", "") for i in range(500)], DOCS)
    x = spark.createDataFrame([], LABELS)
    plan = audit.audit(audit.cells(d, x))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert audit.cells(d, x).agg(F.sum("n")).first()[0] == 500
