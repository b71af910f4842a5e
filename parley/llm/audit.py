"""Filter interaction audit: what every order of the filters removes (op 12,
DataFrame functions only).

Filters fail a text or not, so all that matters of a document is its cell: the
part it belongs to, the mask of filters it fails and its labels.  Documents are
counted per cell; each cell then folds across the array of all filter orders
(``transform`` over the orders, ``aggregate`` along one), which gives one struct
per order and step, weighted by the cell's documents.  The cells of a part, at
most 2^filters times 4, are merged by elementwise sums.

Copies: documents of one text share their mask, so groups of copies are summed
before any row of them meets another by its text's digest, and a text's
smallest id is compared between those few sums.  A text held by a third of all
rows is one row per part and label by then.

Defined results for odd input
- null text: the empty text;  null part: the empty string
- null id: never smaller or larger than another, so it fails no copy filter and
  makes no other fail; it has no labels
- repeated rows and ids: every row counts; equal ids are not smaller than each
  other
- labels: a document is good (toxic) where any label row of its id says 1
- empty table: an empty result;  extra columns: not read
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
COPY = 4                 # bit of the filter that compares whole texts
MIN_WORDS = 100
MIN_DISTINCT = 80        # per cent of the words
MAX_UPPER = 10           # per cent of the code points
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def orders(n: int = len(LETTERS)) -> list[tuple[int, ...]]:
    return list(itertools.permutations(range(n)))


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text alone."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    sizes = F.get(F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d"))), F.lit(0))

    def bits(s: Column) -> Column:
        upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
        fails = [s["n"] < MIN_WORDS, 100 * s["d"] < MIN_DISTINCT * s["n"],
                 100 * upper > MAX_UPPER * F.length(text), F.regexp_like(text, F.lit("[#$%&*|]"))]
        return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return F.get(F.transform(F.array(sizes), bits), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): the documents of every cell."""
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                      F.sha2(text, 256).alias("digest"), text_mask(text).alias("mask")) \
        .groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    # copies of one part and label are one row from here on; `first` is the smallest id and its rows
    key = ["digest", "part", "mask", "good", "toxic"]
    held = one.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"]).groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passed = F.col("no_id") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    split = held.withColumn("passed", passed).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), F.col("passed").alias("n")),
            F.struct((F.col("mask") + (1 << COPY)).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))).alias("c"))
    return split.select("part", "good", "toxic", "c.*").groupBy("part", "mask", "good", "toxic") \
        .agg(F.sum("n").alias("n")).where("n > 0")


def fold(mask: Column, good: Column, toxic: Column, n: Column, n_filters: int = len(LETTERS)) -> Column:
    """One struct of counts per order and step, of the ``n`` documents of a cell."""
    order_array = F.lit([list(o) for o in orders(n_filters)])
    kind = "array<struct<filter:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, f: Column) -> Column:
        fails = F.getbit(mask, f).cast("int") == 1
        alive = acc["alive"]
        here = alive & fails
        row = F.struct(
            f.alias("filter"),
            F.when(alive & ~fails, n).otherwise(zero).alias("kept"),
            F.when(here, n).otherwise(zero).alias("removed"),
            F.when(~alive & fails, n).otherwise(zero).alias("redundant"),
            F.when(fails & (F.bit_count(mask) == 1), n).otherwise(zero).alias("unique_fails"),
            F.when(here & (good == 1), n).otherwise(zero).alias("good_lost"),
            F.when(here & (toxic == 1), n).otherwise(zero).alias("toxic_lost"))
        return F.struct((alive & ~fails).alias("alive"), F.concat(acc["rows"], F.array(row)).cast(kind).alias("rows"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("rows"))
    return F.flatten(F.transform(order_array, lambda o: F.aggregate(o, start, step, lambda acc: acc["rows"])))


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, counts..., shapley) of every order and step."""
    n = len(letters)
    folded = counted.select("part", fold(F.col("mask"), F.col("good"), F.col("toxic"), F.col("n"), n).alias("cell"))

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(
            x["filter"].alias("filter"), *[(x[c] + y[c]).alias(c) for c in COUNTS]))

    # at most 2^n * 4 cells a part: a bounded list
    merged = folded.groupBy("part").agg(F.collect_list("cell").alias("cells")).select(
        "part", F.aggregate(F.slice("cells", 2, 1 << (n + 2)), F.get("cells", F.lit(0)), add).alias("steps"))
    total = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.aggregate(
        F.filter("steps", lambda x: x["filter"] == f), F.lit(0).cast("bigint"), lambda a, x: a + x["removed"]))
    names = F.lit(["".join(letters[i] for i in o) for o in orders(n)])
    rows = merged.select("part", total.alias("shapley"), F.posexplode("steps").alias("at", "s"))
    return rows.select(
        "part", F.get(names, F.floor(F.col("at") / n).cast("int")).alias("filter_order"),
        (F.col("at") % n + 1).cast("int").alias("step"), *[F.col(f"s.{c}").alias(c) for c in COUNTS],
        F.get("shapley", F.col("s.filter")).alias("shapley"))
