"""Training sequences and batches (F1..F8)."""

from pyspark.sql import functions as F

from parley.functions.text import EOS
from parley.operators import sequences as sq


def rows(spark):
    return spark.createDataFrame(
        [(1, "r1", ["c1", "c2"]), (2, "r2 x", ["d1", "d2"]), (3, "r3", ["e1", "e2"]),
         (4, "r4", ["f1", "f2"]), (5, "r5", ["g1", "g2"])],
        "seq long, response string, ctx array<string>")


def test_training_and_prompt_text(spark):
    r = rows(spark).where("seq = 1").select(sq.training_text().alias("t"), sq.prompt_text().alias("p")).first()
    assert r.t == f"c2{EOS}c1{EOS}r1{EOS}"
    assert r.p == f"c2{EOS}c1{EOS}"


def test_vocab_and_encode(spark):
    texts = spark.createDataFrame([("a b a",), ("b a c",)], "content string")
    vocab = sq.build_vocab(texts)
    assert [(r.token, r.cnt, r.id) for r in vocab.orderBy("id").collect()] == [("a", 3, 2), ("b", 2, 3), ("c", 1, 4)]
    df = spark.createDataFrame([(1, ["a d", "b"]), (2, None), (3, ["", None]), (1, ["a d", "b"])],
                               "seq long, m array<string>")
    ids = [(r.seq, r.ids) for r in sq.encode(df, vocab, F.col("m")).collect()]
    assert sorted(ids) == [(1, [2, sq.OOV_ID, sq.EOS_ID, 3, sq.EOS_ID])] * 2 + [(2, []), (3, [sq.EOS_ID, sq.EOS_ID])]


def test_vocab_keeps_every_token(spark):
    texts = spark.range(60_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("content"))
    vocab = sq.build_vocab(texts)
    assert vocab.count() == 60_000 and vocab.agg(F.countDistinct("id"), F.max("id")).first() == (60_000, 60_001)
    df = texts.select(F.array("content").alias("m"))
    assert sq.encode(df, vocab, F.col("m")).where(F.array_contains("ids", sq.OOV_ID)).count() == 0


def test_encode_is_the_same_with_any_head(spark):
    texts = spark.createDataFrame([(i, [" ".join(f"w{(i * j) % 23}" for j in range(i % 9)), None, f"w{i % 30} new",
                                        "long" * (10 + i % 10)])
                                   for i in range(120)] + [(500, None), (501, [])], "seq long, m array<string>")
    vocab = sq.build_vocab(texts.where("seq < 90").select(F.explode("m").alias("content")))
    known = {r.token: r.id for r in vocab.collect()}
    want = {r.seq: [i for m in (r.m or []) for i in [*(known.get(t, sq.OOV_ID) for t in (m or "").split()), sq.EOS_ID]]
            for r in texts.collect()}
    for head in (200_000, 7, 1, 0):
        got = {r.seq: r.ids for r in sq.encode(texts, vocab, F.col("m"), head_tokens=head).collect()}
        assert got == want, head


def test_batches_and_padding(spark):
    df = rows(spark).withColumn("ids", F.sequence(F.lit(1), F.col("seq").cast("int")))
    b = sq.assign_batches(df, size=2)                      # sequential: 5 rows -> 2 full batches
    got = sorted((r.seq, r.batch_id, r.slot) for r in b.collect())
    assert got == [(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)]
    p = sq.pad_batches(b)
    widths = {r.seq: (r.width, r.input_ids) for r in p.collect()}
    assert widths[1] == (2, [1, 0]) and widths[4] == (4, [1, 2, 3, 4])
    assert sq.drop_wide_batches(p, limit=3).count() == 2
    plan = sq.step_plan(b).first()
    assert (plan.batches, plan.steps, plan.epochs) == (2, 2, 1)
    plan = sq.step_plan(b, max_steps=5).first()
    assert (plan.steps, plan.epochs) == (5, 3)


def test_shuffled_batches_are_a_permutation(spark):
    df = spark.range(1001).withColumnRenamed("id", "seq")
    b = sq.assign_batches(df, size=4, seed=3)
    assert b.count() == 1000
    assert b.groupBy("batch_id").count().where("count <> 4").count() == 0
    assert b.select("seq").distinct().count() == 1000
