"""Cleaning edge cases (C1..C9)."""

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import clean as cl


def one(spark, expr, text):
    df = spark.createDataFrame([(text,)], "content string")
    return df.select(expr(F.col("content")).alias("c")).first()["c"]


def test_url(spark):
    assert one(spark, tx.replace_urls, "<http://x.y/~u>") == "<url~u>"
    assert one(spark, tx.replace_urls, "http://é x") == "http://é x"
    assert one(spark, tx.replace_urls, "a https://b.c/d?e=1&f=2 g") == "a url g"
    long_url = "http://" + "a" * 20000
    assert one(spark, tx.replace_urls, long_url) == "url"


def test_emoji(spark):
    e = tx.replace_custom_emojis
    assert one(spark, e, "<:a b:c:12>") == "a b"
    assert one(spark, e, "<::1>") == ""
    assert one(spark, e, "<:<:a:1>:b <:c:3>") == "b <"
    assert one(spark, e, "<a:wave:1>") == "<a:wave:1>"
    assert one(spark, e, "x <:smile:123> y <:wink:9>") == "x smile y wink"
    assert one(spark, e, "no colon") == "no colon"


def test_non_ascii_and_newlines(spark):
    assert one(spark, tx.blank_non_ascii, "a😀é b") == "a  b"
    assert one(spark, tx.newline_to_space, "a\nb\rc") == "a b\rc"


def test_blank(spark):
    df = spark.createDataFrame([("\t",), ("\x1c",), ("  x ",), ("   ",), ("",)], "content string")
    kept = [r[0] for r in df.where(tx.is_not_blank(F.col("content"))).collect()]
    assert kept == ["  x "]


def test_mentions(spark):
    msgs = spark.createDataFrame([(1, "yo <@1> and <@007> <@9>!"), (2, "<@!1> stays"), (3, "plain")],
                                 "seq long, content string")
    members = spark.createDataFrame([("1", "Ann", 0), ("7", "Bob", 1), ("7", "Dup", 2)],
                                    "id string, name string, pos long")
    out = {r[0]: r[1] for r in cl.resolve_mentions(msgs, members).collect()}
    assert out == {1: "yo Ann and Bob Human!", 2: "<@!1> stays", 3: "plain"}


def test_clean_messages_order_and_drops(spark):
    msgs = spark.createDataFrame(
        [(1, "a", "hi <@1> http://x.y"), (2, "a", None), (3, "b", "😀"), (4, "b", "ok\nthen")],
        "seq long, author_id string, content string")
    members = spark.createDataFrame([("1", "Ann", 0)], "id string, name string, pos long")
    out = sorted((r.seq, r.content) for r in cl.clean_messages(msgs, members).collect())
    assert out == [(1, "hi Ann url"), (4, "ok then")]


def test_clean_idempotent_on_plain_text(spark):
    msgs = spark.createDataFrame([(i, "u", f"plain text {i}") for i in range(20)],
                                 "seq long, author_id string, content string")
    members = spark.createDataFrame([], "id string, name string, pos long")
    once = cl.clean_messages(msgs, members)
    twice = cl.clean_messages(once, members)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_rows_of_several_sessions_stay_apart(spark):
    members = spark.createDataFrame([("1", "Ann", 0)], "id string, name string, pos long")
    rows = [("s1", 0, "hi <@1>"), ("s2", 0, "yo <@1> <@2>"), ("s1", 1, "<@1>"), ("s2", 1, "<@1>"), ("s2", 1, "<@1>")]
    df = spark.createDataFrame(rows, "session string, seq long, content string")
    got = sorted(tuple(r) for r in cl.clean_messages(df, members).collect())
    assert got == [("s1", 0, "hi Ann"), ("s1", 1, "Ann"), ("s2", 0, "yo Ann Human"), ("s2", 1, "Ann"), ("s2", 1, "Ann")]
