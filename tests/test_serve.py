"""Serving: prompts, payload, reply outcomes, member links."""

import json

from pyspark.sql import functions as F

from parley.functions.text import EOS
from parley.operators import serve as sv


def test_link_members_example(spark):
    members = spark.createDataFrame([("1", "Ann", 0), ("2", "Bob", 1)], "id string, name string, pos long")
    df = spark.createDataFrame([(1, "Hi Ann and Bob"), (2, "nobody here"), (3, None)], "seq long, reply string")
    got = {r.seq: r.reply for r in sv.link_members(df, members).collect()}
    assert got == {1: "Hi @<@2> @<@1> <@1> and <@2>", 2: "nobody here", 3: None}
    fold = df.select("seq", sv.link_members_fold(F.col("reply"), sv.roster_literal(members)).alias("r"))
    assert {r.seq: r.r for r in fold.collect()} == got


def test_link_members_cascade_matches_fold(spark):
    # a later member's name appears only after an earlier rewrite
    members = spark.createDataFrame([("5", "Al", 0), ("9", "<@5>", 1), ("3", "Hi @", 2)],
                                    "id string, name string, pos long")
    df = spark.createDataFrame([(1, "Hi Al"), (2, "Al Al Hi")], "seq long, reply string")
    a = {r.seq: r.reply for r in sv.link_members(df, members).collect()}
    b = {r.seq: r.r for r in df.select("seq", sv.link_members_fold(
        F.col("reply"), sv.roster_literal(members)).alias("r")).collect()}
    assert a == b


def test_strip_and_blank(spark):
    df = spark.createDataFrame([("  <@1> hello <@1> 　",), ("\t",)], "t string")
    r = df.select(sv.strip_bot_mention(F.col("t"), "1").alias("s"), sv.blank_reply(F.col("t")).alias("b")).collect()
    assert r[0].s == "hello <@1>"
    assert r[1].b == "..."


def test_prompts_and_payload(spark):
    msgs = spark.createDataFrame(
        [(1, "a", "first", "c"), (2, "b", "   ", "c"), (3, "c", "hey <@1> you", "c"), (4, "1", "<@1> me", "c")],
        "seq long, author_id string, content string, channel string")
    members = spark.createDataFrame([("1", "Bot", 0)], "id string, name string, pos long")
    p = sv.prompts(msgs, members, "1", 3).collect()
    assert [(r.seq, r.prompt) for r in p] == [(3, f"first{EOS}hey Bot you{EOS}")]
    pay = json.loads(spark.createDataFrame([(p[0].prompt,)], "p string")
                     .select(sv.inference_payload(F.col("p"))).first()[0])
    assert pay == {"inputs": {"past_user_inputs": ["first"], "generated_responses": [], "text": "hey Bot you"}}
    d = sv.prompts(msgs, members, "1", 3, platform="discord").collect()
    assert [(r.seq, r.prompt) for r in d] == [(3, f"first{EOS}hey  you{EOS}")]


def test_all_blank_prompt(spark):
    msgs = spark.createDataFrame([(1, "a", "\t", "c"), (2, "b", "<@1>", "c")],
                                 "seq long, author_id string, content string, channel string")
    members = spark.createDataFrame([], "id string, name string, pos long")
    p = sv.prompts(msgs, members, "1", 2, platform="discord").first()
    assert p.prompt == EOS


def test_classify_response(spark):
    err = lambda t: json.dumps({"error": "loading", "estimated_time": t})
    log = spark.createDataFrame([
        (1, 0, err(10.7)), (1, 1, json.dumps({"generated_text": "  "})),
        (2, 0, json.dumps({"error": sv.EMPTY_INPUT_ERROR})),
        (3, 0, err(1)), (3, 1, err(1)), (3, 2, err(1)), (3, 3, err(1)), (3, 4, json.dumps({"generated_text": "late"})),
        (4, 0, json.dumps({"generated_text": "hello"})),
    ], "seq long, attempt long, response string")
    got = {r.seq: (r.outcome, r.retries, r.wait_s, r.reply) for r in sv.classify_response(log).collect()}
    assert got[1] == ("ok", 1, 13, "...")
    assert got[2] == ("empty", 0, 0, "...")
    assert got[3] == ("failed", 4, 4, sv.FAILED_REPLY)
    assert got[4] == ("ok", 0, 0, "hello")


def test_link_members_cascades_like_the_fold(spark):
    # names that cascade, repeat, hold pieces of each other, or are shorter than a piece
    members = spark.createDataFrame(
        [("5", "Al", 0), ("9", "<@5>", 1), ("3", "Hi @", 2), ("4", "Bo", 3), ("6", "Al", 4), (None, "Cy", 5),
         ("7", "Customer#01", 6), ("8", "Customer#011", 7), ("1", None, 8), ("2", "", 9)],
        "id string, name string, pos long")
    texts = ["Hi Al", "Al Al Hi Bo", "nobody", None, "Cy and Bo", "Hi Customer#011 and Customer#01", "", "Hi Al"]
    df = spark.createDataFrame([(i if i != 6 else None, t) for i, t in enumerate(texts)] + [(1, "Hi Al")],
                               "seq long, reply string")
    got = sorted((tuple(r) for r in sv.link_members(df, members).collect()), key=str)
    exp = sorted((tuple(r) for r in df.select("seq", sv.link_members_fold(
        F.col("reply"), sv.roster_literal(members)).alias("r")).collect()), key=str)
    assert got == exp
    none = sv.link_members(df, members.where("false")).select("reply").collect()
    assert sorted(map(str, (r[0] for r in none))) == sorted(map(str, (r[1] for r in df.collect())))


def test_link_members_random_rosters_equal_the_fold(spark):
    import random
    for seed in range(4):
        rnd = random.Random(seed)
        word = lambda n: "".join(rnd.choice(["a", "b", "Hi", "@", "<", ">", "1", "2", " "]) for _ in range(rnd.randint(1, n)))
        roster = [(rnd.choice([word(3), str(i)]), word(4), i) for i in range(25)]
        roster += [("1a", roster[0][1], 30), ("12", roster[0][1], 31), (roster[1][1], "2", 32)]
        members = spark.createDataFrame(roster, "id string, name string, pos long")
        df = spark.createDataFrame([(i, word(8)) for i in range(40)], "seq long, reply string")
        got = sorted(map(tuple, sv.link_members(df, members).collect()))
        exp = sorted(map(tuple, df.select("seq", sv.link_members_fold(F.col("reply"), sv.roster_literal(members))).collect()))
        assert got == exp, seed


def test_link_members_joins_do_not_grow_with_the_rewrites(spark, monkeypatch):
    calls = []
    plain = sv._names_in
    monkeypatch.setattr(sv, "_names_in", lambda *a: calls.append(1) or plain(*a))
    members = spark.createDataFrame([(str(i), f"name{i:02d};", i) for i in range(40)], "id string, name string, pos long")
    df = spark.createDataFrame([(1, "Hi " + " ".join(f"name{i:02d};" for i in range(40)))], "seq long, reply string")
    got = sv.link_members(df, members).first().reply
    assert got.endswith(" ".join(f"<@{i}>" for i in range(40))) and len(calls) == 2


def test_link_members_tells_numbered_names_apart(spark, monkeypatch):
    # a text meets the names that share a piece with it: their number must not grow with the roster
    met, names_in = [], sv._names_in
    monkeypatch.setattr(sv, "_names_in", lambda texts, lookup, *rest: met.append(lookup) or names_in(texts, lookup, *rest))
    number = F.col("id") * 7919 % 1_000_000_007
    members = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"),
                                         F.format_string("Customer#%09d", number).alias("name"))
    df = spark.createDataFrame([(1, "Hi Customer#000015838, Customer#00001583"), (2, "to Customer#158372081Customer#000000000")],
                               "seq long, reply string")
    got = {r.seq: r.reply for r in sv.link_members(df, members).collect()}
    assert got == {1: "Hi @<@2> <@2>, Customer#00001583", 2: "to <@19999><@0>"}
    assert all(lookup.groupBy("gram").count().agg(F.max("count")).first()[0] <= 3 for lookup in met)
