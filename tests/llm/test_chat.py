import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from parley.llm import chat as C


def test_layouts(spark):
    rows = [(1, 0, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}'),
            (1, 1, '{"conversations":[{"from":"human","value":"b"},{"from":"gpt","value":"c"}]}'),
            (1, 2, '{"prompt":"d","response":"e"}'), (1, 3, '{"instruction":"f","output":"g"}'),
            (1, 4, '{"input":"i","instruction":"h","output":"j"}'), (1, 5, '{"text":null,"role":"tool"}'),
            (2, 0, '{"who":1}'), (2, 1, "not json"), (2, 2, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    got = [(r["role"], r["text"]) for r in C.canonical_turns(df).orderBy("turn", "pos").collect()]
    assert got == [("user", "a"), ("assistant", ""), ("user", "b"), ("assistant", "c"), ("user", "d"),
                   ("assistant", "e"), ("user", "f"), ("assistant", "g"), ("system", "h"), ("user", "i"),
                   ("assistant", "j"), ("tool", "")]
    assert sum(r["records"] for r in C.unknown_layouts(df).collect()) == 3


def test_round_trip(spark):
    rng = random.Random(1)
    bits = C.CONTROLS + ["\\", "\\\\", "<", "[", "\n", "é", "x ", "|turn|>", "<\\|turn|>", "\"", "\u0001"]
    rows, want = [], defaultdict(list)
    for conv in (1, 2, 3, None):
        for turn in range(40):
            role = rng.choice(["user", "assistant", "system", "od" + rng.choice(bits) + "d"])
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(7)))
            rows.append((conv, turn, role, text))
            want[conv].append((role, text))
    df = spark.createDataFrame(rows, C.CONVERSATION)
    chats = C.format_chats(C.canonical_turns(C.as_records(df)))
    for r in chats.withColumn("turns", C.read_turns(F.col("formatted"))).withColumn(
            "loss", C.read_loss(F.col("segments"))).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    for r in C.digests(chats).collect():
        said = "".join(f"{role}\n{t}\n" for role, t in want[r["conv_id"]])
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["n_turns"] == 40


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, None, "user", "z" * 300_000)]
    got = {r["conv_id"]: r for r in C.digests(C.format_chats(C.canonical_turns(C.as_records(
        spark.createDataFrame(rows, C.CONVERSATION).withColumn("record", F.lit("x")))))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0
    assert got[2]["formatted_chars"] == 300_000 + len("user") + len(C.TURN + C.TEXT + C.END)
    assert C.format_chats(C.canonical_turns(C.as_records(spark.createDataFrame([], C.CONVERSATION)))).count() == 0


def test_extra_fields_and_mixed_types(spark):
    rows = [(1, 0, '{"messages":[{"role":"user","content":"a"}],"id":7}'),
            (1, 1, '{"messages":[{"role":"user","content":5},{"content":"b","role":"assistant","name":"x"}],"meta":{"k":[1]}}'),
            (1, 2, '{"conversations":[{"from":"human","value":true},{"from":"gpt","value":null},{"from":"gpt"}],"lang":"en"}'),
            (1, 3, '{"prompt":["d",1],"response":{"t":"e"},"score":0.5,"tags":["x"]}'),
            (1, 4, '{"text":3.5,"role":"tool","messages_id":1}'),
            (2, 0, '{"messages":"none"}'), (2, 1, '{"messages":[]}'), (2, 2, '{"prompt":"a","text":"b"}'),
            (2, 3, '["a"]'), (2, 4, '{"messages":[1,{"role":"user","content":"x"}]}')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    got = [(r["turn"], r["role"], r["text"]) for r in C.canonical_turns(df).orderBy("turn", "pos").collect()]
    assert got == [(0, "user", "a"), (1, "user", "5"), (1, "assistant", "b"), (2, "user", "true"), (2, "assistant", ""),
                   (2, "assistant", ""), (3, "user", '["d",1]'), (3, "assistant", '{"t":"e"}'), (4, "tool", "3.5")]
    assert sorted(r["turn"] for r in C.unmatched(df).collect()) == [0, 1, 2, 3, 4]
    assert {r["conv_id"] for r in C.unmatched(df).collect()} == {2}
