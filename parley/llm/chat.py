"""Chat formatting by schema fingerprint (op 3, DataFrame functions only).

A record is one JSON object in any of several layouts (prompt/response pairs,
instruction records, message lists, single turns).  Those of its nested field
paths that some layout uses are hashed to a fingerprint, whatever the types of
their values and whatever other fields there are; the fingerprint selects a
declarative mapping (``LAYOUTS``) that says where the turns are.  Turns are
then written with one template:

    <|turn|>ROLE<|text|>TEXT<|end|>

Control strings inside a role or text are broken by a backslash after their
first character, and backslashes are doubled, so reading back is exact.  The
loss mask is kept as segments (text, loss) whose concatenation is the formatted
text; it covers exactly the assistants' texts.

Defined results for odd input
- null text or role: empty;  a text that is a number, a list or an object: as it
  is written in JSON
- further fields of a record or message, such as ids: ignored
- a record with an unknown fingerprint, or that is not JSON: no turn; such
  records are returned by ``unmatched`` and counted by ``unknown_layouts``
- no turns: no conversation;  null conversation id: a conversation of its own
- ties in order: by role, then text; repeated rows: repeated turns
- very long texts: whole
- extra columns of the records: ignored
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# fixed values: control strings of the template and of common chat templates
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    ``fields``: name -> None for a scalar, or the names inside a list of objects.
    ``items``: (list field, role field, text field) for a list of messages.
    ``single``: (role or ``=field`` to read the role from, text field), in order.
    """
    name: str
    fields: dict
    items: tuple[str, str, str] | None = None
    single: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return sorted([*self.fields, *(f"{k}[].{x}" for k, inner in self.fields.items() for x in inner or ())])

    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(self.paths()).encode()).hexdigest()


LAYOUTS = [
    Layout("messages", {"messages": ("role", "content")}, items=("messages", "role", "content")),
    Layout("conversations", {"conversations": ("from", "value")}, items=("conversations", "from", "value"),
           roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("turn", {"role": None, "text": None}, single=(("=role", "text"),)),
    Layout("prompt", {"prompt": None}, single=(("user", "prompt"),)),
    Layout("response", {"response": None}, single=(("assistant", "response"),)),
    Layout("prompt-response", {"prompt": None, "response": None},
           single=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt-completion", {"prompt": None, "completion": None},
           single=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", {"instruction": None, "output": None},
           single=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction-input", {"instruction": None, "input": None, "output": None},
           single=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
]


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(record: Column) -> Column:
    """Hash of those nested field paths of a VARIANT record that a layout uses
    (null: not an object)."""
    used = sorted({p for x in LAYOUTS for p in x.paths()})
    lists = sorted({x.items[0] for x in LAYOUTS if x.items})
    top = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))

    def inside(field: str) -> Column:
        keys = F.flatten(F.transform(F.try_variant_get(record, f"$.{field}", "array<map<string,variant>>"), F.map_keys))
        return F.coalesce(F.transform(keys, lambda k: F.concat(F.lit(f"{field}[]."), k)), F.array().cast("array<string>"))

    inner = [inside(f) for f in lists]
    paths = F.array_sort(F.array_intersect(F.concat(top, *inner), F.array(*[F.lit(p) for p in used])))
    return F.sha2(F.array_join(paths, "\n"), 256)


_TURN = "array<struct<role string, text string>>"


def _mapped(layout: Layout, v: Column) -> Column:
    """The turns of a record in this layout."""
    if layout.items:
        field, role, text = layout.items
        got = F.try_variant_get(v, f"$.{field}", f"array<struct<`{role}` string, `{text}` string>>")

        def turn(m):
            r = m[role]
            for old, new in layout.roles:
                r = F.when(m[role] == old, F.lit(new)).otherwise(r)
            return F.struct(F.coalesce(r, F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))
        return F.transform(got, turn)
    return F.array(*[F.struct(
        (F.coalesce(F.try_variant_get(v, f"$.{role[1:]}", "string"), F.lit("")) if role[0] == "=" else F.lit(role))
        .alias("role"),
        F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit("")).alias("text"))
        for role, field in layout.single])


def canonical_turns(records: DataFrame, conv: str = "conv_id", order: str = "turn",
                    record: str = "record") -> DataFrame:
    """(conv_id, turn, pos, role, text): every turn of every JSON record."""
    v = F.try_parse_json(F.col(record))
    base = records.select(F.col(conv).alias("conv_id"), F.col(order).alias("turn"), v.alias("v")) \
        .withColumn("fp", fingerprint(F.col("v")))
    turns = F.lit(None).cast(_TURN)
    for layout in reversed(LAYOUTS):
        turns = F.when(F.col("fp") == layout.fingerprint(), _mapped(layout, F.col("v"))).otherwise(turns)
    return base.select("conv_id", "turn", F.posexplode(turns).alias("pos", "t")) \
        .select("conv_id", "turn", "pos", "t.role", "t.text")


def unmatched(records: DataFrame, record: str = "record") -> DataFrame:
    """The records that no layout matches, with their ``fingerprint`` (null: not a
    JSON object)."""
    known = [x.fingerprint() for x in LAYOUTS]
    fp = fingerprint(F.try_parse_json(F.col(record)))
    return records.withColumn("fingerprint", fp).where(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(known))


def unknown_layouts(records: DataFrame, record: str = "record") -> DataFrame:
    """(fingerprint, records) of records that no layout matches."""
    return unmatched(records, record).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments): one row per conversation.

    Turns are written before they are gathered, so a conversation's group
    holds its own output and nothing else.
    """
    one = turns.select(
        "conv_id", F.struct(
            "turn", "pos",
            F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT)).alias("head"),
            escape(F.coalesce("text", F.lit(""))).alias("body"),
            F.coalesce(F.col("role") == ASSISTANT, F.lit(False)).alias("loss")).alias("t"))
    got = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    seg = F.flatten(F.transform("t", lambda x: F.array(
        piece(x["head"], F.lit(False)), piece(x["body"], x["loss"]), piece(F.lit(END), F.lit(False)))))
    return got.select("conv_id", seg.alias("segments")) \
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.slice(F.split(formatted, "\\Q" + TURN + "\\E"), F.lit(2), F.size(F.split(formatted, "\\Q" + TURN + "\\E")))
    return F.transform(parts, lambda p: _let(
        F.split(F.substring_index(p, END, 1), "\\Q" + TEXT + "\\E"),
        lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text"))))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns, read back from ``format_chats`` output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        read_loss(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def as_records(rows: DataFrame) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) as JSON records of mixed layouts.

    The layout follows from the turn's number and role; roles outside a
    layout's own names are written as plain turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    kind = F.coalesce(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)), F.lit(0))
    named = role.isin("user", "assistant", "system")
    other = F.when(role == "user", F.lit("human")).when(role == "assistant", F.lit("gpt")).otherwise(role)
    js = lambda **f: F.to_json(F.struct(*[v.alias(k) for k, v in f.items()]))
    record = F.when(kind == 1, js(messages=F.array(F.struct(role.alias("role"), text.alias("content"))))) \
        .when((kind == 2) & named, js(conversations=F.array(F.struct(other.alias("from"), text.alias("value"))))) \
        .when((kind == 3) & (role == "user"), js(prompt=text)) \
        .when((kind == 3) & (role == "assistant"), js(response=text)) \
        .otherwise(js(role=role, text=text))
    return rows.select("conv_id", "turn", record.alias("record"))


CONVERSATION = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string")
