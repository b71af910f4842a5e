"""Queries for training sequences and batches (F1..F8).

Base rows: the dialogue table cleaned (C1..C7), every assistant turn as
a response with the two turns before it in its conversation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import clean as cl
from parley.operators import package as pk
from parley.operators import sequences as sq
from parley.plans import views as v
from parley.plans.catalog import register

K = 2
SEED = 42
TARGET_ROLE = "assistant"
EOS = tx.EOS

DIALOG_CLEAN_SQL = r"""
dclean AS (
  SELECT * FROM (
    SELECT seq, conv_id, turn, author_id, channel,
           replace(regexp_replace(regexp_replace(regexp_replace(content,
             'https?://[!$-_a-z]+', 'url', 'g'), '<:([^:\n]*):[0-9]+>', '\1', 'g'),
             '[^\x00-\x7F]+', ' ', 'g'), chr(10), ' ') AS content
    FROM dialog WHERE content IS NOT NULL)
  WHERE regexp_matches(content, '[^\t\n\x0b\f\r\x1c-\x1f ]')),
dwin AS (
  SELECT seq, author_id, content AS response,
         lag(content, 1) OVER w AS context1, lag(content, 2) OVER w AS context2,
         row_number() OVER w AS rn
  FROM dclean WINDOW w AS (PARTITION BY channel ORDER BY seq)),
base AS (SELECT seq, response, context1, context2 FROM dwin WHERE author_id = 'assistant' AND rn > 2)
"""

VOCAB_SQL = r"""
vtok AS (SELECT unnest(list_filter(regexp_split_to_array(content, '[ \t\n\x0b\f\r]+'), lambda t: t <> '')) AS token
         FROM dclean),
vocab AS (
  SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 1 AS INTEGER) AS id
  FROM (SELECT token, count(*) AS cnt FROM vtok GROUP BY token))
"""

ENCODE_SQL = r"""
msgs AS (SELECT seq, unnest([context2, context1, response]) AS msg,
                unnest([1, 2, 3]) AS i FROM base),
toks AS (SELECT seq, i, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS j
         FROM (SELECT seq, i, list_filter(regexp_split_to_array(msg, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS t
               FROM msgs)),
enc AS (SELECT seq, i, string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ',' ORDER BY j) AS s,
               count(*) AS n
        FROM toks LEFT JOIN vocab v ON toks.tok = v.token GROUP BY seq, i),
encoded AS (SELECT m.seq, string_agg(CASE WHEN e.s IS NULL THEN '0' ELSE e.s || ',0' END, ',' ORDER BY m.i) AS ids,
                   sum(coalesce(e.n, 0) + 1) AS n_ids
            FROM msgs m LEFT JOIN enc e USING (seq, i) GROUP BY m.seq),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(seq AS VARCHAR)), seq) - 1 AS pos,
                  count(*) OVER () AS n FROM encoded),
batched AS (SELECT seq, ids, n_ids, CAST(floor(pos / 4) AS BIGINT) AS batch_id, CAST(pos % 4 AS INTEGER) AS slot
            FROM ranked WHERE pos < (n // 4) * 4),
padded AS (SELECT *, CAST(max(n_ids) OVER (PARTITION BY batch_id) AS INTEGER) AS width FROM batched)
"""


def dialog_rows(spark, sf):
    d = cl.clean_text_only(v.dialog(spark, sf))
    return pk.package(d, TARGET_ROLE, K, ["channel"])


def dialog_vocab(spark, sf):
    return sq.build_vocab(cl.clean_text_only(v.dialog(spark, sf)))


def encoded_rows(spark, sf):
    rows = dialog_rows(spark, sf)
    return sq.encode(rows, dialog_vocab(spark, sf), sq.turns())


def batched_rows(spark, sf):
    return sq.assign_batches(encoded_rows(spark, sf), seed=SEED)


def _joined_ids(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_BASE = v.with_views("dialog", extra=DIALOG_CLEAN_SQL)


@register("training_text", _BASE + f"""
SELECT seq, context2 || '{EOS}' || context1 || '{EOS}' || response || '{EOS}' AS text FROM base""")
def training_text(spark, sf):
    return dialog_rows(spark, sf).select("seq", sq.training_text().alias("text"))


@register("prompt_text", _BASE + f"""
SELECT seq, context2 || '{EOS}' || context1 || '{EOS}' AS prompt FROM base""")
def prompt_text(spark, sf):
    return dialog_rows(spark, sf).select("seq", sq.prompt_text().alias("prompt"))


@register("vocab", _BASE + "," + VOCAB_SQL + "SELECT token, cnt, id FROM vocab")
def vocab(spark, sf):
    return dialog_vocab(spark, sf)


@register("encode", _BASE + "," + VOCAB_SQL + "," + ENCODE_SQL + "SELECT seq, ids FROM encoded")
def encode(spark, sf):
    return encoded_rows(spark, sf).select("seq", _joined_ids(F.col("ids")).alias("ids"))


@register("batches", _BASE + "," + VOCAB_SQL + "," + ENCODE_SQL + "SELECT seq, batch_id, slot FROM batched")
def batches(spark, sf):
    return batched_rows(spark, sf).select("seq", "batch_id", "slot")


@register("padded", _BASE + "," + VOCAB_SQL + "," + ENCODE_SQL + """
SELECT seq, batch_id, width, ids || repeat(',0', width - CAST(n_ids AS INTEGER)) AS input_ids FROM padded""")
def padded(spark, sf):
    p = sq.pad_batches(batched_rows(spark, sf))
    return p.select("seq", "batch_id", "width", _joined_ids(F.col("input_ids")).alias("input_ids"))


@register("wide_batches", _BASE + "," + VOCAB_SQL + "," + ENCODE_SQL + f"""
SELECT seq, batch_id, width FROM padded WHERE width <= {sq.MAX_WIDTH}""")
def wide_batches(spark, sf):
    p = sq.drop_wide_batches(sq.pad_batches(batched_rows(spark, sf)))
    return p.select("seq", "batch_id", "width")


@register("step_plan", _BASE + "," + VOCAB_SQL + "," + ENCODE_SQL + """
SELECT count(DISTINCT batch_id) AS batches, count(DISTINCT batch_id) AS steps, CAST(1 AS BIGINT) AS epochs
FROM batched""")
def step_plan(spark, sf):
    return sq.step_plan(batched_rows(spark, sf))
