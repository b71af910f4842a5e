"""Queries for cleaning (C1..C9) and standardisation (T1..T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import clean as cl
from parley.operators import standardize as st
from parley.plans import views as v
from parley.plans.catalog import register
from parley.session import materialize

RENAME_TARGET = "target-user"
RENAME_ID = "17"


def cleaned_chat(spark, sf):
    return cl.clean_messages(v.chat(spark, sf), v.members(spark, sf))


def cleaned_chat_once(spark, sf):
    """The cleaned chat for consumers that read it several times (window
    counts, quantiles, the window itself): computed once, lineage cut."""
    return materialize(cleaned_chat(spark, sf))


@register("clean_url", v.with_views("chat") + r"""
SELECT seq, regexp_replace(content, 'https?://[!$-_a-z]+', 'url', 'g') AS content
FROM chat WHERE content IS NOT NULL""")
def clean_url(spark, sf):
    c = cl.drop_null_content(v.chat(spark, sf))
    return c.select("seq", tx.replace_urls(F.col("content")).alias("content"))


@register("clean_emoji", v.with_views("chat") + r"""
SELECT seq, regexp_replace(content, '<:([^:\n]*):[0-9]+>', '\1', 'g') AS content
FROM chat WHERE content IS NOT NULL""")
def clean_emoji(spark, sf):
    c = cl.drop_null_content(v.chat(spark, sf))
    return c.select("seq", tx.replace_custom_emojis(F.col("content")).alias("content"))


@register("clean_ascii", v.with_views("chat") + r"""
SELECT seq, replace(regexp_replace(content, '[^\x00-\x7F]+', ' ', 'g'), chr(10), ' ') AS content
FROM chat WHERE content IS NOT NULL""")
def clean_ascii(spark, sf):
    c = cl.drop_null_content(v.chat(spark, sf))
    return c.select("seq", tx.newline_to_space(tx.blank_non_ascii(F.col("content"))).alias("content"))


@register("mention_names", v.with_views("chat", "members", extra=v.CLEAN_SQL) + """
SELECT seq, content FROM c4""")
def mention_names(spark, sf):
    c = cl.drop_null_content(v.chat(spark, sf))
    c = c.withColumn("content", tx.replace_custom_emojis(tx.replace_urls(F.col("content"))))
    return cl.resolve_mentions(c, v.members(spark, sf)).select("seq", "content")


@register("clean_all", v.with_views("chat", "members", extra=v.CLEAN_SQL) + """
SELECT seq, channel, author_id, content FROM cleaned""")
def clean_all(spark, sf):
    return cleaned_chat(spark, sf).select("seq", "channel", "author_id", "content")


@register("clean_docs", v.with_views("docs") + r"""
SELECT seq, content FROM (
  SELECT seq, replace(regexp_replace(regexp_replace(regexp_replace(content,
            'https?://[!$-_a-z]+', 'url', 'g'), '<:([^:\n]*):[0-9]+>', '\1', 'g'),
            '[^\x00-\x7F]+', ' ', 'g'), chr(10), ' ') AS content
  FROM docs WHERE content IS NOT NULL)
WHERE regexp_matches(content, '[^\t\n\x0b\f\r\x1c-\x1f ]')""")
def clean_docs(spark, sf):
    return cl.clean_text_only(v.docs(spark, sf)).select("seq", "content")


@register("missing_members", v.with_views("chat", "members") + """
SELECT DISTINCT author_id AS id FROM chat WHERE author_id IS NOT NULL
EXCEPT SELECT id FROM members""")
def missing_members(spark, sf):
    return st.missing_members(v.chat(spark, sf), v.members(spark, sf))


@register("extend_members", v.with_views("chat", "members") + """
SELECT id, name FROM members
UNION ALL
SELECT id, id AS name FROM (SELECT DISTINCT author_id AS id FROM chat WHERE author_id IS NOT NULL
                            EXCEPT SELECT id FROM members)""")
def extend_members(spark, sf):
    m = v.members(spark, sf)
    miss = st.missing_members(v.chat(spark, sf), m)
    return st.extend_members(m, miss).select("id", "name")


@register("target_rename", v.with_views("members") + f"""
SELECT id, CASE WHEN id = '{RENAME_ID}' THEN '{RENAME_TARGET}' ELSE name END AS name
FROM members""")
def target_rename(spark, sf):
    return st.assign_target(v.members(spark, sf), RENAME_TARGET, RENAME_ID).select("id", "name")


@register("profile", v.with_views("chat", "members", extra=v.CLEAN_SQL) + """
SELECT 'seq' AS "column", 'bigint' AS dtype, count(seq) AS non_null, count(*) AS "rows" FROM cleaned
UNION ALL SELECT 'channel', 'string', count(channel), count(*) FROM cleaned
UNION ALL SELECT 'author_id', 'string', count(author_id), count(*) FROM cleaned
UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts), count(*) FROM cleaned
UNION ALL SELECT 'content', 'string', count(content), count(*) FROM cleaned""")
def profile(spark, sf):
    return st.profile(cleaned_chat(spark, sf).select("seq", "channel", "author_id", "ts", "content"))


@register("csv_round_trip", v.with_views("chat") + """
SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, author_id, content FROM chat""")
def csv_round_trip(spark, sf):
    """S6 -> S1: the chat view written as CSV files (range-partitioned by seq,
    so file order is message order) and read back with file-order ``seq``."""
    from parley.sources import io
    from parley.streaming.stream import _scratch
    from parley.plans.q_sources import ordered_csv
    chat = v.chat(spark, sf).select("seq", "author_id", "content")
    path = ordered_csv(chat, "seq", _scratch(spark, "chat-csv"))
    return io.read_messages(spark, path, newest_first=False).select("seq", "author_id", "content")
