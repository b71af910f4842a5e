"""Chat-shaped views over the driver's tables, in Spark and as DuckDB SQL.

The driver tables carry no chat tokens, so the message text is derived
from every ``events`` row by its id (one of eight shapes: mentions, URLs,
custom emojis, non-ASCII with newlines, blanks, nulls, the row's own
``props`` text, and a mixed line).  Every event row becomes one message;
nothing is filtered or capped, so the work grows with the table.

- ``chat(seq, channel, author_id, ts, content)`` from ``events``
- ``members(id, name, pos)`` from every ``customer`` row
- ``dialog(seq, conv_id, turn, author_id, channel, content)`` from
  ``conversations``
- ``docs(seq, channel, author_id, content)`` from ``documents``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed parameters of the derived views
BOT_ID = "1"
ROSTER_FROM = 3        # member ids start above this, so some authors and mentions have no roster row
TARGET_NAME = "Customer#000000007"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_from(table(spark, sf_dir, "events"))


def chat_from(e: DataFrame) -> DataFrame:
    """The chat projection of an events DataFrame (batch or stream)."""
    eid = F.col("event_id")
    s = lambda c: c.cast("string")
    shape = eid % 8
    content = (
        F.when(shape == 0, F.concat(F.lit("hello <@"), s(eid % 15), F.lit("> there <@00"),
                                    s(F.col("user_id")), F.lit(">")))
        .when(shape == 1, F.concat(F.lit("see https://ex.com/p?id="), s(eid), F.lit(" now")))
        .when(shape == 2, F.concat(F.lit("nice <:smile_"), s(eid % 5), F.lit(":"),
                                   s(eid + 1000), F.lit(">")))
        .when(shape == 3, F.concat(F.lit("café\nline "), F.col("event_type")))
        .when(shape == 4, F.when(eid % 16 == 4, F.lit("\t")).otherwise(F.lit("   ")))
        .when(shape == 5, F.lit(None).cast("string"))
        .when(shape == 6, F.col("props"))
        .otherwise(F.lit("mixed <@99999999> http://a.b/c <:x:1> ok"))
    )
    return e.select(eid.alias("seq"), F.col("event_type").alias("channel"),
                    s(F.col("user_id")).alias("author_id"), F.col("ts"),
                    content.alias("content"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        (F.col("c_custkey") + ROSTER_FROM).cast("string").alias("id"), F.col("c_name").alias("name"),
        F.col("c_custkey").cast("long").alias("pos"))


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("seq"),
                    "conv_id", "turn", F.col("role").alias("author_id"),
                    F.col("conv_id").cast("string").alias("channel"),
                    F.col("text").alias("content"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("lang").alias("channel"),
                    F.col("source").alias("author_id"), F.col("text").alias("content"))


# --- DuckDB equivalents (CTE bodies) ----------------------------------------
CHAT_SQL = r"""
SELECT event_id AS seq, event_type AS channel, CAST(user_id AS VARCHAR) AS author_id, ts,
  CASE event_id % 8
    WHEN 0 THEN 'hello <@' || CAST(event_id % 15 AS VARCHAR) || '> there <@00' || CAST(user_id AS VARCHAR) || '>'
    WHEN 1 THEN 'see https://ex.com/p?id=' || CAST(event_id AS VARCHAR) || ' now'
    WHEN 2 THEN 'nice <:smile_' || CAST(event_id % 5 AS VARCHAR) || ':' || CAST(event_id + 1000 AS VARCHAR) || '>'
    WHEN 3 THEN 'café' || chr(10) || 'line ' || event_type
    WHEN 4 THEN CASE WHEN event_id % 16 = 4 THEN chr(9) ELSE '   ' END
    WHEN 5 THEN NULL
    WHEN 6 THEN props
    ELSE 'mixed <@99999999> http://a.b/c <:x:1> ok'
  END AS content
FROM events
"""

MEMBERS_SQL = f"""
SELECT CAST(c_custkey + {ROSTER_FROM} AS VARCHAR) AS id, c_name AS name, CAST(c_custkey AS BIGINT) AS pos
FROM customer
"""

DIALOG_SQL = """
SELECT conv_id * 1000000 + turn AS seq, conv_id, turn, role AS author_id,
       CAST(conv_id AS VARCHAR) AS channel, text AS content
FROM conversations
"""

DOCS_SQL = """
SELECT doc_id AS seq, lang AS channel, source AS author_id, text AS content FROM documents
"""

# C1..C7 on chat, step by step (the chat view has no nested emoji tokens,
# so one global pass of the emoji pattern equals the rescanning loop).
CLEAN_SQL = r"""
c23 AS (
  SELECT seq, channel, author_id, ts,
         regexp_replace(regexp_replace(content, 'https?://[!$-_a-z]+', 'url', 'g'),
                        '<:([^:\n]*):[0-9]+>', '\1', 'g') AS content
  FROM chat WHERE content IS NOT NULL),
roster AS (SELECT regexp_replace(id, '^0+([0-9])', '\1') AS mid, arg_min(name, pos) AS mname
           FROM members WHERE id IS NOT NULL GROUP BY 1),
tok AS (
  SELECT seq, regexp_split_to_array(content, '<@[0-9]+>') AS pieces,
         regexp_extract_all(content, '<@([0-9]+)>', 1) AS ids FROM c23),
parts AS (
  SELECT seq, i, pieces[i] AS piece,
         CASE WHEN i <= len(ids) THEN regexp_replace(ids[i], '^0+([0-9])', '\1') END AS mid
  FROM tok, unnest(range(1, len(pieces) + 1)) AS r(i)),
c4 AS (
  SELECT p.seq, string_agg(p.piece || CASE WHEN p.mid IS NULL THEN '' ELSE coalesce(r.mname, 'Human') END,
                           '' ORDER BY p.i) AS content
  FROM parts p LEFT JOIN roster r ON p.mid = r.mid GROUP BY p.seq),
cleaned AS (
  SELECT c.seq, c.channel, c.author_id, c.ts,
         replace(regexp_replace(c4.content, '[^\x00-\x7F]+', ' ', 'g'), chr(10), ' ') AS content
  FROM c23 c JOIN c4 USING (seq)
  WHERE regexp_matches(replace(regexp_replace(c4.content, '[^\x00-\x7F]+', ' ', 'g'), chr(10), ' '),
                       '[^\t\n\x0b\f\r\x1c-\x1f ]'))
"""


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` prefix for an oracle query using the named views."""
    bodies = {"chat": CHAT_SQL, "members": MEMBERS_SQL, "dialog": DIALOG_SQL, "docs": DOCS_SQL}
    parts = [f"{n} AS ({bodies[n]})" for n in names]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
