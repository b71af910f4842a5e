"""Queries for conversation serving (Q1..Q9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import serve as sv
from parley.operators.clean import clean_messages
from parley.plans import views as v
from parley.plans.catalog import register
from parley.sources.io import roster_snapshot

K = 3
BOT = v.BOT_ID
EOS = tx.EOS
SEP = " || "
NULL_MARK = "<null>"

# per message: cleaned text, or null when cleaning drops it
CLEANNULL_SQL = """,
cleannull AS (SELECT c.seq, c.channel, c.author_id, c.content, k.content AS clean
              FROM chat c LEFT JOIN cleaned k USING (seq)),
lagged AS (
  SELECT *, lag(clean, 1) OVER w AS l1, lag(clean, 2) OVER w AS l2
  FROM cleannull WINDOW w AS (PARTITION BY channel ORDER BY seq)),
prompts AS (
  SELECT seq, concat_ws('{eos}', l2, l1, clean) || '{eos}' AS prompt FROM lagged
  WHERE contains(content, '<@{bot}>') AND author_id <> '{bot}')
""".format(eos=EOS, bot=BOT)


@register("triggers", v.with_views("chat") + f"""
SELECT seq, author_id, content FROM chat WHERE contains(content, '<@{BOT}>') AND author_id <> '{BOT}'""")
def triggers(spark, sf):
    return sv.trigger_filter(v.chat(spark, sf), BOT).select("seq", "author_id", "content")


@register("latest_context", v.with_views("chat") + f"""
SELECT seq, CASE WHEN rn >= 3 THEN c2 || '{SEP}' || c1 || '{SEP}' || c0
                 WHEN rn = 2 THEN c1 || '{SEP}' || c0 ELSE c0 END AS history
FROM (SELECT seq, coalesce(content, '{NULL_MARK}') AS c0,
             coalesce(lag(content, 1) OVER w, '{NULL_MARK}') AS c1,
             coalesce(lag(content, 2) OVER w, '{NULL_MARK}') AS c2,
             row_number() OVER w AS rn
      FROM chat WINDOW w AS (PARTITION BY channel ORDER BY seq))""")
def latest_context(spark, sf):
    h = sv.latest_context(v.chat(spark, sf), K)
    return h.select("seq", F.array_join(F.col("history"), SEP, NULL_MARK).alias("history"))


def _prompts(spark, sf, platform="none"):
    return sv.prompts(v.chat(spark, sf), v.members(spark, sf), BOT, K, platform=platform)


@register("prompts", v.with_views("chat", "members", extra=v.CLEAN_SQL + CLEANNULL_SQL) + """
SELECT seq, prompt FROM prompts""")
def prompts(spark, sf):
    return _prompts(spark, sf)


_BOT_ROSTER = "chat AS (" + v.CHAT_SQL + "),\nmembers AS (" + v.MEMBERS_SQL + f"""
UNION ALL SELECT '{BOT}', 'bot', (SELECT max(c_custkey) + 1 FROM customer))"""


@register("prompts_bot_roster", "WITH " + _BOT_ROSTER + ",\n" + v.CLEAN_SQL.strip() + CLEANNULL_SQL + """
SELECT seq, prompt FROM prompts""")
def prompts_bot_roster(spark, sf):
    """The roster with the bot's own row: a mention of the bot reads as its name."""
    roster = roster_snapshot(v.members(spark, sf), (BOT, "bot"))
    return sv.prompts(v.chat(spark, sf), roster, BOT, K)


_WS_CHARS = " || ".join(f"chr({c})" for c in
                       (32, 9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203),
                        8232, 8233, 8239, 8287, 12288))
_DISCORD_CHAT = f"""
chat0 AS ({v.CHAT_SQL}),
chat AS (
  SELECT seq, channel, author_id, ts,
         trim(CASE WHEN strpos(content, '<@{BOT}>') > 0
                   THEN substr(content, 1, strpos(content, '<@{BOT}>') - 1) ||
                        substr(content, strpos(content, '<@{BOT}>') + {len(BOT) + 3})
                   ELSE content END, {_WS_CHARS}) AS content
  FROM chat0)"""


@register("prompts_discord", "WITH " + _DISCORD_CHAT.strip() + ",\nmembers AS (" + v.MEMBERS_SQL + "),\n"
          + v.CLEAN_SQL.strip() + CLEANNULL_SQL.replace("FROM chat c LEFT JOIN", "FROM chat0 c LEFT JOIN") + """
SELECT seq, prompt FROM prompts""")
def prompts_discord(spark, sf):
    # the documented platform branch: the bot's first mention is removed first
    return _prompts(spark, sf, platform="discord")


@register("payload", v.with_views("chat", "members", extra=v.CLEAN_SQL + CLEANNULL_SQL + f""",
pparts AS (SELECT seq, string_split(prompt, '{EOS}') AS pieces FROM prompts),
msgs AS (SELECT seq, pieces[1:len(pieces) - 1] AS m FROM pparts)""") + """
SELECT seq, to_json({'inputs': {'past_user_inputs': m[1:len(m) - 1],
                                'generated_responses': []::VARCHAR[],
                                'text': m[len(m)]}}) AS payload
FROM msgs""")
def payload(spark, sf):
    return _prompts(spark, sf).select("seq", sv.inference_payload(F.col("prompt")).alias("payload"))


RESPONSES_SQL = """
responses AS (
  SELECT conv_id AS seq, turn AS attempt, role, text,
         CASE WHEN role = 'assistant' THEN 'ok'
              WHEN length(text) % 5 = 0 THEN 'empty' ELSE 'retry' END AS status,
         CASE WHEN role <> 'assistant' AND length(text) % 5 <> 0
              THEN CAST(floor(floor(length(text) / 7.0) * 1.3) AS BIGINT) END AS wait_s
  FROM conversations),
stops AS (SELECT seq, min(CASE WHEN status <> 'retry' THEN attempt END) AS stop FROM responses GROUP BY seq),
ends AS (SELECT r.seq, r.status, r.text FROM responses r JOIN stops s ON r.seq = s.seq AND r.attempt = s.stop),
waits AS (SELECT r.seq, sum(wait_s) AS w FROM responses r JOIN stops s USING (seq)
          WHERE r.wait_s IS NOT NULL AND r.attempt <= 3 AND (s.stop IS NULL OR r.attempt < s.stop)
          GROUP BY r.seq)
"""


def response_log(spark, sf):
    c = v.table(spark, sf, "conversations")
    n = F.length("text")
    resp = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("generated_text")))) \
        .when(n % 5 == 0, F.to_json(F.struct(F.lit(sv.EMPTY_INPUT_ERROR).alias("error")))) \
        .otherwise(F.to_json(F.struct(F.lit("Model is loading").alias("error"),
                                      (n / 7.0).alias("estimated_time"))))
    return c.select(F.col("conv_id").alias("seq"), F.col("turn").alias("attempt"), resp.alias("response"))


@register("replies", "WITH " + RESPONSES_SQL + f"""
SELECT s.seq,
       CASE WHEN s.stop IS NULL OR s.stop > 3 THEN 'failed' ELSE e.status END AS outcome,
       CAST(least(coalesce(s.stop, 4), 4) AS BIGINT) AS retries,
       CAST(coalesce(w.w, 0) AS BIGINT) AS wait_s,
       CASE WHEN s.stop IS NULL OR s.stop > 3 THEN '{sv.FAILED_REPLY}'
            WHEN e.status = 'empty' THEN '...'
            WHEN trim(e.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) ||
                      chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) ||
                      chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) ||
                      chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) = ''
                 THEN '...'
            ELSE e.text END AS reply
FROM stops s LEFT JOIN ends e USING (seq) LEFT JOIN waits w USING (seq)""")
def replies(spark, sf):
    return sv.classify_response(response_log(spark, sf))


@register("link_members", v.with_views("chat", "members", extra=v.CLEAN_SQL + """,
lroster AS (SELECT name, id, row_number() OVER (ORDER BY pos) AS rk FROM members),
fold AS (
  SELECT seq, 0 AS step, content AS txt FROM cleaned
  UNION ALL
  SELECT f.seq, f.step + 1,
         CASE WHEN length(r.name) > 0 AND contains(f.txt, r.name)
              THEN replace(replace(f.txt, 'Hi', 'Hi @' || r.name), r.name, '<@' || r.id || '>')
              ELSE f.txt END
  FROM fold f JOIN lroster r ON r.rk = f.step + 1)""").replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT seq, txt AS reply FROM fold WHERE step = (SELECT count(*) FROM lroster)""")
def link_members(spark, sf):
    m = v.members(spark, sf)
    c = clean_messages(v.chat(spark, sf), m)
    return sv.link_members(c.select("seq", F.col("content").alias("reply")), m)


@register("replay", v.with_views("dialog", "members") + f"""
, dclean AS (
  SELECT seq, channel, author_id,
         replace(regexp_replace(regexp_replace(regexp_replace(content,
           'https?://[!$-_a-z]+', 'url', 'g'), '<:([^:\\n]*):[0-9]+>', '\\1', 'g'),
           '[^\\x00-\\x7F]+', ' ', 'g'), chr(10), ' ') AS c
  FROM dialog),
dn AS (SELECT seq, channel, author_id,
              CASE WHEN regexp_matches(c, '[^\\t\\n\\x0b\\f\\r\\x1c-\\x1f ]') THEN c END AS clean FROM dclean),
lagged AS (SELECT *, lag(clean, 1) OVER w AS l1, lag(clean, 2) OVER w AS l2
           FROM dn WINDOW w AS (PARTITION BY channel ORDER BY seq))
SELECT seq, concat_ws('{EOS}', l2, l1, clean) || '{EOS}' AS prompt FROM lagged WHERE author_id = 'user'""")
def replay(spark, sf):
    d = v.dialog(spark, sf)
    cleaned = sv.clean_or_null(d, v.members(spark, sf))
    h = sv.replay_history(cleaned.withColumn("content", F.col("clean")), K, conv="channel")
    return h.where(F.col("author_id") == "user") \
            .select("seq", sv.build_prompt(F.col("history")).alias("prompt"))
