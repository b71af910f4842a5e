"""Streaming queries (X1..X4), drained with ``availableNow`` and read back.

They read the events table as a file-source stream.  X1..X3 must equal their
batch twins, so they share the batch oracles; X4 gets its messages in order of
arrival, batch by batch, and its oracle replays that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.plans import views as v
from parley.plans.catalog import register
from parley.plans.q_serve import BOT, EOS, K
from parley.session import materialize
from parley.streaming import stream as st


def events_stream(spark, sf):
    schema = v.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return v.chat_from(raw)


@register("stream_clean")
def stream_clean(spark, sf):
    members = v.members(spark, sf)
    df = st.drain(spark, lambda out, ck: st.stream_clean(events_stream(spark, sf), members, out, ck),
                  "stream-clean")
    return df.select("seq", "channel", "author_id", "content")


@register("stream_prompts")
def stream_prompts(spark, sf):
    members = v.members(spark, sf)
    df = st.drain(spark, lambda out, ck: st.stream_prompts(events_stream(spark, sf), members, BOT, K, out, ck),
                  "stream-prompts")
    return df.select("seq", "prompt")


ARRIVALS = 6                                   # micro-batches, equal slices of the arrival times
DELAY, IDLE = "24 hours", "48 hours"
LATE_HOURS = {7: (3, 6), 11: (5, 120)}         # event_id % m == r: so many hours late


def arrivals(spark, sf):
    """The chat with a channel per event type and author, and the micro-batch that
    brings each message: some are hours late, some days."""
    chat = v.chat(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")) \
        .withColumn("channel", F.concat_ws("/", "channel", "author_id"))
    hours = F.lit(0)
    for m, (r, h) in LATE_HOURS.items():
        hours = F.when(F.col("seq") % m == r, h).otherwise(hours)
    x = chat.withColumn("_at", F.unix_micros("ts") + hours.cast("long") * 3_600_000_000)
    first, last = x.agg(F.min("_at"), F.max("_at")).first()
    if first is None:
        return x.drop("_at").withColumn("arrival", F.lit(0))
    slot = F.floor((F.col("_at") - first) / F.lit((last - first + 1) / ARRIVALS))
    return x.withColumn("arrival", F.least(slot, F.lit(ARRIVALS - 1)).cast("int")).drop("_at")


_LATE_SQL = v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
came AS (
  SELECT c.seq, c.channel || '/' || c.author_id AS channel, c.author_id, c.content, epoch_us(c.ts) AS us, k.content AS clean,
         epoch_us(c.ts) + 3600000000 * {"".join(f"CASE WHEN c.seq % {m} = {r} THEN {h} ELSE " for m, (r, h) in
                                                reversed(LATE_HOURS.items()))}0 {"END " * len(LATE_HOURS)} AS came_at
  FROM chat c LEFT JOIN cleaned k USING (seq)),
span AS (SELECT min(came_at) AS first, max(came_at) AS last FROM came),
dealt AS (SELECT came.*, least(floor((came_at - first) / ((last - first + 1) / {ARRIVALS})), {ARRIVALS - 1}) AS b FROM came, span),
grid AS (SELECT unnest(range(0, {ARRIVALS + 1})) AS b),
marks AS (SELECT g.b, max(d.us) - 86400000000 AS low FROM grid g LEFT JOIN dealt d ON d.b < g.b GROUP BY g.b),
seen AS (SELECT d.*, coalesce(d.us < m.low, false) AS late FROM dealt d JOIN marks m ON d.b = m.b),
ok AS (SELECT * FROM seen WHERE NOT late),
-- a channel is forgotten after batch b if its newest row is too old for the next watermark
lasts AS (SELECT channel, b, max(max(us)) OVER (PARTITION BY channel ORDER BY b) AS last FROM ok GROUP BY channel, b),
gaps AS (SELECT channel, b, last, lead(b) OVER (PARTITION BY channel ORDER BY b) AS next_b FROM lasts),
forgot AS (SELECT g.channel, g.b FROM gaps g
           WHERE EXISTS (SELECT 1 FROM marks m WHERE m.b > g.b AND m.b <= coalesce(g.next_b, {ARRIVALS}) AND g.last < m.low - 172800000000)),
life AS (SELECT o.*, (SELECT count(*) FROM forgot f WHERE f.channel = o.channel AND f.b < o.b) AS life FROM ok o),
asked AS (SELECT * FROM life WHERE contains(content, '<@{BOT}>') AND author_id <> '{BOT}'),
heard AS (
  SELECT a.seq, x.clean, x.us, x.seq AS xs,
         row_number() OVER (PARTITION BY a.seq ORDER BY x.us DESC, x.seq DESC) AS r
  FROM asked a JOIN life x ON x.channel = a.channel AND x.life = a.life AND x.b <= a.b
                          AND (x.us < a.us OR (x.us = a.us AND x.seq <= a.seq)))
""")


@register("stream_late_prompts", _LATE_SQL + f"""
SELECT seq, 'answered' AS outcome,
       concat_ws('{EOS}', string_agg(clean, '{EOS}' ORDER BY us, xs), '') AS prompt
FROM heard WHERE r <= {K} GROUP BY seq
UNION ALL SELECT seq, 'late', NULL FROM seen WHERE late""")
def stream_late_prompts(spark, sf):
    """X4 over messages in order of arrival, one micro-batch per slice, the stream
    started anew for each: the prompts, and the messages after the watermark."""
    members, chat = v.members(spark, sf), materialize(arrivals(spark, sf))
    src, out, ck = (st._scratch(spark, f"late-{n}") for n in ("in", "out", "ck"))
    schema = chat.drop("arrival").schema
    for i in range(ARRIVALS):
        chat.where(F.col("arrival") == i).drop("arrival").write.parquet(f"{src}/{i}")
        q = st.stream_late_prompts(spark.readStream.schema(schema).parquet(f"{src}/*"), members, BOT, K, out, ck,
                                   delay=DELAY, idle=IDLE)
        q.awaitTermination()
    prompts = spark.read.schema("seq long, prompt string").parquet(out)
    late = spark.read.schema("seq long").parquet(st.late_dir(out))
    return prompts.select("seq", F.lit("answered").alias("outcome"), "prompt").unionByName(
        late.select("seq", F.lit("late").alias("outcome"), F.lit(None).cast("string").alias("prompt")))


@register("stream_triggers")
def stream_triggers(spark, sf):
    df = st.drain(spark, lambda out, ck: st.stream_triggers(events_stream(spark, sf), BOT, out, ck),
                  "stream-triggers")
    return df.select("seq", "author_id", "content")
