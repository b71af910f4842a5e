"""Conversation serving as batch tables Q1..Q9.

The live handler answers a message that mentions the bot with a prompt
built from the newest messages of its channel.  Here every trigger of a
message table gets its prompt at once: each message is cleaned exactly
once (a projection plus the mention lookup), then a window collects the
k newest cleaned texts per trigger.  Messages that clean to nothing keep
their place in the window and vanish from the prompt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import schemas
from parley.functions import text as tx
from parley.operators.clean import resolve_mentions
from parley.operators.windows import preceding

# fixed values of the original tool
EMPTY_INPUT_ERROR = "Empty input is invalid"
BLANK_REPLY = "..."
FAILED_REPLY = "\U0001F916(failed to load, please try again later)"
MAX_RETRIES = 3
WAIT_FACTOR = 1.3
MAX_ROSTER = 10_000   # bound of the literal roster of link_members_fold

_EOS_SPLIT = r"\Q" + tx.EOS + r"\E"


def trigger_filter(messages: DataFrame, bot_id: str) -> DataFrame:
    """Q1: messages that mention the bot, not written by it."""
    token = f"<@{bot_id}>"
    return messages.where(F.col("content").contains(token) &
                          (F.col("author_id").isNull() | (F.col("author_id") != bot_id)))


def strip_bot_mention(c: Column, bot_id: str) -> Column:
    """Q3: drop the first ``<@bot>``, then strip (Unicode whitespace)."""
    token = f"<@{bot_id}>"
    pos = F.locate(token, c)
    cut = F.when(pos > 0, F.concat(F.substring(c, F.lit(1), pos - 1),
                                   F.substring(c, pos + len(token), F.length(c) + 1))) \
           .otherwise(c)
    return tx.strip_unicode(cut)


def clean_or_null(messages: DataFrame, members: DataFrame, platform: str = "none",
                  bot_id: str | None = None, col: str = "content", out: str = "clean") -> DataFrame:
    """C1..C7 per message, but a dropped message keeps its row with ``out`` null."""
    x = messages.withColumn(out, F.col(col))
    if platform == "discord":
        if bot_id is None:
            raise ValueError("platform 'discord' needs the bot id")
        x = x.withColumn(out, strip_bot_mention(F.col(out), bot_id))
    x = x.withColumn(out, tx.replace_custom_emojis(tx.replace_urls(F.col(out))))
    x = resolve_mentions(x, members, out)
    c = tx.newline_to_space(tx.blank_non_ascii(F.col(out)))
    return x.withColumn(out, F.when(tx.is_not_blank(c), c))


def latest_context(messages: DataFrame, k: int, by: Sequence[str] = ("channel",),
                   order: str | Sequence[str] = "seq", value: str = "content",
                   out: str = "history") -> DataFrame:
    """Q2: the newest ``k`` values of the scope up to and including each
    row, oldest first (shorter at the start of a scope)."""
    w = preceding(messages, max(k - 1, 0), list(by), order, value, "_prev")
    return w.withColumn(out, F.concat(F.reverse(F.col("_prev")), F.array(F.col(value)))) \
            .drop("_prev", "n_before")


def build_prompt(history: Column, eos: str = tx.EOS) -> Column:
    """Q4: cleaned texts oldest first joined by EOS, plus a trailing EOS;
    null (dropped) messages vanish, all dropped gives just EOS."""
    kept = F.filter(history, lambda h: h.isNotNull())
    return F.concat(F.array_join(kept, eos), F.lit(eos))


def prompts(messages: DataFrame, members: DataFrame, bot_id: str, k: int,
            by: Sequence[str] = ("channel",), platform: str = "none") -> DataFrame:
    """Q1 + Q2 + Q4 for every trigger: ``(seq, prompt)``."""
    cleaned = clean_or_null(messages, members, platform, bot_id)
    ctx = latest_context(cleaned, k, by, "seq", "clean")
    trig = trigger_filter(ctx, bot_id)
    return trig.select("seq", build_prompt(F.col("history")).alias("prompt"))


def payload_parts(prompt: Column, eos: str = tx.EOS) -> tuple[Column, Column]:
    """Q5 pieces: (past_user_inputs, text) of the inference payload."""
    msgs = F.split(prompt, _EOS_SPLIT, -1)
    msgs = F.slice(msgs, 1, F.size(msgs) - 1)        # drop the piece after the last EOS
    past = F.slice(msgs, 1, F.greatest(F.size(msgs) - 1, F.lit(0)))
    text = F.element_at(msgs, -1)
    return past, text


def inference_payload(prompt: Column, eos: str = tx.EOS) -> Column:
    """Q5: the JSON body sent to a hosted conversational model."""
    past, text = payload_parts(prompt, eos)
    body = F.struct(F.struct(past.alias("past_user_inputs"),
                             F.array().cast("array<string>").alias("generated_responses"),
                             text.alias("text")).alias("inputs"))
    return F.to_json(body)


def classify_response(log: DataFrame, key: str = "seq", attempt: str = "attempt",
                      response: str = "response") -> DataFrame:
    """Q6: per trigger, the outcome of the logged responses (attempt 0, 1, ...).

    A response is ``ok`` (generated text), ``empty`` (the empty-input
    error: stop, reply ``...``) or ``retry`` (other error: wait
    ``int(int(estimated_time) * 1.3)`` s).  More than three retries end in
    the failure reply.  Only the first attempts up to the stop count.
    """
    r = F.from_json(F.col(response), schemas.RESPONSE)
    x = log.withColumn("_r", r).withColumn(
        "status", F.when(F.col("_r.error").isNull(), F.lit("ok"))
                   .when(F.col("_r.error") == EMPTY_INPUT_ERROR, F.lit("empty"))
                   .otherwise(F.lit("retry"))) \
        .withColumn("wait_s", F.when(F.col("status") == "retry",
                                     F.floor(F.floor(F.col("_r.estimated_time")) * WAIT_FACTOR).cast("long")))
    # the first non-retry attempt ends the loop; attempts beyond 3 retries
    # never run.  Two partial aggregations (no window), so a trigger with a
    # very long log is still combined map-side.
    ends = x.groupBy(key).agg(
        F.min(F.when(F.col("status") != "retry", F.col(attempt))).alias("_stop"),
        F.min_by(F.struct("status", F.col("_r.generated_text").alias("g")),
                 F.when(F.col("status") != "retry", F.col(attempt))).alias("_end"))
    waited = F.col("wait_s").isNotNull() & (F.col(attempt) <= MAX_RETRIES) & \
        (F.col("_stop").isNull() | (F.col(attempt) < F.col("_stop")))
    waits = x.join(ends.select(key, "_stop"), key) \
             .groupBy(key).agg(F.sum(F.when(waited, F.col("wait_s"))).alias("_wait"))
    stop = ends.join(waits, key)
    failed = F.col("_stop").isNull() | (F.col("_stop") > MAX_RETRIES)
    reply = F.when(failed, F.lit(FAILED_REPLY)) \
             .when(F.col("_end.status") == "empty", F.lit(BLANK_REPLY)) \
             .otherwise(blank_reply(F.col("_end.g")))
    outcome = F.when(failed, F.lit("failed")).otherwise(F.col("_end.status"))
    return stop.select(key, outcome.alias("outcome"),
                       F.least(F.coalesce(F.col("_stop"), F.lit(MAX_RETRIES + 1)),
                               F.lit(MAX_RETRIES + 1)).cast("long").alias("retries"),
                       F.coalesce(F.col("_wait"), F.lit(0)).cast("long").alias("wait_s"),
                       reply.alias("reply"))


def blank_reply(c: Column) -> Column:
    """Q7: a reply that is empty after strip() becomes ``...``."""
    return F.when(F.length(tx.strip_unicode(c)) == 0, F.lit(BLANK_REPLY)).otherwise(c)


def roster_literal(members: DataFrame, limit: int = MAX_ROSTER) -> Column:
    """The roster in order as one literal array of (name, id) — collected
    only after its size is checked.  For ``link_members_fold``."""
    n = members.count()
    if n > limit:
        raise ValueError(f"roster of {n} rows exceeds the link_members bound {limit}")
    rows = members.orderBy("pos").select("name", "id").collect()
    return F.array(*[F.struct(F.lit(r[0]).cast("string").alias("name"),
                              F.lit(r[1]).cast("string").alias("id")) for r in rows])


def link_members_fold(reply: Column, roster: Column) -> Column:
    """Q8 as a plain fold over every member (O(members) per reply); the
    reference semantics, used for small rosters and as the test oracle."""
    def step(acc, m):
        hit = m["name"].isNotNull() & (F.length(m["name"]) > 0) & acc.contains(m["name"])
        hi = F.replace(acc, F.lit("Hi"), F.concat(F.lit("Hi @"), m["name"]))
        return F.when(hit, F.replace(hi, m["name"], F.concat(F.lit("<@"), F.coalesce(m["id"], F.lit("")), F.lit(">")))) \
                .otherwise(acc)
    return F.aggregate(roster, reply, step)


GRAM = 8   # names are found by a piece of up to this many characters: few names share one, however large the roster


def _pieces(c: Column, n: int) -> Column:
    """The distinct pieces of ``n`` characters of a text (none if shorter)."""
    starts = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))))


def _link(text: Column, name: Column, member: Column) -> Column:
    """One member's rewrite of a text."""
    hi = F.replace(text, F.lit("Hi"), F.concat(F.lit("Hi @"), name))
    return F.replace(hi, name, F.concat(F.lit("<@"), F.coalesce(member, F.lit("")), F.lit(">")))


def _fold_links(text: str, candidates: str) -> Column:
    """The candidates' rewrites in roster order: every text after a rewrite, with the
    rewriting member's place and the place of the next one."""
    kind = "array<struct<idx:bigint,text:string>>"
    start = F.struct(F.col(text).alias("text"), F.array().cast(kind).alias("states"))

    def step(acc: Column, m: Column) -> Column:
        new = F.struct(m["idx"].alias("idx"), _link(acc["text"], m["name"], m["id"]).alias("text"))
        states = F.when(acc["text"].contains(m["name"]), F.concat(acc["states"], F.array(new))).otherwise(acc["states"])
        return F.struct(acc["text"].alias("text"), states.cast(kind).alias("states"))

    # the text of the next step is that of the newest state
    def forward(acc: Column, m: Column) -> Column:
        nxt = step(acc, m)
        return F.struct(F.coalesce(F.try_element_at(nxt["states"], F.lit(-1))["text"], acc["text"]).alias("text"),
                        nxt["states"].alias("states"))

    states = F.aggregate(F.array_sort(candidates), start, forward, lambda acc: acc["states"])
    return F.get(F.transform(F.array(states), lambda s: F.transform(s, lambda x, i: F.struct(
        x["idx"].alias("idx"), F.coalesce(F.get(s, i + 1)["idx"], F.lit(2 ** 62)).alias("until"),
        x["text"].alias("text")))), F.lit(0))


def _names_in(texts: DataFrame, lookup: DataFrame, sizes: list[int], keys: list[str]) -> DataFrame:
    """(keys, text, name): the names that occur in each text, by an equi-join of the
    text's pieces with each name's rarest piece and a check of the whole name."""
    grams = F.array_distinct(F.flatten(F.array(*[
        F.coalesce(_pieces(F.col("text"), n), F.array().cast("array<string>")) for n in sizes])))
    return texts.select(*dict.fromkeys([*keys, "text"]), F.explode(grams).alias("gram")).join(lookup, "gram") \
        .where(F.col("text").contains(F.col("name"))).select(*keys, "name")


def link_members(df: DataFrame, members: DataFrame, col: str = "reply", out: str = "reply") -> DataFrame:
    """Q8: for each member in roster order whose name occurs in the text:
    ``Hi`` -> ``Hi @name``, then name -> ``<@id>``; later members see the
    earlier rewrites.

    Works on the distinct texts, for rosters of any size.  One join finds the
    names in every text; the first member of each is a candidate, and all
    candidates of a text are applied by one ordered fold.  Rewrites may bring up
    further names (inside an id, across a mention's edge): a second join looks for
    members whose name occurs in a rewritten text while it is their turn.  Those
    become candidates and their texts are folded again, until there are none.
    The number of joins does not grow with the rewrites of a text.
    """
    from parley.operators.windows import counted_broadcast, dense_index
    from parley.session import materialize

    m = members.select(F.col("name").cast("string").alias("name"), F.col("id").cast("string").alias("id"),
                       F.col("pos").cast("long").alias("pos"))
    ranked = materialize(dense_index(m, ["pos", "id"], "idx").where(F.length("name") > 0).drop("pos"))
    names = materialize(ranked.groupBy("name").agg(F.min(F.struct("idx", "id")).alias("first")))
    size = F.least(F.length("name"), F.lit(GRAM))
    split = materialize(names.select("name", F.explode(F.coalesce(*[
        F.when(size == n, _pieces(F.col("name"), n)) for n in range(1, GRAM + 1)])).alias("gram")))
    often = split.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    lookup = materialize(split.join(often, "gram").groupBy("name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))
    sizes = sorted(r[0] for r in lookup.select(F.length("gram")).distinct().collect())   # at most GRAM numbers
    if not sizes:
        return df.withColumn(out, F.col(col))
    df = materialize(df)                        # read for its texts and for the result
    lookup = counted_broadcast(lookup)          # the pieces of the texts stay where they are
    texts = materialize(df.where(F.col(col).isNotNull()).select(F.col(col).alias("text")).distinct())
    one = F.struct(F.col("idx"), F.col("name"), F.col("id"))
    found = _names_in(texts, lookup, sizes, ["text"]).join(names, "name").select(F.col("text").alias("_k"), "name", "first.*")
    folded = found.groupBy("_k").agg(F.collect_list(one).alias("_c")) \
        .withColumn("_s", _fold_links("_k", "_c"))
    done, pending = [], materialize(folded)
    while True:
        states = materialize(pending.select("_k", F.explode("_s").alias("s")).select("_k", "s.*"))
        seen = _names_in(states, lookup, sizes, ["_k", "idx", "until"])
        turn = seen.join(ranked.select("name", F.col("idx").alias("_i"), "id"), "name") \
            .where((F.col("_i") > F.col("idx")) & (F.col("_i") < F.col("until")))
        new = turn.groupBy("_k", "name", "idx").agg(F.min(F.struct(F.col("_i").alias("idx"), "id")).alias("first")) \
            .select("_k", F.struct("first.idx", "name", "first.id").alias("c"))
        more = materialize(new.groupBy("_k").agg(F.collect_set("c").alias("_more")))
        if more.isEmpty():
            done.append(pending)
            break
        done.append(pending.join(more, "_k", "left_anti"))
        pending = materialize(pending.join(more, "_k").select("_k", F.array_union("_c", "_more").alias("_c"))
                              .withColumn("_s", _fold_links("_k", "_c")))
    changed = done[0]
    for d in done[1:]:
        changed = changed.unionByName(d)
    changed = changed.select("_k", F.try_element_at("_s", F.lit(-1))["text"].alias("_t"))
    got = df.join(changed, df[col] == changed["_k"], "left").withColumn(out, F.coalesce("_t", F.col(col)))
    return got.drop("_k", "_t")


def replay_history(turns: DataFrame, k: int, conv: str = "conv_id", order: str = "seq") -> DataFrame:
    """Q9: the chat loop's history: the k newest turns of the conversation
    up to each turn (blank seeds vanish in the prompt)."""
    return latest_context(turns, k, [conv], order, "content", "history")
