"""Message cleaning C1..C9 as one projection chain.

Only mention resolution (C4) joins: rows holding a ``<@id>`` token are
exploded per token, looked up in the roster and regrouped by all their
columns (so rows of several sessions or with repeated ids stay apart);
rows without a token bypass the join entirely.  The partial aggregation
merges a message's tokens before the shuffle, so each mention row crosses
the network once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as tx
# a roster is broadcast only below this many ids (about 30 bytes each)
ROSTER_BROADCAST_ROWS = 500_000


def first_names(members: DataFrame) -> DataFrame:
    """One name per member id: the first roster row wins (lowest ``pos``)."""
    m = members
    if "pos" not in m.columns:
        m = m.withColumn("pos", F.monotonically_increasing_id())
    return (m.where(F.col("id").isNotNull())
             .groupBy(tx.normalise_id(F.col("id").cast("string")).alias("_mid"))
             .agg(F.min_by("name", "pos").alias("_mname")))


def drop_null_content(df: DataFrame, col: str = "content") -> DataFrame:
    """C1."""
    return df.where(F.col(col).isNotNull())


def resolve_mentions(df: DataFrame, members: DataFrame, col: str = "content",
                     roster_rows: int | None = None) -> DataFrame:
    """C4: ``<@digits>`` -> member name (first roster row), else ``Human``.

    One pass over the original text; no key is needed.  The
    roster is broadcast when its id count is below ``ROSTER_BROADCAST_ROWS``;
    a larger one is shuffled and AQE splits an often-mentioned id.
    """
    cols = df.columns
    names = first_names(members)
    # broadcast the roster once its size is checked (a cheap count of a small
    # table): the exploded mention rows then never shuffle for the lookup
    n = roster_rows if roster_rows is not None else names.count()
    if n <= ROSTER_BROADCAST_ROWS:
        names = F.broadcast(names)
    has = F.col(col).rlike(tx.MENTION_RE)
    plain = df.where(~has | F.col(col).isNull())
    tagged = df.where(has)
    exploded = tagged.select(
        *cols, F.posexplode(F.regexp_extract_all(F.col(col), F.lit(tx.MENTION_ID_RE), 1))
        .alias("_tpos", "_tid"))
    looked = exploded.join(names, tx.normalise_id(F.col("_tid")) == F.col("_mid"), "left")
    # a row is told apart by all its columns; rows equal in all of them come
    # out equal and are repeated as often as they came in, so nothing merges
    name = F.coalesce(F.col("_mname"), F.lit(tx.UNKNOWN_MEMBER)).alias("n")
    regrouped = looked.groupBy(*cols).agg(
        F.array_sort(F.collect_set(F.struct(F.col("_tpos"), name))).alias("_names"),
        F.count_if(F.col("_tpos") == 0).cast("int").alias("_times"))
    pieces = F.split(F.col(col), tx.MENTION_RE, -1)
    fill = F.concat(F.transform(F.col("_names"), lambda s: s["n"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(pieces, fill, lambda p, n: F.concat(p, n)), "")
    resolved = regrouped.withColumn(col, rebuilt) \
        .withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*cols)
    return plain.unionByName(resolved)


def clean_messages(messages: DataFrame, members: DataFrame, col: str = "content",
                   roster_rows: int | None = None) -> DataFrame:
    """C9 = C1 -> C2 -> C3 -> C4 -> C5 -> C6 -> C7.  C8 (oldest first) is
    the ``seq`` convention: nothing moves."""
    df = drop_null_content(messages, col)
    df = df.withColumn(col, tx.replace_custom_emojis(tx.replace_urls(F.col(col))))
    df = resolve_mentions(df, members, col, roster_rows)
    df = df.withColumn(col, tx.newline_to_space(tx.blank_non_ascii(F.col(col))))
    return df.where(tx.is_not_blank(F.col(col)))


def clean_text_only(df: DataFrame, col: str = "content") -> DataFrame:
    """C1..C3, C5..C7 without the roster (documents, dialogues)."""
    df = drop_null_content(df, col)
    c = tx.replace_custom_emojis(tx.replace_urls(F.col(col)))
    df = df.withColumn(col, tx.newline_to_space(tx.blank_non_ascii(c)))
    return df.where(tx.is_not_blank(F.col(col)))


def channel_time_scope(channel_col: str = "channel", ts_col: str = "ts",
                       seq_col: str = "seq") -> tuple[list[str], list[str]]:
    """Per-channel order by timestamp (ties by seq); channels are
    separate scopes.  Returns ``(by, order)`` for the window operators."""
    return [channel_col], [ts_col, seq_col]
