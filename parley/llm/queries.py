"""Registered queries of this package: ``name -> (spark, sf_dir) -> DataFrame``.

Each query applies its operator, with production parameters, to its whole
table and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    ann, audit, chat, codes, decontam, extract, langid, licenses, lm, mixing, neardup, pieces, quality,
)
from parley.llm.scratch import keep, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LABELS = 100_000         # sums per label are broadcast up to so many labels, joined beyond


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        query.__name__ = fn.__name__
        query.__doc__ = fn.__doc__
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mix of all sources."""
    return mixing.document_counts(table(spark, sf_dir, "documents"))


@register("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again; ``exact``: the text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, exact="exact").select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "exact")


CHAT_ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {text} AS esc_text, {role} AS esc_role FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(esc_role) + length(esc_text) + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _escape_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


@register("op3_chat", CHAT_ORACLE.format(text=_escape_sql("text"), role=_escape_sql("role")))
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as records of mixed layouts, formatted, and read back."""
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"),
                                   (-1, 1, "assistant", "</s>[INST] ok [/INST]")], chat.CONVERSATION)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_chats(chat.canonical_turns(chat.as_records(rows))))


@register("op4_lm_scores")
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts, learned from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score(docs, learn=~lm.held_out(F.col("doc_id")))
    return out.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


ANN_ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@register("op5_neighbours", ANN_ORACLE)
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                      F.col("vec_id") % 100 == 0)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/language/hundred/name; the first of a
    hundred is the directory's licence file."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    home = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"),
                       F.floor(F.col("doc_id") / 100).cast("string"))
    path = F.when(F.col("doc_id") % 100 == 0, F.concat(home, F.lit("/LICENSE"))).otherwise(F.concat(
        home, F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc"), F.col("doc_id").cast("string")))
    return d.select("doc_id", "text", path.alias("path"))


@register("op6_licences")
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its directory's."""
    return licenses.scan(files(spark, sf_dir)).select("doc_id", "path", "licence", "score", "basis")


@register("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


@register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every whole text and the verdict on it."""
    measured = keep(quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"),
                    "measured")
    return quality.judge(measured, quality.fit(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good")


@register("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, extract.fit(pages)).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@register("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(langid.held_out(F.col("doc_id"), 3, 1), F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model) \
        .select("doc_id", "held_out", "lang_pred", "score")


CODES_ORACLE = """
WITH RECURSIVE kept AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v,
         row_number() OVER () AS rid
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
start AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL),
book0 AS (SELECT p, e, x AS c FROM start JOIN parts USING (rid) WHERE e < 64),
{rounds},
final AS ({assign2}),
coded AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM final GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT h FROM books) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""
_ASSIGN = """SELECT rid, p, e, d, x FROM (
    SELECT rid, q.p, e, x, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d,
           row_number() OVER (PARTITION BY rid, q.p ORDER BY d, e) AS r
    FROM parts q JOIN book{0} b ON q.p = b.p) WHERE r = 1"""
_ROUND = """near{0} AS MATERIALIZED ({1}),
sums{0} AS (SELECT p, e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n
  FROM near{0}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY p, e, j),
book{2} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{0} b LEFT JOIN (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM sums{0} GROUP BY p, e) m
  ON b.p = m.p AND b.e = m.e)"""


@register("op11_vector_codes", CODES_ORACLE.format(
    rounds=",\n".join(_ROUND.format(i, _ASSIGN.format(i), i + 1) for i in range(2)), assign2=_ASSIGN.format(2)))
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors, and the error of each label."""
    vectors = table(spark, sf_dir, "embeddings")
    books = codes.fit(vectors)
    coded = keep(codes.encode(vectors, books, carry=("vec_id", "label")), "codes")
    per_label = keep(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-error")
    if per_label.count() <= LABELS:
        per_label = F.broadcast(per_label)
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", codes.hex_code(F.col("codes")).alias("code"), "error", "label_error",
        F.lit(codes.digest(books)).alias("codebooks_sha256"))


AUDIT_ORACLE = """
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                     min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > first_id, false)] AS f
  FROM words d LEFT JOIN marks m ON d.doc_id = m.doc_id),
cells AS (SELECT part, good, toxic, f, count(*) AS n FROM flags GROUP BY ALL),
orders(filter_order) AS (VALUES {orders}),
steps AS (SELECT filter_order, s AS step, instr('ABCDE', substr(filter_order, s, 1)) AS i,
                 [instr('ABCDE', substr(filter_order, k, 1)) FOR k IN range(1, s)] AS earlier
          FROM orders, range(1, 6) r(s)),
met AS (
  SELECT part, filter_order, step, i, n, good, toxic, f[i] AS fails,
         len([k FOR k IN earlier IF f[k]]) > 0 AS gone, len([x FOR x IN f IF x]) AS n_fails
  FROM cells, steps),
counts AS (
  SELECT part, filter_order, step, i,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
    coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND fails AND good = 1), 0) AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND fails AND toxic = 1), 0) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM counts
"""


@register("op12_filter_audit", AUDIT_ORACLE.format(
    orders=", ".join(f"('{''.join(audit.LETTERS[i] for i in o)}')" for o in audit.orders())))
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter removes at every place of every order, per language."""
    return audit.audit(audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


DECONTAM_ORACLE = """
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{word}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {k}) AS k, array_to_string(w[i:i + least(len(w), {k}) - 1], ' ') AS g
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - {k}, 0) + 2)) AS i) WHERE len(w) > 0),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{word}'), []) AS w FROM documents),
lengths AS (SELECT DISTINCT k FROM windows),
spots AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k),
met AS (SELECT rid, i, s.k, item FROM spots s JOIN windows ON s.k = windows.k AND array_to_string(w[i:i + s.k - 1], ' ') = g),
hits AS (SELECT rid, count(DISTINCT j) AS n_hit FROM met, LATERAL (SELECT unnest(range(i, i + k)) AS j) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""


@register("op13_decontamination", DECONTAM_ORACLE.format(
    upper=decontam.UPPER, lower=decontam.LOWER, word="[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", k=decontam.WINDOW))
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages in every whole text."""
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          table(spark, sf_dir, "benchmark"), return_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
