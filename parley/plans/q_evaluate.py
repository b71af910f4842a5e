"""Queries for evaluation (E1..E7).

ROUGE pairs: consecutive turns of each conversation (the earlier turn is
the reference, the later one the prediction).  Loss log: one event per
step, ``value`` as the batch loss.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import evaluate as ev
from parley.operators import package as pk
from parley.operators.windows import preceding
from parley.plans import views as v
from parley.plans.catalog import register
from parley.plans.q_package import SEED, _ALL_SESSION, _split_all

PAIRS_SQL = """
pairs AS (
  SELECT seq, label, content AS pred FROM (
    SELECT seq, content, lag(content) OVER (PARTITION BY channel ORDER BY seq) AS label,
           row_number() OVER (PARTITION BY channel ORDER BY seq) AS rn
    FROM dialog WHERE content IS NOT NULL)
  WHERE rn > 1)
"""


def _tok_sql(col):
    return f"regexp_extract_all(lower({col}), '[a-z0-9]+')"


def _grams_sql(n, col):
    t = _tok_sql(col)
    if n == 1:
        return t
    parts = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return (f"(SELECT list_transform(range(1, len(t) - {n - 1} + 1), lambda i: {parts}) "
            f"FROM (SELECT {t} AS t))")


def _rouge_n_sql(n, tag=""):
    return f"""
g{tag} AS (SELECT seq, {_grams_sql(n, 'pred')} AS gp, {_grams_sql(n, 'label')} AS gr FROM pairs),
cp{tag} AS (SELECT seq, gram, count(*) AS c FROM (SELECT seq, unnest(gp) AS gram FROM g{tag}) GROUP BY ALL),
cr{tag} AS (SELECT seq, gram, count(*) AS c FROM (SELECT seq, unnest(gr) AS gram FROM g{tag}) GROUP BY ALL),
ov{tag} AS (SELECT cp{tag}.seq, sum(least(cp{tag}.c, cr{tag}.c)) AS o FROM cp{tag} JOIN cr{tag} USING (seq, gram)
            GROUP BY cp{tag}.seq),
sc{tag} AS (SELECT g{tag}.seq, coalesce(ov{tag}.o, 0) / greatest(len(gp), 1) AS p,
                   coalesce(ov{tag}.o, 0) / greatest(len(gr), 1) AS r
            FROM g{tag} LEFT JOIN ov{tag} USING (seq)),
scored{tag} AS (SELECT seq, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM sc{tag})
"""


def _fifth_sql(x, src, out):
    m = ev.PRIME
    return (f"SELECT * EXCLUDE (_y), _y * _y % {m} * {x} % {m} AS {out} FROM "
            f"(SELECT *, {x} * {x} % {m} AS _y FROM {src})")


def _bootstrap_sql(seed, samples, cols, src):
    """(rep, m_<col>...): the bootstrap means of ``cols`` of the table ``src``."""
    m = ev.PRIME
    w = " + ".join(f"CASE WHEN h4 / {float(m)!r} >= {c!r} THEN 1 ELSE 0 END" for c in ev._poisson_cdf())
    means = ", ".join(f"sum({c} * w) / sum(w) AS m_{c}" for c in cols)
    return f"""
b0 AS (SELECT *, CAST(seq % {m} AS BIGINT) AS a, unnest(range(1, {samples + 1})) AS rep FROM {src}),
b1 AS (SELECT *, (a * 48271 + rep * 69621 + {seed}) % {m} AS h1 FROM b0),
b2 AS ({_fifth_sql('h1', 'b1', 'h2')}),
b3 AS (SELECT *, (h2 + a * 16807 + rep) % {m} AS h3 FROM b2),
b4 AS ({_fifth_sql('h3', 'b3', 'h4')}),
ww AS (SELECT *, {w} AS w FROM b4),
per AS (SELECT rep, {means} FROM ww GROUP BY rep)
"""


def pairs(spark, sf):
    d = v.dialog(spark, sf).where(F.col("content").isNotNull())
    w = preceding(d, 1, ["channel"], "seq", "content", "ctx")
    return w.where(F.col("n_before") == 1).select(
        "seq", F.col("ctx")[0].alias("label"), F.col("content").alias("pred"))


def _rounded(df, prefix):
    return df.select("seq", *[F.round(f"{prefix}_{x}", 9).alias(f"{prefix}_{x}") for x in "prf"])


for _n in (1, 2):
    def _make(n):
        name = f"rouge{n}"

        @register(name, v.with_views("dialog", extra=PAIRS_SQL + "," + _rouge_n_sql(n)) + f"""
SELECT seq, round(p, 9) AS {name}_p, round(r, 9) AS {name}_r, round(f, 9) AS {name}_f FROM scored""")
        def q(spark, sf):
            return _rounded(ev.rouge_n(pairs(spark, sf), n), name)
        return q
    _make(_n)


@register("rouge_mean", v.with_views("dialog", extra=PAIRS_SQL + "," + _rouge_n_sql(1)) + """
SELECT 'rouge1_f' AS metric, 'mean' AS kind, round(avg(f) * 100, 4) AS value FROM scored""")
def rouge_mean(spark, sf):
    s = ev.rouge_n(pairs(spark, sf), 1)
    return s.agg(F.round(F.avg("rouge1_f") * 100, 4).alias("value")) \
            .select(F.lit("rouge1_f").alias("metric"), F.lit("mean").alias("kind"), "value")


LCS_SQL = """
toks AS (SELECT seq, regexp_extract_all(lower(label), '[a-z0-9]+') AS a,
                regexp_extract_all(lower(pred), '[a-z0-9]+') AS b FROM pairs),
dp(seq, a, b, d, p2, p1) USING KEY (seq) AS (
  SELECT seq, a, b, 1, list_transform(range(0, len(a) + 1), lambda k: 0),
         list_transform(range(0, len(a) + 1), lambda k: 0) FROM toks
  UNION
  SELECT seq, a, b, d + 1, p1,
         list_transform(range(1, len(a) + 2), lambda k:
           CASE WHEN k - 1 >= 1 AND d + 2 - k >= 1 AND d + 2 - k <= len(b)
                THEN CASE WHEN a[k - 1] = b[d + 2 - k] THEN p2[k - 1] + 1 ELSE greatest(p1[k - 1], p1[k]) END
                ELSE 0 END)
  FROM dp WHERE d < len(a) + len(b)),
lcs AS (SELECT seq, len(a) AS n_ref, len(b) AS n_pred,
               CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE p1[len(a) + 1] END AS l FROM dp),
lsc AS (SELECT seq, CASE WHEN n_ref = 0 OR n_pred = 0 THEN 0.0 ELSE l / n_pred END AS p,
                    CASE WHEN n_ref = 0 OR n_pred = 0 THEN 0.0 ELSE l / n_ref END AS r FROM lcs)
"""


# the LCS as dynamic programming over anti-diagonals: each diagonal is one
# vectorised list step from the two before it (recursive CTE keyed by pair)
@register("rouge_lcs", v.with_views("dialog", extra=PAIRS_SQL + "," + LCS_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT seq, round(p, 9) AS rougeL_p, round(r, 9) AS rougeL_r,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS rougeL_f FROM lsc""")
def rouge_lcs(spark, sf):
    s = ev.rouge_l(pairs(spark, sf))
    return s.select("seq", *[F.round(c, 9).alias(c) for c in ("rougeL_p", "rougeL_r", "rougeL_f")])


# summary level: one table per pair of sentences, row by row (each row is the running
# maximum of its candidates), then the read-out from its last cell; the tokens of a
# reference sentence hit by any of them count once, and no oftener than either text has them
LSUM_SQL = """
sref AS (SELECT seq, i, regexp_extract_all(lower(s), '[a-z0-9]+') AS a FROM (
           SELECT seq, unnest(l) AS s, unnest(range(len(l))) AS i FROM (
             SELECT seq, list_filter(string_split(label, chr(10)), lambda x: x <> '') AS l FROM {pairs}))),
spred AS (SELECT seq, j, regexp_extract_all(lower(s), '[a-z0-9]+') AS b FROM (
            SELECT seq, unnest(l) AS s, unnest(range(len(l))) AS j FROM (
              SELECT seq, list_filter(string_split(pred, chr(10)), lambda x: x <> '') AS l FROM {pairs}))),
tab(seq, i, j, a, b, n, rows) USING KEY (seq, i, j) AS (
  SELECT seq, i, j, a, b, 0, [list_transform(range(len(b) + 1), lambda k: 0)] FROM sref JOIN spred USING (seq)
  UNION
  SELECT seq, i, j, a, b, n + 1, list_append(rows, list_prepend(0,
      list_transform(range(1, len(b) + 1), lambda k: list_max(cand[1:k]))))
  FROM (SELECT *, list_transform(range(1, len(b) + 1), lambda k:
                 CASE WHEN b[k] = a[n + 1] THEN rows[n + 1][k] + 1 ELSE rows[n + 1][k + 1] END) AS cand
        FROM tab WHERE n < len(a))),
walk(seq, i, j, a, b, rows, x, y, hits) USING KEY (seq, i, j) AS (
  SELECT seq, i, j, a, b, rows, len(a), len(b), []::BIGINT[] FROM tab
  UNION
  SELECT seq, i, j, a, b, rows,
         CASE WHEN a[x] = b[y] OR rows[x + 1][y] <= rows[x][y + 1] THEN x - 1 ELSE x END,
         CASE WHEN a[x] = b[y] OR rows[x + 1][y] > rows[x][y + 1] THEN y - 1 ELSE y END,
         CASE WHEN a[x] = b[y] THEN list_append(hits, x) ELSE hits END
  FROM walk WHERE x > 0 AND y > 0),
hit AS (SELECT DISTINCT seq, i, a[h] AS tok, h FROM (SELECT seq, i, a, unnest(hits) AS h FROM walk)),
hitn AS (SELECT seq, tok, count(*) AS n FROM hit GROUP BY ALL),
prn AS (SELECT seq, tok, count(*) AS n FROM (SELECT seq, unnest(b) AS tok FROM spred) GROUP BY ALL),
clip AS (SELECT seq, sum(least(hitn.n, prn.n)) AS o FROM hitn JOIN prn USING (seq, tok) GROUP BY seq),
lsum AS (
  SELECT p.seq, coalesce(o, 0) / greatest(coalesce(np, 0), 1) AS p, coalesce(o, 0) / greatest(coalesce(nr, 0), 1) AS r
  FROM {pairs} p LEFT JOIN clip USING (seq)
  LEFT JOIN (SELECT seq, sum(len(a)) AS nr FROM sref GROUP BY seq) USING (seq)
  LEFT JOIN (SELECT seq, sum(len(b)) AS np FROM spred GROUP BY seq) USING (seq))
"""


def _f(p="p", r="r"):
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


@register("rouge_l", v.with_views("dialog", extra=PAIRS_SQL + "," + LCS_SQL + "," + LSUM_SQL.format(pairs="pairs"))
          .replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT seq, round(l.p, 9) AS rougeL_p, round(l.r, 9) AS rougeL_r, round({_f('l.p', 'l.r')}, 9) AS rougeL_f,
       round(s.p, 9) AS rougeLsum_p, round(s.r, 9) AS rougeLsum_r, round({_f('s.p', 's.r')}, 9) AS rougeLsum_f
FROM lsc l JOIN lsum s USING (seq)""")
def rouge_l(spark, sf):
    s = ev.rouge_l(pairs(spark, sf))
    return s.select("seq", *[F.round(c, 9).alias(c) for c in s.columns if c.startswith("rougeL")])


_FPAIR = """
fpair AS (SELECT a.seq, a.f AS rouge1_f, b.f AS rouge2_f FROM scored1 a JOIN scored2 b USING (seq))"""


@register("rouge_mid", v.with_views("dialog", extra=PAIRS_SQL + "," + _rouge_n_sql(1, "1") + "," + _rouge_n_sql(2, "2")
                                    + "," + _FPAIR + "," + _bootstrap_sql(SEED, ev.BOOTSTRAP_SAMPLES,
                                                                           ["rouge1_f", "rouge2_f"], "fpair")) + """
SELECT 'rouge1_f' AS metric, 'mid' AS kind, round(quantile_cont(m_rouge1_f, 0.5) * 100, 4) AS value FROM per
UNION ALL SELECT 'rouge2_f', 'mid', round(quantile_cont(m_rouge2_f, 0.5) * 100, 4) FROM per
UNION ALL SELECT 'rouge1_f', 'mean', round(avg(rouge1_f) * 100, 4) FROM fpair
UNION ALL SELECT 'rouge2_f', 'mean', round(avg(rouge2_f) * 100, 4) FROM fpair""")
def rouge_mid(spark, sf):
    s = ev.rouge_n(pairs(spark, sf), (1, 2))
    return ev.rouge_mid(s, ["rouge1_f", "rouge2_f"], "seq", seed=SEED)


@register("perplexity", """
SELECT count(*) AS batches, round(avg(value), 9) AS mean_loss,
       round(exp(round(avg(value), 9)), 2) AS perplexity FROM events""")
def perplexity(spark, sf):
    e = v.table(spark, sf, "events")
    return ev.perplexity(e.select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss")))


@register("loss_curve", f"""
SELECT block, (block + 1) * {ev.LOG_EVERY} AS step, round(mean_loss, 9) AS mean_loss FROM (
  SELECT CAST(floor(event_id / {ev.LOG_EVERY}) AS BIGINT) AS block, count(*) AS n, avg(value) AS mean_loss
  FROM events GROUP BY 1) WHERE n = {ev.LOG_EVERY}""")
def loss_curve(spark, sf):
    e = v.table(spark, sf, "events")
    return ev.loss_curve(e.select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss")))


@register("loss_summary", "SELECT max(event_id + 1) AS steps, round(sum(value) / max(event_id + 1), 9) AS mean_loss FROM events")
def loss_summary(spark, sf):
    e = v.table(spark, sf, "events")
    return ev.loss_summary(e.select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss")))


@register("bench_sample", _ALL_SESSION + """
SELECT seq, response FROM ranked WHERE r <= n_test AND r <= 30""")
def bench_sample(spark, sf):
    test = _split_all(spark, sf)[1]
    return ev.benchmark_sample(test, [pk.shuffle_key(SEED), F.col("seq")]).select("seq", "response")
