"""Queries for the n-gram model stand-ins (R1..R4) and E7."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parley.operators import clean as cl
from parley.operators import evaluate as ev
from parley.operators import ngram as ng
from parley.operators import package as pk
from parley.plans import views as v
from parley.plans.catalog import register
from parley.plans.q_sequences import DIALOG_CLEAN_SQL, SEED, dialog_rows
from parley.plans import q_sequences as qs
from parley.plans.q_evaluate import LCS_SQL, LSUM_SQL, _bootstrap_sql, _f, _rouge_n_sql
from parley.functions.text import EOS
from parley.operators import sequences as sq
from parley.session import materialize
from parley.streaming.stream import _scratch

N = 2

GRAMS_SQL = f"""
toks AS (SELECT seq, author_id,
                ['{ng.BOS}'] || list_filter(regexp_split_to_array(content, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> '')
                || ['{ng.EOS_TOKEN}'] AS t FROM dclean),
grams AS (SELECT seq, author_id, t[i - 1] AS prefix, t[i] AS token
          FROM (SELECT seq, author_id, t, unnest(range(2, len(t) + 1)) AS i FROM toks)),
counts AS (SELECT author_id, prefix, token, count(*) AS cnt FROM grams GROUP BY ALL),
totals AS (SELECT author_id, prefix, sum(cnt) AS tot FROM counts GROUP BY ALL),
vocab AS (SELECT author_id, count(DISTINCT token) AS v FROM counts GROUP BY ALL),
model AS (SELECT c.author_id, c.prefix, c.token, c.cnt, (c.cnt + 1.0) / (t.tot + 1.0 * v.v) AS p,
                 t.tot AS prefix_total, v.v AS vocab
          FROM counts c JOIN totals t USING (author_id, prefix) JOIN vocab v USING (author_id))
"""


def dialog_model(spark, sf):
    return ng.fit_ngram_model(cl.clean_text_only(v.dialog(spark, sf)), N)


@register("ngram_model", v.with_views("dialog", extra=DIALOG_CLEAN_SQL + "," + GRAMS_SQL) + """
SELECT author_id, prefix, token, cnt, round(p, 9) AS p FROM model""")
def ngram_model(spark, sf):
    m = dialog_model(spark, sf)
    return m.select("author_id", "prefix", "token", "cnt", F.round("p", 9).alias("p"))


# held-out perplexity: the model knows the training rows only, so unknown grams and
# unknown prefixes take their shares
_HELD_SQL = f"""
dsplit AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(seq AS VARCHAR)), seq)
                     <= CAST(floor(0.1::DOUBLE * count(*) OVER ()) AS BIGINT) AS is_test FROM dclean),
""" + GRAMS_SQL.replace("FROM dclean)", "FROM dsplit WHERE NOT is_test)") + f""",
ttoks AS (SELECT seq, author_id,
                 ['{ng.BOS}'] || list_filter(regexp_split_to_array(content, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> '')
                 || ['{ng.EOS_TOKEN}'] AS t FROM dsplit WHERE is_test),
tgrams AS (SELECT seq, author_id, t[i - 1] AS prefix, t[i] AS token
           FROM (SELECT seq, author_id, t, unnest(range(2, len(t) + 1)) AS i FROM ttoks)),
asked AS (SELECT g.seq, CASE WHEN m.p IS NOT NULL THEN m.p WHEN t.tot IS NOT NULL THEN 1.0 / (t.tot + 1.0 * v.v)
                             ELSE 1.0 / v.v END AS p
          FROM tgrams g JOIN vocab v USING (author_id) LEFT JOIN totals t USING (author_id, prefix)
          LEFT JOIN model m USING (author_id, prefix, token)),
scored AS (SELECT seq, avg(-ln(p)) AS row_loss FROM asked GROUP BY seq),
ranked AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos, count(*) OVER () AS n FROM scored),
batched AS (SELECT CAST(floor(pos / 4) AS BIGINT) AS batch_id, avg(row_loss) AS loss FROM ranked
            WHERE pos < (n // 4) * 4 GROUP BY 1)
"""


@register("ngram_perplexity", v.with_views("dialog", extra=DIALOG_CLEAN_SQL + "," + _HELD_SQL) + """
SELECT count(*) AS batches, round(avg(loss), 9) AS mean_loss,
       round(exp(round(avg(loss), 9)), 6) AS perplexity FROM batched""")
def ngram_perplexity(spark, sf):
    """R2 on rows the model was not fitted on."""
    return held_out_perplexity(spark, sf)


def held_out_perplexity(spark, sf):
    train, test = pk.split_exact(materialize(cl.clean_text_only(v.dialog(spark, sf))), 0.1, SEED)
    return ng.score_ngram_perplexity(ng.fit_ngram_model(train, N), test, N)


@register("decode_candidates", v.with_views("dialog", extra=DIALOG_CLEAN_SQL + "," + GRAMS_SQL) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY author_id, prefix ORDER BY p DESC, token) AS rank
           FROM model),
top AS (SELECT *, exp(ln(p) / {ng.TEMPERATURE}) AS w FROM ranked WHERE rank <= {ng.TOP_K}),
norm AS (SELECT *, w / sum(w) OVER (PARTITION BY author_id, prefix) AS q FROM top),
cum AS (SELECT *, sum(q) OVER (PARTITION BY author_id, prefix ORDER BY rank
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM norm)
SELECT author_id, prefix, token, rank, round(q, 9) AS q FROM cum WHERE cum - q < {ng.TOP_P}""")
def decode_candidates(spark, sf):
    c = ng.decode_candidates(dialog_model(spark, sf))
    return c.select("author_id", "prefix", "token", "rank", F.round("q", 9).alias("q"))


def test_prompts(spark, sf):
    """The test split's rows (whole), with their prompt text (F2) and the
    reference response."""
    rows = materialize(dialog_rows(spark, sf))
    _, test = pk.split_exact(rows, 0.1, SEED)
    return test.select("seq", "author_id", "response", sq.prompt_text().alias("prompt"))


# The oracle replays the seeded sampler in SQL: the candidate lists per
# prefix, then a recursive CTE keyed by prompt that draws one token per
# step with the same md5 uniform, running sums and no-repeat rule.
_LEN = ng.MAX_LENGTH
GEN_SQL = v.with_views("dialog", extra=qs.DIALOG_CLEAN_SQL + "," + GRAMS_SQL + f""",
cands AS (SELECT author_id, prefix, list(struct_pack(token := token, p := p) ORDER BY rank) AS cs FROM (
            SELECT *, row_number() OVER (PARTITION BY author_id, prefix ORDER BY p DESC, token) AS rank FROM model)
          WHERE rank <= {ng.TOP_K + _LEN} GROUP BY author_id, prefix),
bench AS (SELECT seq, response, context2 || '{EOS}' || context1 || '{EOS}' AS prompt FROM (
            SELECT *, row_number() OVER (ORDER BY md5('{qs.SEED}:' || CAST(seq AS VARCHAR)), seq) AS r,
                   CAST(floor(0.1::DOUBLE * count(*) OVER ()) AS BIGINT) AS n_test FROM base)
          WHERE r <= n_test),
gen(seq, author_id, hist, plen, out, step, done) USING KEY (seq) AS (
  SELECT seq, 'assistant', words || ['{ng.BOS}'], len(words) + 2, []::VARCHAR[], 0, len(words) + 2 >= {_LEN} FROM (
    SELECT seq, list_filter(regexp_split_to_array(replace(prompt, '{EOS}', ' '), '[ \\t\\n\\x0b\\f\\r]+'),
                            lambda t: t <> '') AS words FROM bench)
  UNION
  SELECT seq, author_id,
         CASE WHEN stop THEN hist ELSE list_append(hist, tok) END, plen,
         CASE WHEN stop THEN out ELSE list_append(out, tok) END,
         step + 1,
         stop OR plen + len(out) + 1 >= {_LEN}
  FROM (
    SELECT *, tok IS NULL OR tok = '{ng.EOS_TOKEN}' AS stop FROM (
      SELECT *, CASE WHEN idx IS NOT NULL AND idx > 0 THEN ok[idx].token END AS tok FROM (
        SELECT *, list_position(list_transform(range(1, len(qs) + 1), lambda i:
                      qs[i] > 0 AND cb[i] + qs[i] >= u * list_reduce(list_prepend(0.0, qs), lambda a, x: a + x)),
                      true) AS idx FROM (
          SELECT *, list_transform(range(1, len(qa) + 1), lambda i:
                      CASE WHEN cb[i] < {ng.TOP_P} THEN qa[i] ELSE 0.0 END) AS qs FROM (
            SELECT *, list_transform(range(1, len(qa) + 1), lambda i:
                        list_reduce(list_prepend(0.0, qa[1:i - 1]), lambda a, x: a + x)) AS cb FROM (
              SELECT *, list_transform(ws, lambda w: w / list_reduce(list_prepend(0.0, ws), lambda a, x: a + x)) AS qa
              FROM (
                SELECT *, list_transform(ok, lambda x: exp(ln(x.p) / {ng.TEMPERATURE})) AS ws,
                       CAST(('0x' || substr(md5('{qs.SEED}:' || CAST(seq AS VARCHAR) || ':' || CAST(step AS VARCHAR)),
                            1, 8)) AS BIGINT) / 4294967296.0 AS u
                FROM (
                  SELECT g.seq, g.author_id, g.hist, g.plen, g.out, g.step,
                         list_filter(coalesce(c.cs, []), lambda x: NOT (len(g.hist) >= {ng.NO_REPEAT_NGRAM}
                           AND list_contains(list_transform(range(1, len(g.hist) - 1), lambda i:
                                 g.hist[i] || ' ' || g.hist[i + 1] || ' ' || g.hist[i + 2]),
                               g.hist[-2] || ' ' || g.hist[-1] || ' ' || x.token)))[1:{ng.TOP_K}] AS ok
                  FROM gen g LEFT JOIN cands c ON c.author_id = g.author_id AND c.prefix = g.hist[-1]
                  WHERE NOT g.done AND g.step < {_LEN}))))))))
)""").replace("WITH ", "WITH RECURSIVE ", 1)


@register("generate_replies", GEN_SQL + """
SELECT seq, array_to_string(out, ' ') AS pred FROM gen""")
def generate_replies(spark, sf):
    model = dialog_model(spark, sf)
    return ng.generate_replies(test_prompts(spark, sf), ng.sampler_entries(model), N, seed=SEED)


@register("label_pred", GEN_SQL + """,
pairs AS (SELECT b.seq, b.response AS label, array_to_string(g.out, ' ') AS pred
          FROM bench b JOIN gen g USING (seq)),""" + _rouge_n_sql(1, "1") + "," + _rouge_n_sql(2, "2") + """
SELECT p.seq, p.label, p.pred, round(a.f, 9) AS rouge1_f, round(b.f, 9) AS rouge2_f
FROM pairs p JOIN scored1 a USING (seq) JOIN scored2 b USING (seq)""")
def label_pred(spark, sf):
    model = dialog_model(spark, sf)
    prompts = test_prompts(spark, sf)
    preds = ng.generate_replies(prompts, ng.sampler_entries(model), N, seed=SEED)
    pairs = ev.label_pred_table(prompts, preds)
    scored = ev.rouge_n(pairs, (1, 2))
    return scored.select("seq", "label", "pred", F.round("rouge1_f", 9).alias("rouge1_f"),
                         F.round("rouge2_f", 9).alias("rouge2_f"))


def _renamed(sql: str, tag: str, names: str) -> str:
    """``sql`` with its tables of these names called ``tag`` + name."""
    return re.sub(rf"\b({names})\b(?!\()", rf"{tag}\1", sql)


_REPORT = [f"{m}_f" for m in ev.ROUGE]
_MIDS = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont(m_{m}_f, 0.5) * 100, 4) AS value FROM per"
                           for m in ev.ROUGE)


@register("reply_report", GEN_SQL + """,
pairs AS (SELECT b.seq, b.response AS label, array_to_string(g.out, ' ') AS pred
          FROM bench b JOIN gen g USING (seq)),""" + _rouge_n_sql(1, "1") + "," + _rouge_n_sql(2, "2") + ","
          + _renamed(LCS_SQL, "l_", "toks") + "," + LSUM_SQL.format(pairs="pairs") + f""",
fpair AS (SELECT a.seq, a.f AS rouge1_f, b.f AS rouge2_f, {_f('l.p', 'l.r')} AS rougeL_f, {_f('s.p', 's.r')} AS rougeLsum_f
          FROM scored1 a JOIN scored2 b USING (seq) JOIN lsc l USING (seq) JOIN lsum s USING (seq)),"""
          + _bootstrap_sql(SEED, ev.BOOTSTRAP_SAMPLES, _REPORT, "fpair") + ","
          + _renamed(_HELD_SQL, "h_", "dsplit|toks|grams|counts|totals|vocab|model|ttoks|tgrams|asked|scored|ranked|batched")
          + f""",
report AS ({_MIDS} UNION ALL
           SELECT 'perplexity', round(exp(round(avg(loss), 9)), 6) FROM h_batched)
SELECT metric || ' = ' || CAST(value AS VARCHAR) AS line FROM report""")
def reply_report(spark, sf):
    """The report on all generated replies of the test split: four mid ROUGE
    scores and the held-out perplexity, written as lines and read back."""
    prompts = test_prompts(spark, sf)
    preds = ng.generate_replies(prompts, ng.sampler_entries(dialog_model(spark, sf)), N, seed=SEED)
    report = ev.reply_report(ev.label_pred_table(prompts, preds), held_out_perplexity(spark, sf), seed=SEED)
    path = _scratch(spark, "reply-report")
    ev.write_eval_report(report, path)
    return spark.read.text(path).select(F.col("value").alias("line"))
