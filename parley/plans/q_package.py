"""Queries for packaging (P1..P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import package as pk
from parley.plans import views as v
from parley.plans.catalog import register
from parley.plans.q_clean import cleaned_chat_once
from parley.session import materialize

SEED = 42
TEST_PERC = 0.1
SMALL_TEST_PERC = 0.05
LENGTH, WINDOW = 2, 6

_TARGET_ID = f"(SELECT id FROM members WHERE name = '{v.TARGET_NAME}' ORDER BY pos LIMIT 1)"


def _lags(k, order, part=""):
    cols = ",\n  ".join(f"lag(content, {i}) OVER w AS context{i}" for i in range(1, k + 1))
    return (f"SELECT seq, author_id, content AS response,\n  {cols},\n  row_number() OVER w AS rn\n"
            f"FROM cleaned WINDOW w AS ({part} ORDER BY {order})")


def _ctx_cols(k):
    return ", ".join(f"context{i}" for i in range(1, k + 1))


# package_session cuts the one global sequence into blocks of this many
# rows even on small inputs, so the split-and-repair path of the window
# operator is what the check exercises (the result does not depend on it)
SESSION_BLOCK_ROWS = 1024


def target_rows(spark, sf, k, scope, block_rows=None):
    msgs = cleaned_chat_once(spark, sf)
    target = pk.resolve_target(v.members(spark, sf), v.TARGET_NAME)
    return pk.package(msgs, target, k, scope, block_rows=block_rows)


def all_rows(spark, sf, k, scope):
    return pk.package(cleaned_chat_once(spark, sf), v.members(spark, sf), k, scope)


@register("package_context", v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
win AS ({_lags(2, 'seq', 'PARTITION BY channel')})""") + f"""
SELECT seq, response, {_ctx_cols(2)} FROM win WHERE author_id = {_TARGET_ID} AND rn > 2""")
def package_context(spark, sf):
    return pk.flatten_context(target_rows(spark, sf, 2, "channel"), 2)


@register("package_session", v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
win AS ({_lags(WINDOW, 'seq')})""") + f"""
SELECT seq, response, {_ctx_cols(WINDOW)} FROM win WHERE author_id = {_TARGET_ID} AND rn > {WINDOW}""")
def package_session(spark, sf):
    return pk.flatten_context(target_rows(spark, sf, WINDOW, "session", SESSION_BLOCK_ROWS), WINDOW)


@register("package_target", v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
win AS ({_lags(3, 'ts, seq', 'PARTITION BY channel')})""") + f"""
SELECT seq, author_id, response, {_ctx_cols(3)} FROM win
WHERE author_id IN (SELECT id FROM members) AND rn > 3""")
def package_target(spark, sf):
    # every roster member is a target; per-channel time order
    from parley.operators.clean import channel_time_scope
    by, order = channel_time_scope()
    rows = pk.package(cleaned_chat_once(spark, sf), v.members(spark, sf), 3, by, order)
    return pk.flatten_context(rows, 3, keep=("seq", "author_id"))


_ALL_SESSION = v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
win AS ({_lags(WINDOW, 'seq')}),
pk AS (SELECT * FROM win WHERE author_id IN (SELECT id FROM members) AND rn > {WINDOW}),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(seq AS VARCHAR)), seq) AS r,
                  CAST(floor({TEST_PERC}::DOUBLE * count(*) OVER ()) AS BIGINT) AS n_test FROM pk)""")


def _split_all(spark, sf):
    # the split reads its input three times (histogram, edge, filters):
    # cut the lineage once instead of recomputing the window each time
    rows = materialize(all_rows(spark, sf, WINDOW, "session"))
    return pk.split_exact(rows, TEST_PERC, SEED)


@register("split_test", _ALL_SESSION + f"""
SELECT seq, response, {_ctx_cols(WINDOW)} FROM ranked WHERE r <= n_test""")
def split_test(spark, sf):
    return pk.flatten_context(_split_all(spark, sf)[1], WINDOW)


@register("split_train", _ALL_SESSION + f"""
SELECT seq, response, {_ctx_cols(WINDOW)} FROM ranked WHERE r > n_test""")
def split_train(spark, sf):
    return pk.flatten_context(_split_all(spark, sf)[0], WINDOW)


_COMBOS = "[" + ", ".join("[" + ", ".join(str(i + 1) for i in c) + "]"
                          for c in pk.combos(LENGTH, WINDOW)) + "]"


@register("extrapolate", _ALL_SESSION + f""",
ctx AS (SELECT seq, response, [{_ctx_cols(WINDOW)}] AS c FROM ranked WHERE r > n_test),
ix AS (SELECT seq, response, c, unnest({_COMBOS}) AS idx,
              unnest(range(0, {len(pk.combos(LENGTH, WINDOW))})) AS combo FROM ctx)
SELECT seq, combo, response, c[idx[1]] AS context1, c[idx[2]] AS context2 FROM ix""")
def extrapolate(spark, sf):
    train = pk.extrapolate(_split_all(spark, sf)[0], LENGTH, WINDOW)
    return pk.flatten_context(train, LENGTH, keep=("seq", "combo"))


@register("min_test_fallback", v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
win AS ({_lags(2, 'seq', 'PARTITION BY channel')}),
pk AS (SELECT * FROM win WHERE author_id = {_TARGET_ID} AND rn > 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(seq AS VARCHAR)), seq) AS r,
                  CAST(floor({SMALL_TEST_PERC}::DOUBLE * count(*) OVER ()) AS BIGINT) AS n_test FROM pk)""") + f"""
SELECT seq, response, {_ctx_cols(2)} FROM ranked
WHERE (n_test >= 4 AND r <= n_test) OR (n_test < 4 AND r > n_test AND r <= n_test + 4)""")
def min_test_fallback(spark, sf):
    rows = materialize(target_rows(spark, sf, 2, "channel"))
    train, test = pk.split_exact(rows, SMALL_TEST_PERC, SEED)
    return pk.flatten_context(pk.ensure_min_test(train, test, SEED), 2)


# the three tables of P14 in SQL, for the rows `pk` with their `target`
_SETS_SQL = f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('{SEED}:' || CAST(seq AS VARCHAR)), seq) AS r,
                  CAST(floor({TEST_PERC}::DOUBLE * count(*) OVER (PARTITION BY target)) AS BIGINT) AS n_test FROM pk),
ix AS (SELECT target, seq, response, [{_ctx_cols(WINDOW)}] AS c, r, r <= n_test AS is_test,
              n_test * {len(pk.combos(LENGTH, WINDOW))} >= {pk.MIN_TEST_ROWS} AS enough,
              unnest({_COMBOS}) AS idx, unnest(range(0, {len(pk.combos(LENGTH, WINDOW))})) AS combo FROM ranked),
fallback AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY r, combo) AS f FROM ix
             WHERE NOT enough AND NOT is_test),
sets AS (
  SELECT 'train' AS part, target, seq, response, c, idx, combo FROM ix WHERE NOT is_test
  UNION ALL SELECT 'test', target, seq, response, c, idx, combo FROM ix WHERE is_test AND enough
  UNION ALL SELECT 'test', target, seq, response, c, idx, combo FROM fallback WHERE f <= {pk.MIN_TEST_ROWS}
  UNION ALL SELECT 'packaged', target, seq, response, c, [1, 2], NULL FROM (
    SELECT target, seq, response, [{_ctx_cols(WINDOW)}] AS c FROM ranked))
"""


def _sets(out, *extra):
    """The three tables as one: the first contexts of a packaged row stand for it."""
    parts = []
    for name in ("packaged", "train", "test"):
        x = out[name] if "combo" in out[name].columns else out[name].withColumn("combo", F.lit(None).cast("long"))
        parts.append(pk.flatten_context(x, LENGTH, keep=(*extra, "seq", "combo")).withColumn("part", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PARAMS = pk.PackageParams(length=LENGTH, window=WINDOW, test_perc=TEST_PERC, seed=SEED, scope="channel")


@register("training_sets", v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
win AS ({_lags(WINDOW, 'seq', 'PARTITION BY channel')}),
pk AS (SELECT *, 1 AS target FROM win WHERE author_id = {_TARGET_ID} AND rn > {WINDOW})""" + _SETS_SQL) + """
SELECT part, seq, combo, response, c[idx[1]] AS context1, c[idx[2]] AS context2 FROM sets""")
def training_sets(spark, sf):
    """P14 end to end for one target (window 6, length 2, 10 % test, seed 42,
    per-channel scope): the rows of its three tables."""
    return _sets(pk.package_for_training(cleaned_chat_once(spark, sf), v.members(spark, sf), v.TARGET_NAME, _PARAMS))


@register("training_targets", v.with_views("chat", "members", extra=v.CLEAN_SQL + f""",
win AS ({_lags(WINDOW, 'seq', 'PARTITION BY channel')}),
wanted AS (SELECT name AS target, arg_min(id, pos) AS id FROM members GROUP BY name),
pk AS (SELECT w.*, t.target FROM win w JOIN wanted t ON w.author_id = t.id WHERE rn > {WINDOW})""" + _SETS_SQL) + """
SELECT part, target, seq, combo, response, c[idx[1]] AS context1, c[idx[2]] AS context2 FROM sets""")
def training_targets(spark, sf):
    """P14 for every member of the roster at once: an exact split of each."""
    m = v.members(spark, sf)
    return _sets(pk.package_for_training(cleaned_chat_once(spark, sf), m, m.select("name"), _PARAMS), "target")


@register("targets", v.with_views("members") + """
SELECT name AS target, arg_min(id, pos) AS id FROM members GROUP BY name""")
def targets(spark, sf):
    """P1 for every name of the roster."""
    m = v.members(spark, sf)
    return pk.resolve_targets(m, m.select("name"))


_SETS = """SELECT event_id AS set_id, CASE WHEN event_id % 11 <> 3 THEN event_id % 5 END AS length,
  CASE WHEN event_id % 3 <> 1 THEN event_id % 9 END AS window_,
  CASE WHEN event_id % 13 <> 2 THEN (event_id % 12 - 1) / 10.0 END AS test_perc FROM events"""


@register("param_sets", f"""
WITH s AS ({_SETS}), d AS (SELECT set_id, coalesce(length, {pk.DEFAULT_LENGTH}) AS length, window_,
                                  coalesce(test_perc, {pk.DEFAULT_TEST_PERC}) AS test_perc FROM s)
SELECT set_id, length, window_ AS "window", round(test_perc, 6) AS test_perc,
       CASE WHEN length < 1 THEN 'context length must be at least 1'
            WHEN window_ <= length THEN 'context window must be larger than the context length'
            WHEN NOT (test_perc > 0 AND test_perc < 1) THEN 'test percentage must be between 0 and 1' END AS error
FROM d""")
def param_sets(spark, sf):
    """P13 over a table of parameter sets, one per event."""
    e = F.col("event_id")
    sets = v.table(spark, sf, "events").select(
        e.alias("set_id"), F.when(e % 11 != 3, e % 5).alias("length"), F.when(e % 3 != 1, e % 9).alias("window"),
        F.when(e % 13 != 2, (e % 12 - 1) / 10.0).alias("test_perc"))
    return pk.check_params(sets).withColumn("test_perc", F.round("test_perc", 6))
