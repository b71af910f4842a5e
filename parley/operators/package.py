"""Packaging P1..P14: response + preceding context rows for target
authors, an exact seeded train/test split and context extrapolation."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.windows import BROADCAST_ROWS, counted_broadcast, preceding
from parley.session import materialize

# fixed values of the original tool
MIN_TEST_ROWS = 4            # per-device batch size; the smallest usable test set
DEFAULT_LENGTH = 2
DEFAULT_TEST_PERC = 0.1


class TargetNotFoundError(ValueError):
    """No roster row carries the target name."""


class ParamError(ValueError):
    """Invalid packaging parameters."""


@dataclass(frozen=True)
class PackageParams:
    """``length`` >= 1, ``window`` unset or > ``length``, 0 < test_perc < 1."""
    length: int = DEFAULT_LENGTH
    window: int | None = None
    test_perc: float = DEFAULT_TEST_PERC
    seed: int = 0
    scope: str = "channel"

    def __post_init__(self):
        if self.length < 1:
            raise ParamError("context length must be at least 1")
        if self.window is not None and self.window <= self.length:
            raise ParamError("context window must be larger than the context length")
        if not (0 < self.test_perc < 1):
            raise ParamError("test percentage must be between 0 and 1")
        if self.scope not in ("channel", "session"):
            raise ParamError("scope is 'channel' or 'session'")

    @property
    def base_k(self) -> int:
        """Context kept in the packaged table: the window if set, else the length."""
        return self.window if self.window else self.length


def check_params(sets: DataFrame) -> DataFrame:
    """P13 for a table of parameter sets (``length``, ``window``, ``test_perc``; null: the
    default): the set that would be used, and ``error`` (null: valid)."""
    length = F.coalesce(F.col("length"), F.lit(DEFAULT_LENGTH))
    perc = F.coalesce(F.col("test_perc"), F.lit(DEFAULT_TEST_PERC))
    error = F.when(length < 1, "context length must be at least 1") \
        .when(F.col("window") <= length, "context window must be larger than the context length") \
        .when(~((perc > 0) & (perc < 1)), "test percentage must be between 0 and 1")
    return sets.withColumn("error", error).withColumn("length", length).withColumn("test_perc", perc)


def resolve_target(members: DataFrame, name: str) -> str:
    """Id of the first roster row called ``name``."""
    row = members.where(F.col("name") == name).orderBy("pos").select("id").first()
    if row is None:
        raise TargetNotFoundError(f"no member called {name!r}")
    return str(row[0])


def resolve_targets(members: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    """P1 for many targets: ``(target, id)``, the first roster row of every
    distinct name of ``names`` (a list, or a table with a column ``name``).
    Names without a roster row are an error that names some of them."""
    if not isinstance(names, DataFrame):
        names = members.sparkSession.createDataFrame([(n,) for n in names], "name string")
    wanted = names.select(F.col("name").alias("target")).where(F.col("target").isNotNull()).distinct()
    first = members.groupBy(F.col("name").alias("target")).agg(
        F.min_by(F.col("id").cast("string"), "pos").alias("id"))
    found = materialize(wanted.join(first, "target", "left"))
    missing = [r[0] for r in found.where(F.col("id").isNull()).orderBy("target").limit(5).collect()]
    if missing:
        raise TargetNotFoundError(f"no member called {missing}")
    return found


def scope_columns(scope: str | Sequence[str]) -> list[str]:
    if isinstance(scope, str):
        return [] if scope == "session" else [scope]
    return list(scope)


def context_window(messages: DataFrame, k: int, scope: str | Sequence[str] = "channel",
                   order: str | Sequence[str] = "seq", block_rows: int | None = None) -> DataFrame:
    """P2 (+P10/P11): ``ctx`` = the k messages before each row (nearest
    first) inside the scope; ``n_before`` counts them.  ``scope='session'``
    is one global sequence, still computed without a one-partition window."""
    return preceding(messages, k, scope_columns(scope), order, "content", "ctx", block_rows)


def package(messages: DataFrame, targets: str | Sequence[str] | DataFrame, k: int,
            scope: str | Sequence[str] = "channel", order: str | Sequence[str] = "seq",
            block_rows: int | None = None) -> DataFrame:
    """P2 + P3 + P4: rows written by a target that have k earlier messages.

    The author filter runs after the window (it is not a partition key,
    so it cannot be pushed below it)."""
    w = context_window(messages, k, scope, order, block_rows)
    full = F.col("n_before") == k
    if isinstance(targets, DataFrame):
        # the distinct target ids are broadcast after their count is checked,
        # so the windowed rows never shuffle for this filter
        t = targets.select(F.col("id").cast("string").alias("author_id")).distinct()
        if t.count() <= BROADCAST_ROWS:
            t = F.broadcast(t)
        out = w.where(full).join(t, "author_id", "left_semi")
    else:
        ids = [targets] if isinstance(targets, str) else list(targets)
        out = w.where(full & F.col("author_id").isin(ids))
    return out.select("seq", "author_id", F.col("content").alias("response"), "ctx")


def flatten_context(df: DataFrame, k: int, ctx: str = "ctx", keep: Sequence[str] = ("seq",)) -> DataFrame:
    """P5: ``response, context1..contextK`` flat columns."""
    return df.select(*keep, "response",
                     *[F.col(ctx)[i].alias(f"context{i + 1}") for i in range(k)])


def shuffle_key(seed: int, id_col: str = "seq") -> Column:
    """Deterministic permutation key, reproducible in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def split_exact(df: DataFrame, test_perc: float, seed: int, id_col: str = "seq",
                max_edge_rows: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """test = the first ``int(test_perc * n)`` rows of the seeded
    permutation, train = the rest; exact sizes, disjoint, no global sort.

    A histogram of key prefixes (at most 65 536 counts) finds the bucket
    holding the cut; only that bucket is ranked, and the cut becomes one
    ``(key, id)`` threshold so both sides are plain filters.
    """
    key = shuffle_key(seed, id_col)
    k = df.withColumn("_skey", key)
    pref = F.substring("_skey", 1, 4)
    hist = sorted((r[0], int(r[1])) for r in k.groupBy(pref.alias("p")).count().collect())
    n = sum(c for _, c in hist)           # the histogram also gives the total
    n_test = int(test_perc * n)
    if n_test <= 0:
        return k.drop("_skey"), k.where(F.lit(False)).drop("_skey")
    if n_test >= n:
        return k.where(F.lit(False)).drop("_skey"), k.drop("_skey")
    cond, need, plen = F.lit(True), n_test, 0
    while True:
        acc = 0
        for p, c in hist:
            if acc + c >= need:
                cond = cond & (pref == p)
                need -= acc
                edge_rows = c
                break
            acc += c
        plen += 4
        if edge_rows <= max_edge_rows or plen >= 32:
            break
        # refine inside the edge bucket with the next four hex digits
        pref = F.substring("_skey", plen + 1, 4)
        hist = sorted((r[0], int(r[1])) for r in
                      k.where(cond).groupBy(pref.alias("p")).count().collect())
    edge = k.where(cond).select("_skey", id_col)
    w = Window.orderBy("_skey", id_col)
    cut = edge.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == need).first()
    ck, ci = F.lit(cut["_skey"]), F.lit(cut[id_col]).cast(df.schema[id_col].dataType)
    is_test = (F.col("_skey") < ck) | ((F.col("_skey") == ck) & (F.col(id_col) <= ci))
    train = k.where(~is_test).drop("_skey")
    test = k.where(is_test).drop("_skey")
    return train, test


def split_exact_by(df: DataFrame, by: Sequence[str], test_perc: float, seed: int, id_col: str = "seq",
                   max_edge_rows: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """P7 inside every group ``by``: test = the first ``int(test_perc * n)`` rows
    of the group's seeded permutation, train = the rest.

    One histogram of (group, key prefix) finds in every group the bucket that
    holds its cut; while a bucket is larger than ``max_edge_rows`` its rows are
    counted by four more hex digits.  Only edge buckets are ranked, so a group
    of any size is never sorted by one task, and the groups are worked on
    together: at most eight passes, whatever their number.
    """
    group = F.struct(*[F.col(c) for c in by])
    k = df.withColumn("_g", group).withColumn("_skey", shuffle_key(seed, id_col))
    up_to = Window.partitionBy("_g").orderBy("_p")
    digits = 4

    def edges(counted: DataFrame, need: Column) -> DataFrame:
        """(_g, _p, _need, _n): the bucket of every group in which its cut lies."""
        x = counted.withColumn("_need", need).withColumn("_cum", F.sum("_n").over(up_to))
        return materialize(x.where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_n") < F.col("_need")))
                           .select("_g", "_p", (F.col("_need") - F.col("_cum") + F.col("_n")).alias("_need"), "_n"))

    hist = k.groupBy("_g", F.substring("_skey", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("_g"))
    edge = edges(hist, F.floor(F.lit(float(test_perc)) * total.cast("double")).cast("long"))

    def inside(columns: list) -> DataFrame:
        x = k.select("_g", F.substring("_skey", 1, digits).alias("_p"), *columns)
        return x.join(counted_broadcast(edge), ["_g", "_p"])      # a large group is spread over its prefixes

    while digits < 32 and (edge.agg(F.max("_n")).first()[0] or 0) > max_edge_rows:
        deeper = inside([F.substring("_skey", 1, digits + 4).alias("_q")])
        hist = deeper.groupBy("_g", "_need", F.col("_q").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        digits += 4
        edge = edges(hist, F.col("_need"))
    ranked = Window.partitionBy("_g").orderBy("_ck", "_ci")
    cuts = inside([F.col("_skey").alias("_ck"), F.col(id_col).alias("_ci")]) \
        .withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") == F.col("_need")).select("_g", "_ck", "_ci")
    j = k.join(counted_broadcast(materialize(cuts)), "_g", "left")
    before = (F.col("_skey") < F.col("_ck")) | ((F.col("_skey") == F.col("_ck")) & (F.col(id_col) <= F.col("_ci")))
    is_test = F.coalesce(before, F.lit(False))          # a group without a cut has no test rows
    return j.where(~is_test).select(*df.columns), j.where(is_test).select(*df.columns)


def combos(length: int, window: int) -> list[tuple[int, ...]]:
    """All order-preserving choices of ``length`` of ``window`` positions,
    in lexicographic order."""
    return list(itertools.combinations(range(window), length))


def extrapolate(df: DataFrame, length: int, window: int, ctx: str = "ctx") -> DataFrame:
    """One row per C(window, length) sub-sequence of the context, with
    ``combo`` = its lexicographic index.  Nothing is de-duplicated."""
    lit = F.array(*[F.array(*[F.lit(i) for i in c]) for c in combos(length, window)])
    cols = [c for c in df.columns if c != ctx]
    x = df.select(*cols, ctx, F.posexplode(lit).alias("combo", "_idx"))
    return x.select(*cols, F.col("combo").cast("long").alias("combo"),
                    F.transform("_idx", lambda i: F.col(ctx)[i]).alias(ctx))


def ensure_min_test(train: DataFrame, test: DataFrame, seed: int, n: int = MIN_TEST_ROWS,
                    id_col: str = "seq") -> DataFrame:
    """A test set with fewer than ``n`` rows is replaced by the first
    ``n`` train rows (in permutation order); they also stay in train."""
    if test.limit(n).count() >= n:
        return test
    order = [shuffle_key(seed, id_col), F.col(id_col)]
    if "combo" in train.columns:
        order.append(F.col("combo"))
    return train.orderBy(*order).limit(n)


def ensure_min_test_by(train: DataFrame, test: DataFrame, by: Sequence[str], seed: int, n: int = MIN_TEST_ROWS,
                       id_col: str = "seq") -> DataFrame:
    """P9 inside every group ``by``: the test set of a group with fewer than ``n``
    rows is replaced by its first ``n`` train rows (in permutation order)."""
    group = F.struct(*[F.col(c) for c in by])
    cols = train.columns
    enough = materialize(test.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
                         .where(F.col("_n") >= n).select("_g"))
    enough = counted_broadcast(enough)
    order = [shuffle_key(seed, id_col), F.col(id_col), *([F.col("combo")] if "combo" in cols else [])]
    # the rank filter is applied before the rows are moved, so a group sends few of them
    first = train.withColumn("_g", group).join(enough, "_g", "left_anti") \
        .withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("_r") <= n)
    kept = test.withColumn("_g", group).join(enough, "_g", "left_semi")
    return kept.select(*cols).unionByName(first.select(*cols))


def package_for_training(messages: DataFrame, members: DataFrame, targets: str | Sequence[str] | DataFrame,
                         params: PackageParams, block_rows: int | None = None) -> dict[str, DataFrame]:
    """P1 -> P2..P5 -> P6/P7 -> P8 -> P9.  ``packaged`` is the table
    before the split and extrapolation.

    ``targets`` is one name, or several (a list, or a table with a column
    ``name``): then all tables have a column ``target``, and every target is
    split, and its small test set replaced, on its own.
    """
    k = params.base_k
    if isinstance(targets, str):
        target = resolve_target(members, targets)
        packaged = materialize(package(messages, target, k, params.scope, block_rows=block_rows))
        train, test = split_exact(packaged, params.test_perc, params.seed)
    else:
        wanted = resolve_targets(members, targets)
        rows = package(messages, wanted, k, params.scope, block_rows=block_rows)
        packaged = materialize(rows.join(counted_broadcast(wanted), rows["author_id"] == wanted["id"]).drop("id"))
        train, test = split_exact_by(packaged, ["target"], params.test_perc, params.seed)
    if params.window:
        train = extrapolate(train, params.length, params.window)
        test = extrapolate(test, params.length, params.window)
    if isinstance(targets, str):
        test = ensure_min_test(train, test, params.seed)
    else:
        test = ensure_min_test_by(train, test, ["target"], params.seed)
    return {"packaged": packaged, "train": train, "test": test}
