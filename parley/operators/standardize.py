"""Standardisation T1..T6: project messages, reconcile the roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.windows import dense_index


class UnknownMemberError(ValueError):
    """A target id that no roster row carries."""


def standardize(messages: DataFrame, author_col: str, content_col: str,
                keep: tuple[str, ...] = ("seq", "ts", "channel")) -> DataFrame:
    """T1 + T4: ``author_id`` (string) and ``content``; order and duplicates kept.
    Extra columns in ``keep`` ride along when present."""
    extras = [c for c in keep if c in messages.columns and c not in (author_col, content_col)]
    return messages.select(*extras,
                           F.col(author_col).cast("string").alias("author_id"),
                           F.col(content_col).cast("string").alias("content"))


def missing_members(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct authors with no roster row (ids compared as strings)."""
    authors = messages.select(F.col("author_id").cast("string").alias("id")) \
                      .where(F.col("id").isNotNull()).distinct()
    roster = members.select(F.col("id").cast("string").alias("id"))
    return authors.join(roster, "id", "left_anti")


def extend_members(members: DataFrame, missing: DataFrame,
                   overrides: DataFrame | None = None) -> DataFrame:
    """Append one ``(id, name)`` row per missing id; the name is the
    override when given, else the id itself.  New rows sort after the
    existing roster (``pos`` above its maximum), by id."""
    m = members.select(F.col("id").cast("string").alias("id"), "name",
                       F.col("pos").cast("long").alias("pos"))
    top = m.agg(F.max("pos")).first()[0]
    base = -1 if top is None else int(top)
    new = missing.select(F.col("id").cast("string").alias("id"))
    if overrides is not None:
        ov = overrides.select(F.col("id").cast("string").alias("id"),
                              F.col("name").alias("_ov"))
        new = new.join(ov, "id", "left")
    else:
        new = new.withColumn("_ov", F.lit(None).cast("string"))
    new = dense_index(new.select("id", F.coalesce("_ov", "id").alias("name")), ["id", "name"], "pos") \
        .withColumn("pos", F.col("pos") + F.lit(base + 1))
    return m.unionByName(new)


def assign_target(members: DataFrame, target_name: str, target_id: str) -> DataFrame:
    """T5: if nobody is called ``target_name``, give that name to every roster
    row with ``target_id``; an unknown id is an error."""
    if members.where(F.col("name") == target_name).limit(1).count() > 0:
        return members
    if members.where(F.col("id").cast("string") == target_id).limit(1).count() == 0:
        raise UnknownMemberError(f"no member with id {target_id!r}")
    return members.withColumn(
        "name", F.when(F.col("id").cast("string") == target_id, F.lit(target_name))
                 .otherwise(F.col("name")))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, non-null count, total rows —
    computed in a single aggregation."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + \
           [F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.col(f"_nn{i}").alias("non_null"))
        for i, c in enumerate(df.columns)]))
    return row.select(stacked.alias("s"), "_rows").select(
        "s.column", "s.dtype", F.col("s.non_null").cast("long").alias("non_null"),
        F.col("_rows").cast("long").alias("rows"))
