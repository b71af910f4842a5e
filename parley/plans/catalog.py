"""Registry of named queries: a Spark builder and (where SQL can say it)
an equivalent DuckDB query over the same parquet tables.

Every query reads whole driver tables through the views in ``views``;
array results are emitted as joined strings and doubles are rounded so
that both engines hash equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


# streaming queries that must equal a batch query share its oracle
TWINS = {"stream_clean": "clean_all", "stream_prompts": "prompts", "stream_triggers": "triggers"}


def oracles() -> dict[str, str]:
    _load()
    out = dict(_ORACLES)
    for stream_name, batch_name in TWINS.items():
        if stream_name in _QUERIES and batch_name in out:
            out[stream_name] = out[batch_name]
    return out


def _load() -> None:
    # importing the modules registers their queries
    from parley.plans import q_clean, q_package, q_sequences, q_evaluate, q_serve, q_model, q_stream, q_sources  # noqa: F401
