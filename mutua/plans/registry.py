"""All named queries, with the DuckDB text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.sources.views import one_query, view, view_sql
from mutua.sqltext import Op

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "lag_max_mi"
DIGITS = 9
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def _scoped(query: Query) -> Query:
    """``query`` with each of its views built once."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with one_query():
            return query(spark, sf_dir)

    return run


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under ``name``."""

    def put(query: Query) -> Query:
        _QUERIES[name] = _scoped(query)
        if sql is not None:
            _ORACLE[name] = sql
        return query

    return put


def put(name: str, op: Op, floats: str = "", ints: str = "", by: Callable[..., DataFrame] | None = None, **inputs: str) -> None:
    """Register an operator over views. ``floats`` are rounded and ``ints`` made long, the same way in both engines.

    ``by`` gives in Spark what the operator's text says, where a plan of the text would not do.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = (by or op)(**{k: view(spark, sf_dir, v) for k, v in inputs.items()})
        changes = {c: F.round(F.col(c).cast("double"), DIGITS) + 0.0 for c in floats.split()} | {c: F.col(c).cast("long") for c in ints.split()}
        return out.withColumns(changes) if changes else out

    replaced = [f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in floats.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    inner = op.duckdb(**{k: view_sql(v) for k, v in inputs.items()})
    _QUERIES[name] = _scoped(query)
    _ORACLE[name] = f"SELECT * {'REPLACE (' + ', '.join(replaced) + ')' if replaced else ''} FROM ({inner}) AS q"


def _load() -> None:
    from mutua.plans import catalog, wide  # noqa: F401  they fill the registry


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
