"""Traces derived from the driver's tables: (trace_id, t, var, value), and other inputs of the named queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from mutua.sqltext import Op
from mutua.storage import materialise, table

#: Hourly counts by event type, filled with zeros; users are dealt over four traces.
HOURLY = Op("""
WITH e AS (SELECT CAST(user_id % 4 AS STRING) AS trace_id, HOURNO(ts) AS t, event_type AS var FROM {events}),
span AS (SELECT trace_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY trace_id),
spine AS (SELECT trace_id, var, SEQ(lo, hi) AS t FROM (SELECT DISTINCT trace_id, var FROM e) AS v JOIN span USING (trace_id)),
n AS (SELECT trace_id, t, var, count(*) AS n FROM e GROUP BY trace_id, t, var)
SELECT trace_id, CAST(t AS BIGINT) AS t, var, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM spine LEFT JOIN n USING (trace_id, t, var)
""")

#: Daily totals of line items by flag and status.
SHIPPED = Op("""
WITH e AS (SELECT CAST(l_linenumber % 2 AS STRING) AS trace_id, DAYNO(l_shipdate, 1995-01-01) AS t, concat(l_returnflag, l_linestatus) AS var, l_quantity AS q FROM {lineitem}),
n AS (SELECT trace_id, t, var, sum(q) AS n FROM e GROUP BY trace_id, t, var),
span AS (SELECT trace_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY trace_id),
spine AS (SELECT trace_id, var, SEQ(lo, hi) AS t FROM (SELECT DISTINCT trace_id, var FROM e) AS v JOIN span USING (trace_id))
SELECT trace_id, CAST(t AS BIGINT) AS t, var, coalesce(n, CAST(0 AS DOUBLE)) AS value FROM spine LEFT JOIN n USING (trace_id, t, var)
""")

#: Hourly values, 1 where above the variable's median.
BINARY = Op("""
WITH m AS (SELECT trace_id, var, PCT(value, 0.5) AS mid FROM {hourly} GROUP BY trace_id, var)
SELECT trace_id, t, var, CAST(value > mid AS INT) AS x FROM {hourly} JOIN m USING (trace_id, var)
""")

#: Events of each user in order: value, the previous value's difference, and whether it is an error.
USERS = Op("""
SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_id, ts, event_type, value, props FROM {events}
""")

_VIEWS: dict[str, tuple[Op, tuple[str, ...]]] = {
    "hourly": (HOURLY, ("events",)),
    "shipped": (SHIPPED, ("lineitem",)),
    "binary": (BINARY, ("hourly",)),
    "users": (USERS, ("events",)),
}


#: Views that are written once where a query reads them, so that what follows has a short
#: plan and true sizes. The traces are among them: they are counts of events, far smaller than the events.
_CUT = {"hourly", "shipped", "binary"}


#: Views already built for the query at hand, by folder and name.
_BUILT: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("built", default=None)


@contextmanager
def one_query() -> Iterator[None]:
    """Within it, each view of a folder is built, and written where it is cut, once."""
    token = _BUILT.set({})
    try:
        yield
    finally:
        _BUILT.reset(token)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table of the folder."""
    built = _BUILT.get()
    if built is None:
        with one_query():
            return view(spark, sf_dir, name)
    if (sf_dir, name) not in built:
        if name not in _VIEWS:
            found = table(spark, sf_dir, name)
        else:
            op, inputs = _VIEWS[name]
            found = op(**{k: view(spark, sf_dir, k) for k in inputs})
        built[sf_dir, name] = materialise(found, name) if name in _CUT else found
    return built[sf_dir, name]


def view_sql(name: str) -> str:
    """DuckDB text of the same view."""
    if name not in _VIEWS:
        return f"SELECT * FROM {name}"
    op, inputs = _VIEWS[name]
    return op.duckdb(**{k: view_sql(k) for k in inputs})


def add_view(name: str, op: Op, *inputs: str, cut: bool = False) -> None:
    _VIEWS[name] = (op, inputs)
    if cut:
        _CUT.add(name)
