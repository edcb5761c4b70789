"""Filters, binning and row-wise preparation of traces (trace_id, t, var, value).

All windows are partitioned by trace and variable, so the work spreads over series.
Nulls in ``value`` are left out by the aggregates and stay null row by row.
"""

from __future__ import annotations

from mutua.sqltext import Op

SERIES = "PARTITION BY trace_id, var ORDER BY t"

ACTIVE = Op("SELECT trace_id, var, var_pop(value) AS variance FROM {trace} GROUP BY trace_id, var HAVING var_pop(value) > 0")

TRACE_STATISTICS = Op("""
SELECT trace_id, count(*) AS n_vars, count_if(variance > 0) AS n_active, min(variance) AS least_variance, max(variance) AS most_variance, count_if(variance > 0) >= 2 AS enough
FROM (SELECT trace_id, var, var_pop(value) AS variance FROM {trace} GROUP BY trace_id, var) AS v GROUP BY trace_id
""")


def quantile_bins(bins: int = 4) -> Op:
    """``bin`` is the number of inner quantile edges at or below the value; equal edges leave bins out."""
    edges = ", ".join(f"PCT(value, {k / bins:.12g}) AS e{k}" for k in range(1, bins))
    count = " + ".join(f"CAST(value >= e{k} AS INT)" for k in range(1, bins)) or "0"
    return Op(f"WITH q AS (SELECT trace_id, var{', ' + edges if edges else ''} FROM {{trace}} GROUP BY trace_id, var) SELECT trace_id, t, var, {count} AS bin FROM {{trace}} JOIN q USING (trace_id, var)")


#: Equal widths between minimum and maximum, floor(sqrt(n)) bins, for series of more distinct values than that; rank of the value else.
EQUAL_WIDTH_BINS = Op("""
WITH s AS (SELECT trace_id, var, min(value) AS lo, max(value) AS hi, floor(sqrt(count(*))) AS bins, count(DISTINCT value) AS kinds FROM {trace} GROUP BY trace_id, var)
SELECT trace_id, t, var, CASE WHEN kinds <= bins THEN CAST(dense_rank() OVER (PARTITION BY trace_id, var ORDER BY value) - 1 AS INT)
  ELSE CAST(greatest(0, least(bins - 1, floor((value - lo) / ((hi - lo) / bins)))) AS INT) END AS bin
FROM {trace} JOIN s USING (trace_id, var)
""")

ZSCORE = Op("""
WITH s AS (SELECT trace_id, var, avg(value) AS mean, stddev_pop(value) AS sd FROM {trace} GROUP BY trace_id, var)
SELECT trace_id, t, var, (value - mean) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END AS z FROM {trace} JOIN s USING (trace_id, var)
""")

FIRST_DIFFERENCE = Op(f"SELECT * FROM (SELECT trace_id, t, var, value - lag(value) OVER ({SERIES}) AS value FROM {{trace}}) AS d WHERE value IS NOT NULL")

#: Whitened series: z-scores, then differences.
PREPROCESS = Op(f"""
WITH s AS (SELECT trace_id, var, avg(value) AS mean, stddev_pop(value) AS sd FROM {{trace}} GROUP BY trace_id, var),
z AS (SELECT trace_id, t, var, (value - mean) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END AS z FROM {{trace}} JOIN s USING (trace_id, var))
SELECT * FROM (SELECT trace_id, t, var, z - lag(z) OVER ({SERIES}) AS w FROM z) AS d WHERE w IS NOT NULL
""")

#: Linear interpolation onto as many evenly spaced instants as there are samples. Input (trace_id, clock, value); fewer than 3 samples stay as they are.
RESAMPLE_UNIFORM = Op("""
WITH s AS (SELECT trace_id, CAST(clock AS DOUBLE) AS clock, avg(value) AS value FROM {samples} GROUP BY trace_id, clock),
b AS (SELECT trace_id, min(clock) AS lo, max(clock) AS hi, count(*) AS n FROM s GROUP BY trace_id HAVING count(*) >= 3),
g AS (SELECT trace_id, lo + (hi - lo) * k / (n - 1) AS clock, k FROM (SELECT trace_id, lo, hi, n, SEQ(CAST(0 AS BIGINT), n - 1) AS k FROM b) AS e),
u AS (SELECT trace_id, clock, value, CAST(NULL AS BIGINT) AS k FROM s UNION ALL SELECT trace_id, clock, CAST(NULL AS DOUBLE), k FROM g),
w AS (SELECT trace_id, clock, k,
  max(CASE WHEN value IS NOT NULL THEN clock END) OVER (PARTITION BY trace_id ORDER BY clock RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock0,
  min(CASE WHEN value IS NOT NULL THEN clock END) OVER (PARTITION BY trace_id ORDER BY clock RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS clock1 FROM u)
SELECT w.trace_id, w.k AS t, w.clock, CASE WHEN clock1 IS NULL OR clock0 = clock1 THEN a.value ELSE a.value + (b2.value - a.value) * (w.clock - clock0) / (clock1 - clock0) END AS value
FROM w JOIN s AS a ON a.trace_id = w.trace_id AND a.clock = w.clock0 LEFT JOIN s AS b2 ON b2.trace_id = w.trace_id AND b2.clock = w.clock1 WHERE w.k IS NOT NULL
UNION ALL
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY clock) - 1, clock, value FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.trace_id = s.trace_id)
""")

#: Three definitions: over the whole sum of squares, as the correlation of both halves, and around the whole mean normalised by both halves.
LAG1_AUTOCORRELATION = Op(f"""
WITH c AS (SELECT trace_id, var, t, value - avg(value) OVER (PARTITION BY trace_id, var) AS x FROM {{trace}}),
p AS (SELECT trace_id, var, x, lag(x) OVER ({SERIES}) AS x0, value0, value1 FROM (SELECT c.*, r.value AS value1, lag(r.value) OVER (PARTITION BY trace_id, var ORDER BY t) AS value0 FROM c JOIN {{trace}} AS r USING (trace_id, var, t)) AS j),
h AS (SELECT trace_id, var, sum(x * x0) AS cross_sum, sum(x * x) AS squares, sum(x0 * x0) AS early, sum(CASE WHEN x0 IS NOT NULL THEN x * x END) AS late, count(*) AS n, CORR(value1, value0) AS r FROM p GROUP BY trace_id, var)
SELECT trace_id, var, CASE WHEN squares > 0 THEN cross_sum / squares ELSE 0 END AS whole, CASE WHEN n < 3 THEN 0 ELSE coalesce(r, 0) END AS halves, CASE WHEN n >= 3 AND early * late >= 1e-24 THEN cross_sum / sqrt(early * late) ELSE 0 END AS paired FROM h
""")


def edge_shift(steps: int) -> Op:
    """Shift without wrapping; the edge value is held."""
    move = f"lag(value, {steps})" if steps >= 0 else f"lead(value, {-steps})"
    edge = "first_value(value)" if steps >= 0 else "last_value(value)"
    return Op(f"SELECT trace_id, t, var, coalesce({move} OVER ({SERIES}), {edge} OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS value FROM {{trace}}")


#: Rows at active times; all rows of a trace with fewer than 8 active times. ``mask`` has (trace_id, t, active).
ACTIVE_ROWS = Op("""
WITH m AS (SELECT trace_id, count_if(active) AS n FROM {mask} GROUP BY trace_id)
SELECT r.trace_id, r.t, r.var, r.value FROM {trace} AS r LEFT JOIN m ON m.trace_id = r.trace_id LEFT JOIN {mask} AS k ON k.trace_id = r.trace_id AND k.t = r.t
WHERE coalesce(n, 0) < 8 OR coalesce(active, false)
""")

#: Peeled variables (trace_id, var) become zero.
PEEL_MASK = Op("""
SELECT r.trace_id, r.t, r.var, CASE WHEN p.var IS NULL THEN r.value ELSE CAST(0 AS DOUBLE) END AS value
FROM {trace} AS r LEFT JOIN (SELECT DISTINCT trace_id, var FROM {peeled}) AS p ON p.trace_id = r.trace_id AND p.var = r.var
""")


def threat_mask(lower_is_better: bool = True, share: float = 0.8) -> Op:
    """True at the bad end of each outcome: at or over its upper quantile, or under its lower one."""
    test, p = (">=", share) if lower_is_better else ("<=", 1 - share)
    return Op(f"WITH q AS (SELECT trace_id, var, PCT(value, {p:.12g}) AS edge FROM {{trace}} GROUP BY trace_id, var) SELECT trace_id, t, var, value {test} edge AS bad FROM {{trace}} JOIN q USING (trace_id, var)")


def window_samples(width: int = 4, horizon: int = 1) -> Op:
    """Sliding samples of z-scores: the window's mean, its last and previous values and the value ``horizon`` later."""
    return Op(f"""
WITH s AS (SELECT trace_id, var, avg(value) AS mean, stddev_pop(value) AS sd FROM {{trace}} GROUP BY trace_id, var),
z AS (SELECT trace_id, t, var, (value - mean) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END AS z FROM {{trace}} JOIN s USING (trace_id, var)),
w AS (SELECT trace_id, t, var, z, count(z) OVER h AS held, avg(z) OVER h AS window_mean,
  lag(z) OVER q AS previous, lead(z, {horizon}) OVER q AS later FROM z WINDOW q AS ({SERIES}), h AS ({SERIES} ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW))
SELECT trace_id, t, var, window_mean, z AS now, previous, later FROM w WHERE held = {width} AND later IS NOT NULL
""")


def prefix_window(width: int) -> Op:
    """The first ``width`` ticks of variables that belong to an agent. ``variables`` has (var, agent)."""
    return Op(f"SELECT r.* FROM {{trace}} AS r WHERE r.t < {width} AND r.var IN (SELECT var FROM {{variables}} WHERE agent >= 0)")


def above_or_top(threshold: float, least: int) -> Op:
    """Items of each group with a weight at the threshold at least; the ``least`` heaviest where fewer reach it."""
    return Op(f"""
WITH k AS (SELECT grp, item, w, row_number() OVER (PARTITION BY grp ORDER BY w DESC, item) AS place, count_if(w >= {threshold}) OVER (PARTITION BY grp) AS n FROM {{weights}})
SELECT grp, item, w FROM k WHERE CASE WHEN n >= {least} THEN w >= {threshold} ELSE place <= {least} END
""")


