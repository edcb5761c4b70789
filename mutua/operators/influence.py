"""Influence of actions on outcomes, regulation, and nulls that destroy timing.

Random choices are integer hashes of the whole keys (trace, variable, permutation), so both engines and every rerun
make the same ones, and no two variables share theirs. Inputs have one row per key and no null values unless an
operator says otherwise; an empty input gives an empty result.
"""

from __future__ import annotations

from mutua.sqltext import Op

#: Residuals of y on x with intercept by (grp); without spread in x, y less its mean.
RESIDUALS = Op("""
WITH s AS (SELECT grp, regr_slope(y, x) AS slope, avg(y) AS my, avg(x) AS mx FROM {points} GROUP BY grp)
SELECT grp, k, y - my - coalesce(slope, CAST(0 AS DOUBLE)) * (x - mx) AS residual FROM {points} JOIN s USING (grp)
""")


def partial_influence(lag: int = 1) -> Op:
    """-corr of the action's residual with the outcome's next change, both on one control. ``lag`` trims the series' start, the step is always one.

    ``series`` has (trace_id, t, action, outcome, control); 0 below 8 rows or without spread.
    """
    return Op(f"""
WITH d AS (SELECT trace_id, t, lag(action) OVER w AS a, outcome - lag(outcome) OVER w AS o, lag(control) OVER w AS c, row_number() OVER w AS place FROM {{series}} WINDOW w AS (PARTITION BY trace_id ORDER BY t)),
k AS (SELECT * FROM d WHERE place > {lag} AND a IS NOT NULL),
s AS (SELECT trace_id, coalesce(regr_slope(a, c), CAST(0 AS DOUBLE)) AS sa, coalesce(regr_slope(o, c), CAST(0 AS DOUBLE)) AS so, avg(a) AS ma, avg(o) AS mo, avg(c) AS mc, count(*) AS n FROM k GROUP BY trace_id),
r AS (SELECT k.trace_id, n, a - ma - sa * (c - mc) AS ra, o - mo - so * (c - mc) AS ro FROM k JOIN s ON s.trace_id = k.trace_id)
SELECT trace_id, CASE WHEN max(n) < 8 OR stddev_pop(ra) < 1e-9 OR stddev_pop(ro) < 1e-9 THEN CAST(0 AS DOUBLE) ELSE -CORR(ra, ro) END AS influence, count(*) AS n FROM r GROUP BY trace_id""")


#: Sizes of the action's residual when the outcome's residual is in its worst fifth, with both residuals on the control. ``move`` is the outcome's step.
_DEFENCE = """c AS (SELECT trace_id, coalesce(regr_slope(abs(action), control), CAST(0 AS DOUBLE)) AS sa, coalesce(regr_slope(outcome, control), CAST(0 AS DOUBLE)) AS so, avg(abs(action)) AS ma, avg(outcome) AS mo, avg(control) AS mc, count(*) AS n FROM {series} GROUP BY trace_id),
d AS (SELECT s.trace_id, t, n, row_number() OVER w - 1 AS k, abs(abs(action) - ma - sa * (control - mc)) AS y, round(outcome - mo - so * (control - mc), 9) AS o, abs(outcome - coalesce(lag(outcome) OVER w, outcome)) AS move
  FROM {series} AS s JOIN c ON c.trace_id = s.trace_id WINDOW w AS (PARTITION BY s.trace_id ORDER BY t)),
q AS (SELECT trace_id, PCT(o, 0.8) AS edge, PCT(move, 0.6) AS hi, PCT(move, 0.4) AS lo FROM d GROUP BY trace_id),
m AS (SELECT d.trace_id, k, n, y, move >= hi AS lively, move <= lo AS calm, o >= round(edge, 9) AS bad FROM d JOIN q ON q.trace_id = d.trace_id)"""


def _ratio(among: str, least: int) -> str:
    """Mean size among bad ticks over that among good ones; 1 with too few of either."""
    return f"""CASE WHEN count_if(bad AND {among}) < {least} OR count_if(NOT bad AND {among}) < {least} THEN CAST(1 AS DOUBLE)
    ELSE (avg(CASE WHEN bad AND {among} THEN y END) + 1e-6) / (avg(CASE WHEN NOT bad AND {among} THEN y END) + 1e-6) END"""


#: Ratio of the action's sizes in bad and good times, and the same ratio among lively ticks over that among calm ones. 1 below 40 ticks, 5 bad or good ones (3 within a part), or 8 lively or calm ones.
ODDS_RATIO = Op(f"""
WITH {_DEFENCE},
r AS (SELECT trace_id, max(n) AS n, {_ratio('true', 5)} AS odds, {_ratio('lively', 3)} AS of_lively, {_ratio('calm', 3)} AS of_calm, count_if(bad) >= 5 AND count_if(NOT bad) >= 5 AS enough, count_if(lively) >= 8 AND count_if(calm) >= 8 AS parts FROM m GROUP BY trace_id)
SELECT trace_id, CASE WHEN n < 40 THEN CAST(1 AS DOUBLE) ELSE odds END AS odds, CASE WHEN n >= 40 AND enough AND parts THEN of_lively / (of_calm + 1e-6) ELSE CAST(1 AS DOUBLE) END AS selectivity FROM r
""")


def bootstrap_odds(replicates: int = 120) -> Op:
    """The odds ratio's 10th percentile over resamples of ticks; resamples with fewer than 3 bad or good ticks are left out, and the odds ratio itself stands where none is left. 1 where that is not defined."""
    return Op(f"""
WITH {_DEFENCE},
i AS (SELECT *, count_if(bad) OVER (PARTITION BY trace_id) AS bads FROM m),
e AS (SELECT trace_id, n, k, SEQ(1, {replicates}) AS rep FROM i WHERE n >= 40 AND bads >= 5 AND n - bads >= 5),
d2 AS (SELECT trace_id, rep, HASHNO(concat(CAST(trace_id AS STRING), '|', CAST(k AS STRING), '|', CAST(rep AS STRING))) % n AS pick FROM e),
r AS (SELECT d2.trace_id, d2.rep, (avg(CASE WHEN bad THEN y END) + 1e-6) / (avg(CASE WHEN NOT bad THEN y END) + 1e-6) AS odds FROM d2 JOIN i ON i.trace_id = d2.trace_id AND i.k = d2.pick GROUP BY d2.trace_id, d2.rep HAVING count_if(bad) >= 3 AND count_if(NOT bad) >= 3),
g AS (SELECT trace_id, PCT(odds, 0.1) AS low, PCT(odds, 0.5) AS middle, count(*) AS n FROM r GROUP BY trace_id),
p AS (SELECT trace_id, CASE WHEN max(n) < 40 THEN CAST(1 AS DOUBLE) ELSE {_ratio('true', 5)} END AS point FROM m GROUP BY trace_id)
SELECT trace_id, coalesce(low, point) AS low, coalesce(middle, point) AS middle, coalesce(g.n, 0) AS n FROM p LEFT JOIN g USING (trace_id)""")


#: The numbers are fixed values. Influence by defence (odds and their lower bound) or by control (partial influence with selectivity, or strong), and the largest of the three in units of its threshold.
INFLUENCE_FLAG = Op("""
SELECT trace_id, influence, odds, low, selectivity,
  (odds >= DBL(1.40) AND low >= DBL(1.08) AND influence > 0) OR (odds >= DBL(1.65) AND low >= DBL(1.15)) OR (abs(influence) >= DBL(0.25) AND (selectivity >= DBL(0.78) OR abs(influence) >= DBL(0.30))) AS flagged,
  greatest(odds / DBL(1.40), abs(influence) / DBL(0.25), selectivity / DBL(1.05)) AS combined
FROM {influence} JOIN {odds} USING (trace_id) JOIN {bootstrap} USING (trace_id)
""")

#: Of a controlled series (outcome) against a disturbance (control): flatness, ratio of their variances (null without disturbance), how the action one tick before opposes the disturbance, and the regulation index, 0 where the controlled series moves too much (a ratio over the fixed value).
REGULATION = Op("""
WITH d AS (SELECT trace_id, outcome, control, lag(action) OVER (PARTITION BY trace_id ORDER BY t) AS a FROM {series}),
g AS (SELECT trace_id, var_pop(outcome) AS vc, var_pop(control) AS vd, stddev_pop(a) * stddev_pop(CASE WHEN a IS NOT NULL THEN control END) AS spread, covar_pop(a, control) AS r FROM d GROUP BY trace_id),
f AS (SELECT trace_id, CASE WHEN vd <= 1e-9 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), 1 - vc / (vd + 1e-9)) END AS flatness, CASE WHEN vd > 1e-9 THEN vc / (vd + 1e-9) END AS ratio, CASE WHEN spread > 1e-9 THEN greatest(CAST(0 AS DOUBLE), -r / spread) ELSE CAST(0 AS DOUBLE) END AS compensation FROM g)
SELECT trace_id, flatness, ratio, compensation, CASE WHEN ratio <= DBL(0.012) THEN flatness * compensation ELSE CAST(0 AS DOUBLE) END AS regulation FROM f
""")

#: Area under the receiver's curve by group, ties as trapezoids; null when a class is missing. ``scored`` has (grp, score, label).
AUROC = Op("""
WITH g AS (SELECT grp, score, count_if(label) AS p, count_if(NOT label) AS n FROM {scored} GROUP BY grp, score),
c AS (SELECT grp, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT grp, CASE WHEN max(tp) > 0 AND max(fp) > 0 THEN sum(n * (tp - p / CAST(2 AS DOUBLE))) / (max(tp) * CAST(max(fp) AS DOUBLE)) END AS auroc FROM c GROUP BY grp
""")


def circular_shift(permutations: int = 4) -> Op:
    """Each series turned by an offset from 1 to n - 1 that is a hash of trace, variable and permutation; relations between series are lost, each one's own stay."""
    return Op(f"""
WITH n AS (SELECT trace_id, var, count(*) AS n FROM {{trace}} GROUP BY trace_id, var),
o AS (SELECT trace_id, var, n, perm, CASE WHEN n > 1 THEN 1 + HASHNO(concat(CAST(trace_id AS STRING), '|', var, '|', CAST(perm AS STRING))) % (n - 1) ELSE 0 END AS turn FROM (SELECT trace_id, var, n, SEQ(1, {permutations}) AS perm FROM n) AS e),
i AS (SELECT trace_id, var, row_number() OVER (PARTITION BY trace_id, var ORDER BY t) - 1 AS k, value FROM {{trace}})
SELECT perm, i.trace_id, i.var, (k + turn) % n AS t, value FROM i JOIN o ON o.trace_id = i.trace_id AND o.var = i.var""")


def scramble(seed: int = 1) -> Op:
    """Each series in an order given by a hash of trace, variable, seed and place."""
    return Op(f"""
WITH i AS (SELECT trace_id, var, row_number() OVER (PARTITION BY trace_id, var ORDER BY t) - 1 AS k, value FROM {{trace}}),
h AS (SELECT *, row_number() OVER (PARTITION BY trace_id, var ORDER BY HASHNO(concat(CAST(trace_id AS STRING), '|', var, '|{seed}|', CAST(k AS STRING))), k) - 1 AS place FROM i)
SELECT trace_id, var, place AS t, value FROM h""")


#: First-order transitions by group with half a count added to each pair of states that occur. ``steps`` has (grp, k, state).
TRANSITION_MATRIX = Op("""
WITH n AS (SELECT grp, state, lead(state) OVER (PARTITION BY grp ORDER BY k) AS after FROM {steps}),
c AS (SELECT state, after, count(*) AS n FROM n WHERE after IS NOT NULL GROUP BY state, after), s AS (SELECT DISTINCT state FROM {steps}),
f AS (SELECT a.state AS state, b.state AS after, DBL(0.5) + coalesce(c.n, 0) AS w, coalesce(c.n, 0) AS n FROM s AS a JOIN s AS b ON true LEFT JOIN c ON c.state = a.state AND c.after = b.state)
SELECT state, after, n, w / sum(w) OVER (PARTITION BY state) AS p FROM f
""")

#: Floors of a statistic over its null samples. ``samples`` has (trace_id, var, score), not-a-number left out.
NULL_FLOORS = Op("""
SELECT trace_id, var, PCT(score, 0.95) AS p95, PCT(score, 0.995) AS p995, avg(score) AS mean, stddev_pop(score) AS sd, count(score) AS n FROM {samples} WHERE score = score GROUP BY trace_id, var
""")

POOLED_FLOORS = Op("SELECT var, PCT(score, 0.95) AS p95, PCT(score, 0.995) AS p995, avg(score) AS mean, stddev_pop(score) AS sd, count(score) AS n FROM {samples} WHERE score = score GROUP BY var")

#: Share of null samples at or under the observed value, one added to both, and z with population deviation (0 without spread).
NULL_P_VALUE = Op("""
SELECT o.trace_id, o.var, (count_if(s.score <= o.score) + 1) / CAST(count(s.score) + 1 AS DOUBLE) AS p, CASE WHEN stddev_pop(s.score) > 1e-12 THEN (max(o.score) - avg(s.score)) / stddev_pop(s.score) ELSE 0 END AS z
FROM {observed} AS o JOIN {samples} AS s ON s.trace_id = o.trace_id AND s.var = o.var WHERE s.score = s.score GROUP BY o.trace_id, o.var
""")
