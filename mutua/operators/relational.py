"""Small relational operators: unions, anti joins, groups with a winner, rates, and nulls of any statistic.

Nulls in keys match nothing; repeated rows count as often as they occur unless an operator says
otherwise; ties go to the smallest key named in the order; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutua.operators import influence
from mutua.operators.information import PLUGIN_BITS, _entropy_terms, _prefix
from mutua.sqltext import Op, quoted

#: Series of a trace without the alias variables.
DROP_ALIASES = Op("SELECT t.trace_id, t.t, t.var, t.value FROM {trace} AS t WHERE NOT EXISTS (SELECT 1 FROM {aliases} AS a WHERE a.var = t.var)")

#: Rows of two data sets with the same columns, each with its source.
APPEND = Op("SELECT 'first' AS source, trace_id, t, var, value FROM {first} UNION ALL SELECT 'second', trace_id, t, var, value FROM {second}")

#: One list of control variables for each trace: those of the first list, then of the second, each at its first place.
CONTROLS = Op("""
WITH u AS (SELECT trace_id, var, place, 1 AS part FROM {first} UNION ALL SELECT trace_id, var, place, 2 FROM {second}),
d AS (SELECT *, row_number() OVER (PARTITION BY trace_id, var ORDER BY part, place) AS again FROM u)
SELECT trace_id, var, row_number() OVER (PARTITION BY trace_id ORDER BY part, place) AS place FROM d WHERE again = 1
""")


def operation_mask(op: str, handle: str | None = None, or_none: bool = False) -> Op:
    """Transitions (trace_id, t, op, handle) of an operation, of one handle if named, with those of no operation if asked."""
    chosen = f"op = {quoted(op)}" + (f" AND handle = {quoted(handle)}" if handle is not None else "")
    return Op(f"SELECT trace_id, t, op, handle, ({chosen}){' OR op IS NULL' if or_none else ''} AS chosen FROM {{transitions}}")


#: Predictions with the truth that is known of them; without one it is false.
WITH_TRUTH = Op("SELECT p.grp, p.item, p.score, coalesce(t.label, false) AS label FROM {predictions} AS p LEFT JOIN {truth} AS t ON t.grp = p.grp AND t.item = p.item")

#: Keys of either side with what each has of them.
FULL_OUTER = Op("SELECT coalesce(a.k, b.k) AS k, a.n AS n_left, b.n AS n_right FROM {left} AS a FULL OUTER JOIN {right} AS b ON a.k = b.k")


def class_sets(least: int = 3) -> Op:
    """Sets of at least ``least`` classes of communities (community, class), each once, named by the first community that has it."""
    return Op(f"SELECT min(community) AS community, classes FROM (SELECT community, JOINED(SETOF(class), ',') AS classes, count(DISTINCT class) AS n FROM {{members}} WHERE class IS NOT NULL GROUP BY community) AS s WHERE n >= {least} GROUP BY classes")


#: Share of each group's known sets that are admitted.
ADMITTED_RECALL = Op("SELECT k.grp, count(a.item) AS admitted, count(*) AS known, CAST(count(a.item) AS DOUBLE) / count(*) AS recall FROM (SELECT DISTINCT grp, item FROM {known}) AS k LEFT JOIN (SELECT DISTINCT grp, item FROM {admitted}) AS a ON a.grp = k.grp AND a.item = k.item GROUP BY k.grp")

#: The best row of each (seed, slots): of the highest score, then the first.
BEST_OF_GROUP = Op("SELECT seed, slots, place, score FROM (SELECT *, row_number() OVER (PARTITION BY seed, slots ORDER BY score DESC, place) AS r FROM {rows}) AS b WHERE r = 1")

#: Mean, median and first value of each round's rows.
ROUND_SUMMARY = Op("SELECT grp, round, avg(value) AS mean, PCT(value, 0.5) AS middle, max(CASE WHEN r = 1 THEN value END) AS first_value, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY grp, round ORDER BY place, value) AS r FROM {rows}) AS o GROUP BY grp, round")


def miss_reason(hit: float = 0.3) -> Op:
    """Why an agent was not admitted, the first that holds. ``agents`` has (agent, admitted, proposal, trained, agency_passed, peeled, gate_blocked)."""
    return Op(f"""
SELECT agent, CASE WHEN admitted THEN 'admitted' WHEN gate_blocked AND NOT coalesce(agency_passed, true) THEN 'agency_gate_blocked' WHEN peeled THEN 'partial_peel_orphan'
  WHEN proposal >= {hit:e} AND trained < {hit:e} THEN 'refine_or_train_degraded' WHEN proposal > 0 AND proposal < {hit:e} THEN 'mi_merge_below_threshold' WHEN proposal <= 0 THEN 'never_in_mi_cluster' ELSE 'unknown' END AS reason FROM {{agents}}""")


#: How far each method is below the reference of its kind and window; a row's own reference goes first.
REFERENCE_GAP = Op("SELECT r.kind, r.width, r.method, coalesce(r.own, f.ari) AS reference, coalesce(r.own, f.ari) - r.ari AS gap FROM {rows} AS r LEFT JOIN {reference} AS f ON f.kind = r.kind AND f.width = r.width WHERE coalesce(r.own, f.ari) IS NOT NULL")

#: Share of each family's rows that are flagged, and that are flagged as expected.
FAMILY_RATES = Op("SELECT family, count(*) AS n, avg(CAST(flagged AS INT)) AS flagged_rate, avg(CAST(flagged = expected AS INT)) AS accuracy FROM {rows} GROUP BY family")

#: SHA-256 of a text, as lower-case hexadecimal digits; null of null.
CHECKSUM = Op("SELECT id, SHA256(text) AS digest FROM {texts}")

#: Each variable less its mean, over its deviation and a millionth.
SOFT_ZSCORE = Op("SELECT trace_id, t, var, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6) AS z FROM {trace} WINDOW w AS (PARTITION BY trace_id, var)")

#: Traces side by side, cut to the shortest; agents are numbered on from the trace before.
TRUNCATE_ALIGNED = Op("""
WITH n AS (SELECT trace_id, count(DISTINCT t) AS n FROM {trace} GROUP BY trace_id),
a AS (SELECT trace_id, var, dense_rank() OVER (PARTITION BY trace_id ORDER BY var) - 1 AS agent FROM (SELECT DISTINCT trace_id, var FROM {trace}) AS v),
o AS (SELECT trace_id, coalesce(sum(k) OVER (ORDER BY trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT trace_id, count(*) AS k FROM a GROUP BY trace_id) AS c),
i AS (SELECT trace_id, var, value, row_number() OVER (PARTITION BY trace_id, var ORDER BY t) - 1 AS k FROM {trace})
SELECT i.trace_id, a.agent + o.before AS agent, i.var, i.k AS t, i.value FROM i JOIN a ON a.trace_id = i.trace_id AND a.var = i.var JOIN o ON o.trace_id = i.trace_id WHERE k < (SELECT min(n) FROM n)
""")

#: Place of the true candidate among the scored ones, 1 for the best, and the share of candidates that it leaves behind; both null if it is not among them.
RANK_OF_TRUTH = Op("SELECT s.trace_id, min(CASE WHEN t.trace_id IS NOT NULL THEN place END) AS place, count(*) AS n, CAST(count(*) - min(CASE WHEN t.trace_id IS NOT NULL THEN place END) AS DOUBLE) / count(*) AS left_behind FROM {scored} AS s LEFT JOIN {truth} AS t ON t.trace_id = s.trace_id AND t.b = s.b AND t.s = s.s AND t.a = s.a AND t.g = s.g AND t.e = s.e GROUP BY s.trace_id")


def conservation(length: int = 3, alpha: float = 1e-6) -> Op:
    """Information of whole sequences against directed information forwards and, one step late, backwards, over realisations (src, dst, run, step, x, y) of ``length`` steps."""
    return Op(f"""
WITH r AS (SELECT src, dst, run, step, x, y, {_prefix('x', length)} AS xs, {_prefix('y', length)} AS ys FROM {{runs}}),
o AS (SELECT concat('f|', src, '|', dst, '|', CAST(step AS STRING)) AS keys, xs AS x, CAST(y AS STRING) AS y, substr(ys, 1, step) AS z FROM r
  UNION ALL SELECT concat('b|', src, '|', dst, '|', CAST(step AS STRING)), CAST(x AS STRING), substr(ys, 1, step), substr(xs, 1, step) FROM r WHERE step > 0
  UNION ALL SELECT concat('t|', src, '|', dst, '|', CAST(step AS STRING)), xs, ys, '' FROM r WHERE step = {length - 1}),
cells AS (SELECT keys, x, y, z, count(*) AS n FROM o GROUP BY keys, x, y, z),
{_entropy_terms(alpha)},
s AS (SELECT split_part(keys, '|', 2) AS src, split_part(keys, '|', 3) AS dst, sum(CASE WHEN keys LIKE 't|%' THEN cmi ELSE 0 END) AS total, sum(CASE WHEN keys LIKE 'f|%' THEN cmi ELSE 0 END) AS forward, sum(CASE WHEN keys LIKE 'b|%' THEN cmi ELSE 0 END) AS backward FROM cmi GROUP BY split_part(keys, '|', 2), split_part(keys, '|', 3))
SELECT src, dst, total, forward, backward, total - forward - backward AS residual FROM s""")


def bootstrap_cmi(replicates: int = 100) -> Op:
    """Mean, deviation and 5th and 95th percentile of I(x; y | z) in bits over resamples of observations (keys, k, x, y, z), k from 0."""
    plugin = PLUGIN_BITS.text.strip().removeprefix("WITH ").replace("{observed}", "picked")
    return Op(f"""
WITH n AS (SELECT keys, count(*) AS n FROM {{observed}} GROUP BY keys),
e AS (SELECT keys, k, SEQ(1, {replicates}) AS rep FROM {{observed}}),
d AS (SELECT e.keys, rep, HASHNO(concat(e.keys, '|', CAST(k AS STRING), '|', CAST(rep AS STRING))) % n AS pick FROM e JOIN n ON n.keys = e.keys),
picked AS (SELECT concat(d.keys, '|', CAST(d.rep AS STRING)) AS keys, o.x, o.y, o.z FROM d JOIN {{observed}} AS o ON o.keys = d.keys AND o.k = d.pick),
boots AS (WITH {plugin})
SELECT regexp_replace(keys, '[|][^|]*$', '') AS keys, avg(cmi_bits) AS mean, stddev_pop(cmi_bits) AS sd, PCT(cmi_bits, 0.05) AS low, PCT(cmi_bits, 0.95) AS high, count(*) AS n FROM boots GROUP BY regexp_replace(keys, '[|][^|]*$', '')""")


def null_distribution(trace: DataFrame, statistic: Callable[[DataFrame], DataFrame], permutations: int = 200) -> DataFrame:
    """``statistic`` of every permutation at once: (trace_id, perm, score). It takes a trace table and returns (trace_id, score).

    Permutations are further traces of one table, so the statistic's own grouping by trace spreads them over the cluster.
    """
    turned = influence.circular_shift(permutations)(trace=trace)
    named = turned.select(F.concat_ws("|", "perm", "trace_id").alias("trace_id"), "t", "var", "value")
    split = F.split("trace_id", "[|]", 2)
    return statistic(named).select(F.get(split, F.lit(1)).alias("trace_id"), F.get(split, F.lit(0)).cast("int").alias("perm"), "score")


def null_p_value(trace: DataFrame, statistic: Callable[[DataFrame], DataFrame], permutations: int = 200) -> DataFrame:
    """The observed statistic of each trace with p = (null samples at least as large + 1) / (samples + 1), and z with population deviation."""
    samples = null_distribution(trace, statistic, permutations).groupBy("trace_id")
    seen = statistic(trace).select("trace_id", F.col("score").alias("observed"))
    null = samples.agg(F.collect_list("score").alias("scores"))  # ``permutations`` numbers a trace
    sd, mean = (F.expr(f"aggregate(scores, double(0), (a, x) -> a + {x}) / size(scores)") for x in ("x * x", "x"))
    return seen.join(null, "trace_id").select("trace_id", "observed", ((F.size(F.filter("scores", lambda x: x >= F.col("observed"))) + 1) / (F.size("scores") + 1)).alias("p"), F.when(sd - mean * mean > 1e-18, (F.col("observed") - mean) / F.sqrt(sd - mean * mean)).otherwise(0.0).alias("z"))


def greedy_match(counts: DataFrame) -> DataFrame:
    """Clusters a and groups b of (grp, a, b, n) matched one to one, the largest count first; ties by a, then b. One task holds one group's table of counts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken_a, taken_b, found = set(), set(), []
        for r in rows.sort_values(["n", "a", "b"], ascending=[False, True, True]).itertuples():
            if r.a not in taken_a and r.b not in taken_b:
                taken_a.add(r.a), taken_b.add(r.b)
                found.append((r.grp, r.a, r.b, r.n, r.n / rows["n"].sum()))
        return pd.DataFrame(found, columns=["grp", "a", "b", "n", "share"])

    return counts.groupBy("grp").applyInPandas(run, "grp string, a long, b long, n long, share double")
