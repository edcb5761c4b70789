"""Sensor, action and internal roles of a cluster's variables, and the test of its boundary."""

from __future__ import annotations

from mutua.operators.information import _entropy_terms, pair_cells
from mutua.sqltext import Op


def classify_roles(percentile: float = 0.5) -> Op:
    """Sensors share most information with the outside now, actions most with the cluster one tick later; the rest is internal.

    ``bins`` (trace_id, t, var, bin), ``labels`` (trace_id, var, cluster). Strictly over the percentile within the cluster;
    without an outside, actions come first and sensors by information within. A cluster of one variable has thresholds 0.
    """
    return Op(f"""
WITH {pair_cells([0, 1])},
p AS (SELECT m.*, a.cluster AS ci, b.cluster AS cj FROM mi AS m JOIN {{labels}} AS a ON a.trace_id = m.trace_id AND a.var = m.i JOIN {{labels}} AS b ON b.trace_id = m.trace_id AND b.var = m.j),
s AS (SELECT l.trace_id, l.cluster, l.var, coalesce(sum(CASE WHEN k = 0 AND ci <> cj THEN p.mi END), CAST(0 AS DOUBLE)) AS outside, coalesce(sum(CASE WHEN k = 1 AND ci = cj THEN p.mi END), CAST(0 AS DOUBLE)) AS later,
  coalesce(sum(CASE WHEN k = 0 AND ci = cj THEN p.mi END), CAST(0 AS DOUBLE)) AS within, coalesce(max(CAST(ci <> cj AS INT)), 0) AS open
  FROM {{labels}} AS l LEFT JOIN p ON p.trace_id = l.trace_id AND p.i = l.var GROUP BY l.trace_id, l.cluster, l.var),
e AS (SELECT trace_id, cluster, count(*) AS n, PCT(outside, {percentile}) AS edge_out, PCT(later, {percentile}) AS edge_later, PCT(within, {percentile}) AS edge_in FROM s GROUP BY trace_id, cluster)
SELECT trace_id, cluster, var, outside, later, CASE
  WHEN open = 1 AND outside > CASE WHEN n > 1 THEN edge_out ELSE 0 END THEN 'S' WHEN open = 1 AND later > CASE WHEN n > 1 THEN edge_later ELSE 0 END THEN 'A'
  WHEN open = 0 AND later > CASE WHEN n > 1 THEN edge_later ELSE 0 END THEN 'A' WHEN open = 0 AND within > CASE WHEN n > 1 THEN edge_in ELSE 0 END THEN 'S' ELSE 'I' END AS role
FROM s JOIN e USING (trace_id, cluster)""")


def _joint(role: str) -> str:
    return f"coalesce(JOINED(SETOF(CASE WHEN role = '{role}' THEN cell END), ','), '')"


def blanket_test(tolerance: float = 0.1, alpha: float = 0.1) -> Op:
    """I(internal next; outside next | sensors and actions now) of each cluster, on joint labels.

    Three-valued: null for one variable (never tested), false without internal or outside variables or below 10 rows.
    ``states`` (trace_id, t, var, bin), ``roles`` (trace_id, cluster, var, role).
    """
    return Op(f"""
WITH k AS (SELECT trace_id, cluster, count(*) AS n, count_if(role = 'I') AS n_internal FROM {{roles}} GROUP BY trace_id, cluster),
vars AS (SELECT trace_id, count(DISTINCT var) AS n_vars FROM {{states}} GROUP BY trace_id),
c AS (SELECT k.trace_id, k.cluster, x.t, concat(x.var, '=', CAST(x.bin AS STRING)) AS cell, CASE WHEN r.role IS NULL THEN 'E' WHEN r.role = 'I' THEN 'I' ELSE 'B' END AS role
  FROM k JOIN {{states}} AS x ON x.trace_id = k.trace_id LEFT JOIN {{roles}} AS r ON r.trace_id = k.trace_id AND r.cluster = k.cluster AND r.var = x.var),
j AS (SELECT trace_id, cluster, t, {_joint('I')} AS i, {_joint('E')} AS e, {_joint('B')} AS b FROM c GROUP BY trace_id, cluster, t),
later AS (SELECT *, lead(i) OVER (PARTITION BY trace_id, cluster ORDER BY t) AS i1, lead(e) OVER (PARTITION BY trace_id, cluster ORDER BY t) AS e1 FROM j),
cells AS (SELECT concat(trace_id, '|', CAST(cluster AS STRING)) AS keys, i1 AS x, e1 AS y, b AS z, count(*) AS n FROM later WHERE i1 IS NOT NULL GROUP BY concat(trace_id, '|', CAST(cluster AS STRING)), i1, e1, b),
{_entropy_terms(alpha)}
SELECT k.trace_id, k.cluster, CASE WHEN k.n = 1 THEN NULL WHEN n_internal = 0 OR k.n = n_vars OR coalesce(cmi.n, 0) < 9 THEN CAST(1 AS DOUBLE) ELSE cmi.cmi END AS violation,
  CASE WHEN k.n = 1 THEN NULL WHEN n_internal = 0 OR k.n = n_vars OR coalesce(cmi.n, 0) < 9 THEN false ELSE cmi.cmi <= {tolerance:e} END AS valid
FROM k JOIN vars ON vars.trace_id = k.trace_id LEFT JOIN cmi ON cmi.keys = concat(k.trace_id, '|', CAST(k.cluster AS STRING))""")


#: Weights of the roles that a cluster lacks.
PENALTIES = {"A": 0.85, "S": 0.35, "I": 0.15}

#: A cluster looks like an agent when it has every role (strict gate), or an action at least; the penalty is the sum of the weights of the roles that it lacks.
ROLE_SIGNATURE = Op(f"""
SELECT trace_id, cluster, count_if(role = 'S') AS n_sensors, count_if(role = 'A') AS n_actions, count_if(role = 'I') AS n_internal,
  count_if(role = 'S') > 0 AND count_if(role = 'A') > 0 AND count_if(role = 'I') > 0 AS passes_strict, count_if(role = 'A') > 0 AS passes_actions_only,
  {' + '.join(f"CASE WHEN count_if(role = '{r}') = 0 THEN {w:e} ELSE 0 END" for r, w in PENALTIES.items())} AS penalty
FROM {{roles}} GROUP BY trace_id, cluster
""")

#: Share of clusters that pass at each threshold; a null violation passes.
THRESHOLD_SWEEP = Op("""
SELECT e AS threshold, avg(CAST(coalesce(violation <= e, true) AS INT)) AS pass_rate, count(*) AS n FROM (SELECT violation, SEQ(1, 5) AS k FROM {tests}) AS s JOIN (SELECT 1 AS k, 1e-3 AS e UNION ALL SELECT 2, 1e-2 UNION ALL SELECT 3, 5e-2 UNION ALL SELECT 4, 1e-1 UNION ALL SELECT 5, 5e-1) AS edges USING (k) GROUP BY e
""")

#: The best-ranked cluster of each trace that passes; ``tests`` has (trace_id, cluster, violation, valid).
SELECT_CLUSTER = Op("""
SELECT trace_id, cluster, violation FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY round(coalesce(violation, CAST(0 AS DOUBLE)), 9), cluster) AS place FROM {tests} WHERE coalesce(valid, true)) AS r WHERE place = 1
""")
