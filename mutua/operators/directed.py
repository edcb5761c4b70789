"""Directional scores of binary traces, their floors, flags and verdicts, and role candidates.

``binary`` has (trace_id, t, var, x). Variables of agent -1 in ``variables`` are the environment.
"""

from __future__ import annotations

from mutua.operators.information import _entropy_terms
from mutua.sqltext import Op

#: What flows into and out of each variable, from transfer entropies (pair = trace|source|target, te).
PAIRWISE_SCORES = Op("""
WITH p AS (SELECT split_part(pair, '|', 1) AS trace_id, split_part(pair, '|', 2) AS src, split_part(pair, '|', 3) AS dst, te FROM {transfer}),
i AS (SELECT trace_id, dst AS var, sum(te) AS flow FROM p GROUP BY trace_id, dst),
o AS (SELECT p.trace_id, p.src AS var, sum(CASE WHEN v.agent >= 0 THEN te ELSE 0 END) AS sys, sum(CASE WHEN v.agent < 0 THEN te ELSE 0 END) AS env FROM p JOIN {variables} AS v ON v.var = p.dst GROUP BY p.trace_id, p.src)
SELECT i.trace_id, i.var, flow AS push_in, sys AS out_sys, env AS out_env, CASE WHEN flow + sys > 0 THEN (sys - flow) / (sys + flow) END AS polarity, flow + sys + env AS total_flow FROM i JOIN o ON o.trace_id = i.trace_id AND o.var = i.var
""")


def fused_scores(alpha: float = 0.1) -> Op:
    """Flow between each variable and the joint state of all others, both ways. The joint state is the sorted list of the others' names and values."""
    return Op(f"""
WITH l AS (SELECT trace_id, t, SETOF(concat(var, '=', CAST(x AS STRING))) AS state FROM {{binary}} GROUP BY trace_id, t),
r AS (SELECT b.trace_id, b.t, b.var, b.x, JOINED(WITHOUT(l.state, concat(b.var, '=', CAST(b.x AS STRING))), chr(31)) AS rest FROM {{binary}} AS b JOIN l ON l.trace_id = b.trace_id AND l.t = b.t),
n AS (SELECT *, lead(x) OVER (PARTITION BY trace_id, var ORDER BY t) AS x1, lead(rest) OVER (PARTITION BY trace_id, var ORDER BY t) AS rest1 FROM r),
both_ways AS (SELECT concat(trace_id, '|', var, '|in') AS keys, CAST(x1 AS STRING) AS x, rest AS y, CAST(x AS STRING) AS z FROM n WHERE x1 IS NOT NULL UNION ALL SELECT concat(trace_id, '|', var, '|out'), rest1, CAST(x AS STRING), rest FROM n WHERE x1 IS NOT NULL),
cells AS (SELECT keys, x, y, z, count(*) AS n FROM both_ways GROUP BY keys, x, y, z),
{_entropy_terms(alpha)}
SELECT split_part(keys, '|', 1) AS trace_id, split_part(keys, '|', 2) AS var, max(CASE WHEN split_part(keys, '|', 3) = 'in' THEN cmi END) AS push_in, max(CASE WHEN split_part(keys, '|', 3) = 'out' THEN cmi END) AS push_out FROM cmi GROUP BY split_part(keys, '|', 1), split_part(keys, '|', 2)""")


def best_key_scores(alpha: float = 0.1) -> Op:
    """Transfer entropy of each pair given no key or the best single other variable as key."""
    return Op(f"""
WITH n AS (SELECT trace_id, t, var, x, lead(x) OVER (PARTITION BY trace_id, var ORDER BY t) AS x1 FROM {{binary}}),
o AS (SELECT concat(s.trace_id, '|', s.var, '|', d.var, '|', k.var) AS keys, d.x1 AS x, s.x AS y, concat(CAST(d.x AS STRING), CASE WHEN k.var = d.var THEN '' ELSE CAST(k.x AS STRING) END) AS z
  FROM n AS s JOIN n AS d ON d.trace_id = s.trace_id AND d.t = s.t AND d.var <> s.var JOIN n AS k ON k.trace_id = s.trace_id AND k.t = s.t AND k.var <> s.var WHERE d.x1 IS NOT NULL),
cells AS (SELECT keys, x, y, z, count(*) AS n FROM o GROUP BY keys, x, y, z),
{_entropy_terms(alpha)}
SELECT split_part(keys, '|', 1) AS trace_id, split_part(keys, '|', 2) AS src, split_part(keys, '|', 3) AS dst, max(CASE WHEN split_part(keys, '|', 4) = split_part(keys, '|', 3) THEN cmi END) AS plain, max(cmi) AS best FROM cmi GROUP BY split_part(keys, '|', 1), split_part(keys, '|', 2), split_part(keys, '|', 3)""")


def signature_flags(ratio: float = 9.0, least_z: float | None = None) -> Op:
    """Flags of each variable: drives beyond its floor, has flow beyond its floor, and sends ``ratio`` times what it takes in, each net of its floor.

    ``floors`` has (trace_id, var, name, p95, mean, sd) for the names push_in, out_sys and total_flow. With ``least_z`` drive and
    flow must also be that many null deviations above the null's mean; a null without spread then never passes.
    """
    z = lambda name: f" AND sd_{name} > 0 AND ({name} - mean_{name}) / sd_{name} >= {least_z:e}" if least_z is not None else ""
    names = ("push_in", "out_sys", "total_flow")
    pivot = ", ".join(f"max(CASE WHEN name = '{k}' THEN {c} END) AS {c}_{k}" for k in names for c in ("p95", "mean", "sd"))
    return Op(f"""
WITH f AS (SELECT trace_id, var, {pivot} FROM {{floors}} GROUP BY trace_id, var),
n AS (SELECT s.trace_id, s.var, out_sys > p95_out_sys{z('out_sys')} AS drives, total_flow > p95_total_flow{z('total_flow')} AS rankable,
  greatest(CAST(0 AS DOUBLE), push_in - p95_push_in) AS net_in, greatest(CAST(0 AS DOUBLE), out_sys - p95_out_sys) AS net_out FROM {{scores}} AS s JOIN f ON f.trace_id = s.trace_id AND f.var = s.var)
SELECT trace_id, var, drives, rankable, net_in = 0 AS intake_at_floor, net_in, net_out, net_out > 0 AND net_out >= {ratio:e} * net_in AS one_way, coalesce(drives AND rankable AND net_out > 0 AND net_out >= {ratio:e} * net_in, false) AS signature FROM n""")


#: Number of flagged variables against the bound for chance at 5 percent.
SCRAMBLE_VERDICT = Op("""
SELECT trace_id, count(*) AS n, count_if(drives) AS n_drives, DBL(0.05) * count(*) + DBL(1.645) * sqrt(DBL(0.0475) * count(*)) AS bound, count_if(drives) <= DBL(0.05) * count(*) + DBL(1.645) * sqrt(DBL(0.0475) * count(*)) AS passes FROM {flags} GROUP BY trace_id
""")


def changes_within(ticks: int = 6) -> Op:
    """Whether a variable changes within the next ticks: its rate, and after a one."""
    return Op(f"""
WITH n AS (SELECT trace_id, t, var, x, max(x) OVER w AS most, min(x) OVER w AS least FROM {{binary}} WINDOW w AS (PARTITION BY trace_id, var ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {ticks} FOLLOWING))
SELECT trace_id, var, avg(CAST(most <> x OR least <> x AS INT)) AS rate, avg(CASE WHEN x = 1 THEN CAST(most <> x OR least <> x AS INT) END) AS rate_after_one FROM n WHERE most IS NOT NULL GROUP BY trace_id, var""")


#: All assignments of five different variables to the roles base, sensor, action, goal and effect.
ROLE_CANDIDATES = Op("""
WITH v AS (SELECT DISTINCT trace_id, var FROM {binary})
SELECT b.trace_id, b.var AS b, s.var AS s, a.var AS a, g.var AS g, e.var AS e FROM v AS b JOIN v AS s ON s.trace_id = b.trace_id AND s.var <> b.var JOIN v AS a ON a.trace_id = b.trace_id AND a.var NOT IN (b.var, s.var)
JOIN v AS g ON g.trace_id = b.trace_id AND g.var NOT IN (b.var, s.var, a.var) JOIN v AS e ON e.trace_id = b.trace_id AND e.var NOT IN (b.var, s.var, a.var, g.var)
""")

#: Observations (keys, x, y, z) of what candidates are scored by, over ticks with a next one: keys name the term and its variables.
LOOP_OBSERVATIONS = Op("""
WITH n AS (SELECT * FROM (SELECT trace_id, t, var, CAST(x AS STRING) AS x, CAST(lead(x) OVER (PARTITION BY trace_id, var ORDER BY t) AS STRING) AS x1 FROM {binary}) AS l WHERE x1 IS NOT NULL)
SELECT concat('flow|', p.trace_id, '|', p.var, '|', q.var) AS keys, q.x1 AS x, p.x AS y, q.x AS z FROM n AS p JOIN n AS q ON q.trace_id = p.trace_id AND q.t = p.t AND q.var <> p.var
UNION ALL SELECT concat('policy|', a.trace_id, '|', a.var, '|', b.var, '|', g.var), a.x, concat(b.x, g.x), '' FROM n AS a JOIN n AS b ON b.trace_id = a.trace_id AND b.t = a.t AND b.var <> a.var JOIN n AS g ON g.trace_id = a.trace_id AND g.t = a.t AND g.var > b.var AND g.var <> a.var
UNION ALL SELECT concat('blanket|', b.trace_id, '|', b.var, '|', e.var, '|', s.var, '|', a.var), b.x1, e.x1, concat(s.x, a.x) FROM n AS b JOIN n AS e ON e.trace_id = b.trace_id AND e.t = b.t AND e.var > b.var
  JOIN n AS s ON s.trace_id = b.trace_id AND s.t = b.t AND s.var NOT IN (b.var, e.var) JOIN n AS a ON a.trace_id = b.trace_id AND a.t = b.t AND a.var > s.var AND a.var NOT IN (b.var, e.var)
""")

#: Passive score of each candidate: does its sensor update its base, do base and goal explain its action, does its action control its effect, do sensor and action screen base from effect, and are all active. ``terms`` has (keys, cmi_bits) of LOOP_OBSERVATIONS, ``entropies`` (trace_id, var, bits).
PASSIVE_SCORE = Op("""
WITH k AS (SELECT *, concat('flow|', trace_id, '|', s, '|', b) AS k_sensor, concat('policy|', trace_id, '|', a, '|', least(b, g), '|', greatest(b, g)) AS k_policy, concat('flow|', trace_id, '|', a, '|', e) AS k_control,
  concat('blanket|', trace_id, '|', least(b, e), '|', greatest(b, e), '|', least(s, a), '|', greatest(s, a)) AS k_blanket FROM {candidates}),
r AS (SELECT k.trace_id, b, s, a, g, e, greatest(CAST(0 AS DOUBLE), x1.cmi_bits) AS sensor, greatest(CAST(0 AS DOUBLE), x2.cmi_bits) AS policy, greatest(CAST(0 AS DOUBLE), x3.cmi_bits) AS control, greatest(CAST(0 AS DOUBLE), x4.cmi_bits) AS blanket,
  (hb.bits + hs.bits + ha.bits + hg.bits + he.bits) / 5 AS activity
  FROM k JOIN {terms} AS x1 ON x1.keys = k_sensor JOIN {terms} AS x2 ON x2.keys = k_policy JOIN {terms} AS x3 ON x3.keys = k_control JOIN {terms} AS x4 ON x4.keys = k_blanket
  JOIN {entropies} AS hb ON hb.trace_id = k.trace_id AND hb.var = b JOIN {entropies} AS hs ON hs.trace_id = k.trace_id AND hs.var = s JOIN {entropies} AS ha ON ha.trace_id = k.trace_id AND ha.var = a
  JOIN {entropies} AS hg ON hg.trace_id = k.trace_id AND hg.var = g JOIN {entropies} AS he ON he.trace_id = k.trace_id AND he.var = e),
p AS (SELECT *, DBL(1.15) * sensor + policy + DBL(1.2) * control - DBL(1.1) * blanket + DBL(0.08) * activity AS score FROM r)
SELECT trace_id, b, s, a, g, e, sensor, policy, control, blanket, activity, score, row_number() OVER (PARTITION BY trace_id ORDER BY round(score, 9) DESC, b, s, a, g, e) AS place FROM p
""")


def posterior(top: int = 500, temperature: float = 0.06) -> Op:
    """Softmax of the best candidates' scores, exponents held within 60."""
    return Op(f"""
WITH k AS (SELECT *, max(score) OVER (PARTITION BY trace_id) AS most FROM {{scored}} WHERE place <= {top}),
w AS (SELECT *, exp(greatest(CAST(-60 AS DOUBLE), least(CAST(60 AS DOUBLE), (score - most) / {temperature:e}))) AS weight FROM k)
SELECT trace_id, b, s, a, g, e, place, weight / sum(weight) OVER (PARTITION BY trace_id) AS p FROM w""")


#: Posterior mass of each variable in each role.
ROLE_MASS = Op("""
SELECT trace_id, role, var, sum(p) AS mass FROM (SELECT trace_id, 'b' AS role, b AS var, p FROM {posterior} UNION ALL SELECT trace_id, 's', s, p FROM {posterior} UNION ALL SELECT trace_id, 'a', a, p FROM {posterior}
  UNION ALL SELECT trace_id, 'g', g, p FROM {posterior} UNION ALL SELECT trace_id, 'e', e, p FROM {posterior}) AS r GROUP BY trace_id, role, var
""")

#: The next handle to test: of the best candidate its action, sensor or goal, the first not tried; with all tried, the handle of most expected gain. ``tried`` has (trace_id, role, var).
NEXT_OPERATION = Op("""
WITH handles AS (SELECT trace_id, 'a' AS role, a AS var, 1 AS turn FROM {posterior} WHERE place = 1 UNION ALL SELECT trace_id, 's', s, 2 FROM {posterior} WHERE place = 1 UNION ALL SELECT trace_id, 'g', g, 3 FROM {posterior} WHERE place = 1),
o AS (SELECT m.trace_id, m.role, m.var, m.mass, m.mass * (DBL(0.25) + 1 - m.mass) AS gain, coalesce(h.turn, 9) AS turn FROM {masses} AS m LEFT JOIN handles AS h ON h.trace_id = m.trace_id AND h.role = m.role AND h.var = m.var
  LEFT JOIN {tried} AS t ON t.trace_id = m.trace_id AND t.role = m.role AND t.var = m.var WHERE m.role IN ('a', 's', 'g') AND t.var IS NULL)
SELECT trace_id, role, var, mass, gain, turn < 9 AS of_best FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY turn, round(gain, 9) DESC, role, var) AS place FROM o) AS r WHERE place = 1
""")
