"""Candidates' roles tested by interventions, and the loop that chooses the next one.

``binary`` has (trace_id, t, var, x), ``operations`` (trace_id, t, op, handle): op is null, sensor_flip, action_block or goal_flip, and handle the
variable that it was done to; a tick has one row. ``candidates`` has (trace_id, b, s, a, g, e). Variables' names hold no unit separator (character 31),
which joins them in the keys of terms; keys are never split. Only ticks with a next one count. Candidates of a trace without the operation that a
part needs, or with too few of it, have 0 for that part. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutua.operators import directed
from mutua.operators.information import PLUGIN_CMI
from mutua.sqltext import Op
from mutua.storage import materialise

#: Rows of an operation and of it with undisturbed ones, what each part must exceed, and the parts' weights.
LEAST_DONE, LEAST_BOTH = 25, 50
SENSOR_OFFSET, ACTION_OFFSET, GOAL_OFFSET = 0.020, 0.12, 0.002
SENSOR_WEIGHT, ACTION_WEIGHT, GOAL_WEIGHT = 30.0, 4.0, 4.0
OPERATION = {"s": "sensor_flip", "a": "action_block", "g": "goal_flip"}


def _key(kind: str, *names: str) -> str:
    return "concat('" + kind + "', chr(31), " + ", chr(31), ".join(f"CAST({n} AS STRING)" for n in names) + ")"


#: Observations (keys, x, y, z): was the sensor flipped and the next action, given effect and goal; was the goal flipped and the action, given base and effect; effect and action, undisturbed and blocked.
OBSERVATIONS = Op(f"""
WITH n AS (SELECT * FROM (SELECT trace_id, t, var, CAST(x AS STRING) AS x, CAST(lead(x) OVER (PARTITION BY trace_id, var ORDER BY t) AS STRING) AS x1 FROM {{binary}}) AS l WHERE x1 IS NOT NULL),
o AS (SELECT p.trace_id, p.t, p.op, p.handle FROM {{operations}} AS p JOIN (SELECT DISTINCT trace_id, t FROM n) AS k ON k.trace_id = p.trace_id AND k.t = p.t),
c AS (SELECT trace_id, op, handle, count(*) AS done FROM o WHERE op IS NOT NULL GROUP BY trace_id, op, handle), u AS (SELECT trace_id, count(*) AS free FROM o WHERE op IS NULL GROUP BY trace_id),
ok AS (SELECT c.trace_id, op, handle, done > {LEAST_DONE} AND coalesce(free, 0) > {LEAST_DONE} AS many FROM c LEFT JOIN u ON u.trace_id = c.trace_id WHERE done >= {LEAST_DONE} AND done + coalesce(free, 0) >= {LEAST_BOTH}),
r AS (SELECT ok.trace_id, ok.op AS test, ok.handle AS on_var, many, t, CASE WHEN o.op IS NULL THEN '0' ELSE '1' END AS active FROM ok JOIN o ON o.trace_id = ok.trace_id AND (o.op IS NULL OR (o.op = ok.op AND o.handle = ok.handle))),
ds AS (SELECT DISTINCT trace_id, s, a, e, g FROM {{candidates}}), dg AS (SELECT DISTINCT trace_id, g, a, b, e FROM {{candidates}}), da AS (SELECT DISTINCT trace_id, a, e FROM {{candidates}})
SELECT {_key('sensor', 'd.trace_id', 's', 'a', 'e', 'g')} AS keys, active AS x, na.x1 AS y, concat(ne.x, ',', ng.x) AS z FROM ds AS d JOIN r ON r.trace_id = d.trace_id AND r.test = 'sensor_flip' AND r.on_var = d.s
  JOIN n AS na ON na.trace_id = r.trace_id AND na.t = r.t AND na.var = d.a JOIN n AS ne ON ne.trace_id = r.trace_id AND ne.t = r.t AND ne.var = d.e JOIN n AS ng ON ng.trace_id = r.trace_id AND ng.t = r.t AND ng.var = d.g
UNION ALL SELECT {_key('goal', 'd.trace_id', 'g', 'a', 'b', 'e')}, active, na.x, concat(nb.x, ',', ne.x) FROM dg AS d JOIN r ON r.trace_id = d.trace_id AND r.test = 'goal_flip' AND r.on_var = d.g
  JOIN n AS na ON na.trace_id = r.trace_id AND na.t = r.t AND na.var = d.a JOIN n AS nb ON nb.trace_id = r.trace_id AND nb.t = r.t AND nb.var = d.b JOIN n AS ne ON ne.trace_id = r.trace_id AND ne.t = r.t AND ne.var = d.e
UNION ALL SELECT concat({_key('action', 'd.trace_id', 'a', 'e')}, chr(31), active), ne.x1, na.x, ne.x FROM da AS d JOIN r ON r.trace_id = d.trace_id AND r.test = 'action_block' AND r.on_var = d.a AND r.many
  JOIN n AS na ON na.trace_id = r.trace_id AND na.t = r.t AND na.var = d.a JOIN n AS ne ON ne.trace_id = r.trace_id AND ne.t = r.t AND ne.var = d.e
""")

#: The parts and their weighted sum for every candidate. ``terms`` has (keys, cmi_bits) of OBSERVATIONS.
INTERVENTIONAL_SCORE = Op(f"""
WITH k AS (SELECT *, {_key('sensor', 'trace_id', 's', 'a', 'e', 'g')} AS k_sensor, {_key('goal', 'trace_id', 'g', 'a', 'b', 'e')} AS k_goal, {_key('action', 'trace_id', 'a', 'e')} AS k_action FROM {{candidates}}),
v AS (SELECT keys, greatest(DBL(0), cmi_bits) AS bits FROM {{terms}}),
r AS (SELECT k.trace_id, b, s, a, g, e, coalesce(x1.bits - DBL({SENSOR_OFFSET}), DBL(0)) AS sensor_int, coalesce(x3.bits - x4.bits - DBL({ACTION_OFFSET}), DBL(0)) AS action_int, coalesce(x2.bits - DBL({GOAL_OFFSET}), DBL(0)) AS goal_int
  FROM k LEFT JOIN v AS x1 ON x1.keys = k_sensor LEFT JOIN v AS x2 ON x2.keys = k_goal LEFT JOIN v AS x3 ON x3.keys = concat(k_action, chr(31), '0') LEFT JOIN v AS x4 ON x4.keys = concat(k_action, chr(31), '1'))
SELECT trace_id, b, s, a, g, e, sensor_int, action_int, goal_int, DBL({SENSOR_WEIGHT}) * sensor_int + DBL({ACTION_WEIGHT}) * action_int + DBL({GOAL_WEIGHT}) * goal_int AS interventional FROM r
""")

#: Both scores together, ranked as passive ones are.
COMBINED = Op("""
SELECT trace_id, b, s, a, g, e, score, row_number() OVER (PARTITION BY trace_id ORDER BY round(score, 9) DESC, b, s, a, g, e) AS place
FROM (SELECT p.trace_id, p.b, p.s, p.a, p.g, p.e, p.score + i.interventional AS score FROM {passive} AS p JOIN {interventional} AS i ON i.trace_id = p.trace_id AND i.b = p.b AND i.s = p.s AND i.a = p.a AND i.g = p.g AND i.e = p.e) AS c
""")


def score_interventions(binary: DataFrame, operations: DataFrame, candidates: DataFrame) -> DataFrame:
    terms = materialise(PLUGIN_CMI(observed=OBSERVATIONS(binary=binary, operations=operations, candidates=candidates)), "terms")
    return INTERVENTIONAL_SCORE(terms=terms, candidates=candidates)


def active_loop(binary: DataFrame, pool: DataFrame, passive: DataFrame, rounds: int = 3, batch: int = 200) -> DataFrame:
    """Rounds of choosing a handle, taking up to ``batch`` of its ticks from ``pool`` (all operations), and scoring anew, for all traces at once.

    ``passive`` has (trace_id, b, s, a, g, e, score, place). One row a round, trace and candidate: (round, trace_id, b, s, a, g, e, score, place, role, var), the last two
    being the handle tried in that round. Undisturbed ticks are known from the start. A trace whose handles have all been tried keeps its scores.
    """
    candidates = passive.select("trace_id", "b", "s", "a", "g", "e")
    scored, found = passive.select("trace_id", "b", "s", "a", "g", "e", "score", "place"), None
    known = pool.where("op IS NULL")
    tried = passive.select("trace_id", F.lit("").alias("role"), F.lit("").alias("var")).limit(0)
    for k in range(1, rounds + 1):
        posterior = materialise(directed.posterior()(scored=scored), "posterior")
        chosen = directed.NEXT_OPERATION(posterior=posterior, masses=directed.ROLE_MASS(posterior=posterior), tried=tried).select("trace_id", "role", "var")
        chosen = materialise(chosen, "chosen")
        tried = tried.unionByName(chosen)
        op = F.create_map(*[F.lit(x) for pair in OPERATION.items() for x in pair])
        asked = chosen.select("trace_id", op[F.col("role")].alias("op"), F.col("var").alias("handle"))
        rows = pool.join(asked, ["trace_id", "op", "handle"]).select("trace_id", "t", "op", "handle")
        ranked = rows.sparkSession.sql(f"SELECT trace_id, t, op, handle FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY t) AS place FROM {{rows}}) AS r WHERE place <= {batch}", rows=rows)
        known = materialise(known.unionByName(ranked.select(known.columns)), "known")
        scored = materialise(COMBINED(passive=passive, interventional=score_interventions(binary, known, candidates)), "scored")
        step = scored.join(chosen, "trace_id", "left").select(F.lit(k).alias("round"), *scored.columns, "role", "var")
        found = step if found is None else found.unionByName(step)
    return found
