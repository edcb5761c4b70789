"""Agents of a recording scored whole and by segments: influence on critical outcomes, and regulation.

Every scored unit (a trace, an agent, an outcome and a range of ticks) is a few sums. Ticks meet the
ranges that hold them by an equi-join on the tick, each tick in some two windows and the runs of activity
about it; a unit's regressions on all controls come from its sums of products, solved as small
systems; quantiles and means follow from one grouped aggregate. Resamples for the lower bound are
Poisson weights, hashes of unit, tick and replicate, and summed where the ticks lie: no tick is
sent once a replicate.

Inputs: ``trace`` (trace_id, t, var, value), complete; ``roles`` (agent, var, role) with role sensor, internal or action, agent 0 or more;
``outcomes`` (name, var, direction), direction ``lower_is_better`` or ``higher_is_better``; ``controls`` (var). Ticks are taken in order of ``t``.
An outcome is never its own control. Traces without rows do not occur; an agent without actions has actions of 0; without outcomes, or under the least number
of ticks, a trace is skipped with a reason. Ties go to the earlier segment and the first name. Null values are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutua.operators import segments
from mutua.sqltext import Op
from mutua.storage import materialise

#: Fixed values of the flags.
ODDS_MIN, ODDS_LOW_MIN, SELECTIVITY_MIN, INFLUENCE_MIN, INFLUENCE_STRONG = 1.40, 1.08, 1.05, 0.25, 0.30
SURE_ODDS, SURE_LOW, SELECTIVITY_FLOOR = 1.65, 1.15, 0.78
#: A segment adds a flag if its influence is this much over the whole trace's.
BOOST_RATIO, BOOST_STEP = 1.1, 0.02
BAD_QUANTILE, LEAST_TICKS, LEAST_SEGMENT, LEAST_TRACE = 0.80, 8, 40, 80
REPLICATES = 120
UNIT = ["trace_id", "agent", "outcome", "start_t", "end_t"]
SERIES = UNIT[:3]


def agent_activity(trace: DataFrame, roles: DataFrame) -> DataFrame:
    """(trace_id, agent, k, action, size): mean of the agent's actions and of their sizes at the k-th tick, 0 without actions."""
    ticks = trace.select("trace_id", "t").distinct().withColumn("k", F.row_number().over(Window.partitionBy("trace_id").orderBy("t")) - 1)
    agents = roles.where("agent >= 0").select("agent").distinct()
    acts = trace.join(roles.where("role = 'action' AND agent >= 0").select("agent", "var"), "var").groupBy("trace_id", "t", "agent").agg(F.avg("value").alias("action"), F.avg(F.abs("value")).alias("size"))
    every = ticks.join(agents, how="cross").join(acts, ["trace_id", "t", "agent"], "left")  # a row for each tick and agent, as the result has
    return every.select("trace_id", "agent", "t", F.col("k").cast("long").alias("k"), F.coalesce("action", F.lit(0.0)).alias("action"), F.coalesce("size", F.lit(0.0)).alias("size"))


def agent_series(trace: DataFrame, roles: DataFrame, outcomes: DataFrame, controls: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """(trace_id, agent, outcome, k, action, size, value, w, action0, value0): outcomes so that higher is worse, controls centred, the last two of the tick before."""
    activity = agent_activity(trace, roles) if activity is None else activity
    signed = trace.join(outcomes.select(F.col("name").alias("outcome"), "var", "direction"), "var")
    signed = signed.select("trace_id", "t", "outcome", F.col("var").alias("own"), F.when(F.col("direction") == "higher_is_better", -F.col("value")).otherwise(F.col("value")).alias("value"))
    centred = trace.join(controls.select("var").distinct(), "var").withColumn("x", F.col("value") - F.avg("value").over(Window.partitionBy("trace_id", "var")))
    vectors = centred.groupBy("trace_id", "t").agg(F.array_sort(F.collect_list(F.struct("var", "x"))).alias("named"))
    joined = signed.join(vectors, ["trace_id", "t"], "left").withColumn("w", F.coalesce(F.transform(F.filter("named", lambda s: s["var"] != F.col("own")), lambda s: s["x"]), F.array().cast("array<double>")))
    series = activity.join(joined.select("trace_id", "t", "outcome", "value", "w"), ["trace_id", "t"])
    before = Window.partitionBy(*SERIES).orderBy("k")
    return series.select(*SERIES, "k", "action", "size", "value", "w", F.lag("action").over(before).alias("action0"), F.lag("value").over(before).alias("value0"))


def auto_segments(activity: DataFrame) -> DataFrame:
    """(trace_id, agent, start_t, end_t): sliding windows of a sixth of the trace, and runs above a threshold of the agent's own, padded to a window; each once. The whole trace where none is long enough."""
    named = activity.select(F.struct("trace_id", "agent").alias("trace_id"), "k", F.col("size").alias("value"))
    params = segments.SEGMENT_PARAMETERS(activity=named)
    level = named.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(value, 0.5)").alias("middle"), F.stddev_pop("value").alias("sd"))
    params = materialise(params.join(level, "trace_id"), "segment-parameters")
    width, n = F.col("width").cast("long"), F.col("n")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - width, F.lit(0)), F.col("step").cast("long"))
    slid = params.select("trace_id", "n", "width", "least_run", F.explode(starts).alias("start_t")).withColumn("end_t", F.least(n, F.col("start_t") + width)).where("end_t - start_t >= least_run")
    mask = named.join(params.where("coefficient IS NOT NULL"), "trace_id").select("trace_id", F.col("k").alias("t"), (F.col("value") > F.col("middle") + F.col("coefficient") * F.col("sd")).alias("active"))
    runs = segments.active_runs(1)(mask=mask).drop("n").join(params, "trace_id").where("end_t - start_t >= least_run")
    length = F.col("end_t") - F.col("start_t")
    early = F.greatest(F.lit(0), F.col("start_t") - F.floor((width - length) / 2))
    end = F.least(n, early + width)
    padded = runs.select("trace_id", F.when(length < width, F.greatest(F.lit(0), end - width)).otherwise(F.col("start_t")).alias("start_t"), F.when(length < width, end).otherwise(F.col("end_t")).alias("end_t"))
    some = slid.where("n >= least_run").select("trace_id", "start_t", "end_t").unionByName(padded).distinct()
    whole = params.join(some.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.lit(0).cast("long").alias("start_t"), F.col("n").alias("end_t"))
    return some.unionByName(whole).select("trace_id.trace_id", "trace_id.agent", F.col("start_t").cast("long").alias("start_t"), F.col("end_t").cast("long").alias("end_t"))


def _units(series: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ticks of every range, once for each range that holds them."""
    ticks = ranges.withColumn("k", F.explode(F.sequence("start_t", F.col("end_t") - 1)))
    return series.join(ticks, ["trace_id", "agent", "k"])


def _fitted(rows: DataFrame, targets: list[str], width: int) -> DataFrame:
    """``rows`` with each target replaced by its residual on the controls, by unit, with intercept; without a unique fit the shortest one. Rows with a null target are left out."""
    rows = rows.where(reduce(Column.__and__, [F.col(y).isNotNull() for y in targets]))
    xs = [F.lit(1.0), *[F.coalesce(F.get("w", F.lit(j)), F.lit(0.0)) for j in range(width)]]
    ys = [F.col(y) for y in targets]
    n, m = len(xs), len(ys)
    gram = F.array(*[F.sum(a * b) for a in xs for b in xs])
    cross = F.array(*[F.sum(a * y) for a in xs for y in ys])
    sums = rows.groupBy(*UNIT).agg(gram.alias("gram"), cross.alias("cross"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = [(np.linalg.pinv(np.asarray(g, float).reshape(n, n), hermitian=True) @ np.asarray(c, float).reshape(n, m)).T.ravel().tolist() for g, c in zip(frame["gram"], frame["cross"])]
            yield frame[UNIT].assign(fit=pd.Series(fits, index=frame.index, dtype=object))

    fits = sums.mapInPandas(solve, sums.select(*UNIT).schema.simpleString()[7:-1].replace(":", " ") + ", fit array<double>")
    residual = lambda i: F.col(targets[i]) - reduce(Column.__add__, [F.get("fit", F.lit(i * n + j)) * x for j, x in enumerate(xs)])
    return rows.join(fits, UNIT).withColumns({targets[i]: residual(i) for i in range(m)}).drop("fit")


def _ratio(bad: Column, y: Column, among: Column, least: int) -> Column:
    """Mean size among bad ticks over that among good ones; 1 with too few of either."""
    mean = lambda of: F.avg(F.when(of & among, y)) + 1e-6
    few = (F.count_if(bad & among) < least) | (F.count_if(~bad & among) < least)
    return F.when(few, 1.0).otherwise(mean(bad) / mean(~bad))


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: Where the distribution of a Poisson variate of mean 1 passes each count.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))


def _resampled(frames: Iterator[pd.DataFrame], replicates: int) -> Iterator[pd.DataFrame]:
    """By unit and replicate, over the task: weights of bad and good ticks, and their weighted sizes."""
    held: dict[tuple, np.ndarray] = {}
    turns = _hashed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for frame in frames:
        for unit, rows in frame.groupby(UNIT, sort=False):
            for part in range(0, len(rows), 4096):
                of = rows.iloc[part : part + 4096]
                draws = _hashed(of["key"].to_numpy(np.int64).view(np.uint64)[:, None] + turns[None])
                weights = np.searchsorted(_POISSON, (draws >> np.uint64(11)) / float(1 << 53), "right").astype(float)
                bad, y = of["bad"].to_numpy(bool), of["y"].to_numpy()
                sums = np.stack([weights[bad].sum(0), (weights[bad] * y[bad, None]).sum(0), weights[~bad].sum(0), (weights[~bad] * y[~bad, None]).sum(0)], 1)
                held[unit] = held.get(unit, 0) + sums
    for unit, sums in held.items():
        yield pd.DataFrame([(*unit, k, *row) for k, row in enumerate(sums.tolist())], columns=[*UNIT, "rep", "n_bad", "y_bad", "n_good", "y_good"])


def score_units(units: DataFrame, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(unit, influence, odds, low, selectivity, combined, flagged) of the ticks of units."""
    units = materialise(units, "units")
    width = units.agg(F.max(F.size("w"))).first()[0] or 0
    step = units.where("k > start_t").select(*UNIT, "k", F.col("action0").alias("a"), (F.col("value") - F.col("value0")).alias("d"), "w")
    corr = F.when((F.stddev_pop("a") * F.stddev_pop("d") >= 1e-9) & (F.max(F.col("end_t") - F.col("start_t")) > LEAST_TICKS + 1), -F.expr("regr_sxy(a, d) / nullif(sqrt(regr_sxx(a, d) * regr_syy(a, d)), 0)"))
    influence = _fitted(step, ["a", "d"], width).groupBy(*UNIT).agg(F.coalesce(corr, F.lit(0.0)).alias("influence"))
    own = units.where(f"end_t - start_t >= {LEAST_SEGMENT}").withColumns({"y": F.col("size"), "o": F.col("value"), "move": F.when(F.col("k") == F.col("start_t"), 0.0).otherwise(F.abs(F.col("value") - F.col("value0")))})
    own = materialise(_fitted(own, ["y", "o"], width).select(*UNIT, "k", F.abs("y").alias("y"), F.round("o", 9).alias("o"), "move"), "residuals")
    edges = own.groupBy(*UNIT).agg(F.round(F.expr(f"percentile(o, {BAD_QUANTILE})"), 9).alias("edge"), F.expr("percentile(move, 0.6)").alias("hi"), F.expr("percentile(move, 0.4)").alias("lo"))
    marked = own.join(edges, UNIT).select(*UNIT, "k", "y", (F.col("o") >= F.col("edge")).alias("bad"), (F.col("move") >= F.col("hi")).alias("lively"), (F.col("move") <= F.col("lo")).alias("calm"))
    marked = materialise(marked, "marked")
    bad, y = F.col("bad"), F.col("y")
    enough = (F.count_if(bad) >= 5) & (F.count_if(~bad) >= 5)
    parts = (F.count_if("lively") >= 8) & (F.count_if("calm") >= 8)
    selectivity = F.when(enough & parts, _ratio(bad, y, F.col("lively"), 3) / (_ratio(bad, y, F.col("calm"), 3) + 1e-6)).otherwise(1.0)
    odds = marked.groupBy(*UNIT).agg(_ratio(bad, y, F.lit(True), 5).alias("odds"), selectivity.alias("selectivity"), enough.alias("enough"))
    keyed = marked.select(*UNIT, F.xxhash64(F.lit(seed), *UNIT, "k").alias("key"), "bad", "y")
    columns = keyed.select(*UNIT).schema.simpleString()[7:-1].replace(":", " ")
    sums = keyed.mapInPandas(lambda frames: _resampled(frames, replicates), f"{columns}, rep int, n_bad double, y_bad double, n_good double, y_good double")
    reps = sums.groupBy(*UNIT, "rep").agg(*[F.sum(c).alias(c) for c in ("n_bad", "y_bad", "n_good", "y_good")]).where("n_bad >= 3 AND n_good >= 3")
    low = reps.groupBy(*UNIT).agg(F.expr("percentile((y_bad / n_bad + 1e-6) / (y_good / n_good + 1e-6), 0.1)").alias("low"))
    every = units.select(*UNIT).distinct().join(influence, UNIT, "left").join(odds, UNIT, "left").join(low, UNIT, "left")
    every = every.select(*UNIT, F.coalesce("influence", F.lit(0.0)).alias("influence"), F.coalesce("odds", F.lit(1.0)).alias("odds"), F.when(F.col("enough"), F.coalesce("low", "odds")).otherwise(1.0).alias("low"), F.coalesce("selectivity", F.lit(1.0)).alias("selectivity"))
    size = F.abs("influence")
    defence = ((F.col("odds") >= ODDS_MIN) & (F.col("low") >= ODDS_LOW_MIN) & (F.col("influence") > 0)) | ((F.col("odds") >= SURE_ODDS) & (F.col("low") >= SURE_LOW))
    control = (size >= INFLUENCE_MIN) & ((F.col("selectivity") >= min(SELECTIVITY_MIN, SELECTIVITY_FLOOR)) | (size >= INFLUENCE_STRONG))
    return every.withColumns({"combined": F.greatest(F.col("odds") / ODDS_MIN, size / INFLUENCE_MIN, F.col("selectivity") / SELECTIVITY_MIN), "flagged": defence | control})


def score_outcomes(series: DataFrame, activity: DataFrame, segmented: DataFrame, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Scores of every (trace_id, agent, outcome): over the whole trace, and for the traces named in ``segmented`` (trace_id) also by segments: the best segment, and a flag if the whole or any segment beyond it has one."""
    whole = activity.groupBy("trace_id", "agent").agg(F.lit(0).cast("long").alias("start_t"), (F.max("k") + 1).alias("end_t"))
    some = materialise(auto_segments(activity.join(segmented.select("trace_id"), "trace_id", "left_semi")), "segments")
    numbers = some.groupBy("trace_id", "agent").agg(F.count(F.lit(1)).alias("n_segments"))
    parts = some.join(numbers.where("n_segments > 1"), ["trace_id", "agent"], "left_semi").where(f"end_t - start_t >= {LEAST_SEGMENT}")
    ranges = whole.unionByName(parts).distinct()
    scored = materialise(score_units(_units(series, ranges), replicates, seed), "scored-units")
    full = scored.join(whole, ["trace_id", "agent", "start_t", "end_t"], "left_semi")
    fields = ["start_t", "end_t", "influence", "odds", "low", "selectivity", "combined", "flagged"]
    by_part = scored.join(parts, ["trace_id", "agent", "start_t", "end_t"], "left_semi").groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    joined = full.select(*SERIES, F.struct(*fields).alias("full")).join(by_part, SERIES, "left").join(numbers, ["trace_id", "agent"], "left")

    def better(best: Column, part: Column) -> Column:
        return F.when((part["combined"] > best["combined"]) | (part["flagged"] & ~best["flagged"]), part).otherwise(best)

    beyond = lambda part: part["flagged"] & (F.abs(part["influence"]) >= F.greatest(F.lit(INFLUENCE_MIN), F.abs(F.col("full.influence")) * BOOST_RATIO + BOOST_STEP)) & ((part["combined"] >= F.col("full.combined")) | (F.abs(part["influence"]) >= INFLUENCE_STRONG))
    parts_or_none = F.coalesce("parts", F.slice(F.array("full"), 1, 0))
    found = joined.withColumns({"best": F.aggregate(parts_or_none, F.col("full"), better), "boost": F.exists(parts_or_none, beyond)})
    return found.select(*SERIES, *[F.col(f"best.{c}").alias(c) for c in fields[:6]], F.greatest("best.combined", "full.combined").alias("combined"), (F.col("full.flagged") | F.col("boost")).alias("flagged"), F.coalesce("n_segments", F.lit(1)).cast("int").alias("n_segments"))


def score_recordings(trace: DataFrame, roles: DataFrame, outcomes: DataFrame, controls: DataFrame, mode: str = "auto", least: int = LEAST_TRACE, replicates: int = REPLICATES, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Each agent's score in each trace, (trace_id, agent, mode, max_combined, flagged, best_outcome); and every trace (trace_id, ticks, n_outcomes, mode, skipped, flagged_agents).

    ``mode`` is full, segmented or auto: segments where the trace is long and its agents act rarely.
    """
    lengths = trace.groupBy("trace_id").agg(F.count_distinct("t").alias("ticks"))
    n_outcomes = outcomes.select("name").distinct().count()
    skipped = F.when(F.col("ticks") < least, "trace_too_short").when(F.lit(n_outcomes == 0), "no_critical_outcomes")
    lengths = materialise(lengths.withColumn("skipped", skipped), "lengths")
    kept = trace.join(lengths.where("skipped IS NULL"), "trace_id", "left_semi")
    activity = materialise(agent_activity(kept, roles), "activity")
    if mode == "auto":
        segmented = segments.should_segment()(activity=activity.select("trace_id", "agent", F.col("k").alias("t"), F.col("size").alias("value"))).where("segment").select("trace_id")
    else:
        segmented = lengths.where(F.lit(mode == "segmented")).select("trace_id")
    segmented = materialise(segmented, "segmented")
    scored = materialise(score_outcomes(agent_series(kept, roles, outcomes, controls, activity), activity, segmented, replicates, seed), "scores")
    order = F.struct(F.col("flagged").cast("int"), "combined")
    best = scored.groupBy("trace_id", "agent").agg(F.max("combined").alias("max_combined"), F.max("flagged").alias("flagged"), F.max(order).alias("top"), F.collect_list(F.struct("outcome", order.alias("o"))).alias("named"))
    best = best.withColumn("best_outcome", F.array_min(F.transform(F.filter("named", lambda s: s["o"] == F.col("top")), lambda s: s["outcome"])))
    how = lengths.join(segmented.withColumn("mode", F.lit("segmented")), "trace_id", "left").select("trace_id", "ticks", F.coalesce("mode", F.lit("full")).alias("mode"), "skipped")
    agents = best.join(how.select("trace_id", "mode"), "trace_id").select("trace_id", "agent", "mode", "max_combined", "flagged", "best_outcome")
    marked = agents.where("flagged").groupBy("trace_id").agg(F.array_sort(F.collect_list("agent")).alias("flagged_agents"))
    traces = how.join(marked, "trace_id", "left").select("trace_id", "ticks", F.lit(n_outcomes).alias("n_outcomes"), "mode", "skipped", F.coalesce("flagged_agents", F.array().cast(marked.schema["flagged_agents"].dataType)).alias("flagged_agents"))
    return agents, traces


def regulation_scores(ratio_max: float = 0.012, least: int = LEAST_TRACE) -> Op:
    """How each agent's internal variables are held against its sensors: flatness, ratio of variances, compensation, regulation.

    An internal variable's sensor is the only one, the one at its own place where there are as many, else the first. The agent's action is the mean of its action
    variables, one tick before. ``roles`` has (agent, var, role, place), ``active`` (trace_id, t, active): only active ticks count, unless they are under 8.
    """
    return Op(f"""
WITH ok AS (SELECT trace_id, count_if(active) >= 8 AS some FROM {{active}} GROUP BY trace_id),
long AS (SELECT trace_id FROM {{trace}} GROUP BY trace_id HAVING count(DISTINCT t) >= {least}),
x AS (SELECT v.trace_id, v.t, v.var, v.value FROM {{trace}} AS v JOIN long ON long.trace_id = v.trace_id LEFT JOIN ok ON ok.trace_id = v.trace_id LEFT JOIN {{active}} AS m ON m.trace_id = v.trace_id AND m.t = v.t WHERE NOT coalesce(ok.some, false) OR coalesce(m.active, false)),
s AS (SELECT agent, var, row_number() OVER (PARTITION BY agent ORDER BY place) AS k, count(*) OVER (PARTITION BY agent) AS n FROM {{roles}} WHERE role = 'sensor' AND agent >= 0),
i AS (SELECT agent, var, row_number() OVER (PARTITION BY agent ORDER BY place) AS k, count(*) OVER (PARTITION BY agent) AS n FROM {{roles}} WHERE role = 'internal' AND agent >= 0),
p AS (SELECT i.agent, i.var AS internal_var, s.var AS sensor_var FROM i JOIN s ON s.agent = i.agent AND s.k = CASE WHEN s.n > 1 AND s.n = i.n THEN i.k ELSE 1 END),
a AS (SELECT trace_id, t, agent, avg(value) AS action FROM x JOIN {{roles}} AS r ON r.var = x.var AND r.role = 'action' AND r.agent >= 0 GROUP BY trace_id, t, agent),
al AS (SELECT trace_id, t, agent, lag(action) OVER (PARTITION BY trace_id, agent ORDER BY t) AS before FROM a),
d AS (SELECT al.trace_id, al.agent, internal_var, sensor_var, c.value AS controlled, e.value AS drive, before FROM al JOIN p ON p.agent = al.agent JOIN x AS c ON c.trace_id = al.trace_id AND c.t = al.t AND c.var = internal_var JOIN x AS e ON e.trace_id = al.trace_id AND e.t = al.t AND e.var = sensor_var),
g AS (SELECT trace_id, agent, internal_var, sensor_var, var_pop(controlled) AS vc, var_pop(drive) AS vd, stddev_pop(before) * stddev_pop(CASE WHEN before IS NOT NULL THEN drive END) AS spread, covar_pop(before, drive) AS r FROM d GROUP BY trace_id, agent, internal_var, sensor_var),
f AS (SELECT *, CASE WHEN vd <= 1e-9 THEN DBL(0) ELSE greatest(DBL(0), 1 - vc / (vd + 1e-9)) END AS flatness, CASE WHEN vd > 1e-9 THEN vc / (vd + 1e-9) END AS ratio, CASE WHEN spread > 1e-9 THEN greatest(DBL(0), -r / spread) ELSE DBL(0) END AS compensation FROM g)
SELECT trace_id, agent, internal_var, sensor_var, flatness, ratio, compensation, CASE WHEN ratio <= {ratio_max:e} THEN flatness * compensation ELSE DBL(0) END AS regulation FROM f""")


def regulation_by_agent(threshold: float = 0.15, least: int = LEAST_TRACE) -> Op:
    """Each trace's and agent's best internal variable, flagged at the threshold; agents that lack a role have 0 and no variable, short traces are skipped with a reason. ``scores`` as above."""
    return Op(f"""
WITH n AS (SELECT trace_id, count(DISTINCT t) AS ticks FROM {{trace}} GROUP BY trace_id), a AS (SELECT DISTINCT agent FROM {{roles}} WHERE agent >= 0),
b AS (SELECT *, row_number() OVER (PARTITION BY trace_id, agent ORDER BY regulation DESC, internal_var) AS place FROM {{scores}})
SELECT n.trace_id, ticks, a.agent, coalesce(regulation, DBL(0)) AS max_regulation, internal_var AS best_internal, coalesce(regulation >= {threshold:e}, false) AS flagged, CASE WHEN ticks < {least} THEN 'trace_too_short' END AS skipped
FROM n JOIN a ON true LEFT JOIN b ON b.trace_id = n.trace_id AND b.agent = a.agent AND b.place = 1""")
