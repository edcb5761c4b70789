"""Sets of variables scored by their boundary, and nulls over sets, from lagged moment tables.

``lagged_moments`` reduces the ticks of each trace once: second moments of all variables now, of
now and ``lag`` ticks later, over all ticks and over those that have a later one. Ticks become
vectors, a task multiplies its vectors block-wise and sends sums of pairs. Everything after
works on these sums, whose number depends on the variables only: covariances of any
roles, components of any outside and their lagged correlations are linear in them, so a
thousand random sets cost no pass over ticks. Sets are dealt over tasks in chunks; a task holds one trace's
moments and a chunk of its sets.

A trace is (trace_id, t, var, value), one row a tick and variable; ticks are whole numbers, those that
lack a variable or hold a null are left out. Logarithms are natural. Ties between variables go
to the later name. A score that is not defined (no internal or no outside variable, fewer than three
pairs of ticks) is null. Random choices are hashes of trace, set, draw and name, so they repeat anywhere.
Repeated members count once; members that are no variables of the trace are ignored; empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutua.operators.dense import gaussian_information
from mutua.storage import materialise

RIDGE = 1e-6
OUTSIDE = 6
DRAWS = 200
#: Parts that a trace's sets are dealt in.
CHUNKS = 8
KINDS = ("whole", "past", "next", "cross")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products by trace over the task, of vectors with a leading 1. Vectors of a trace have one length."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        frame = batch.to_pandas()
        for trace, rows in frame.groupby("trace_id", sort=False):
            x = np.vstack(rows["x"].to_list())
            x = np.hstack([np.ones((len(x), 1)), x])
            both = rows["y"].notna().to_numpy()
            now = x[both]
            later = np.hstack([np.ones((len(now), 1)), np.vstack(rows["y"][both].to_list())]) if both.any() else now
            held[trace] = held.get(trace, 0) + np.stack([x.T @ x, now.T @ now, later.T @ later, now.T @ later])
    for trace, sums in held.items():
        n = sums.shape[1]
        i, j = np.divmod(np.arange(n * n), n)
        columns = [pa.array([trace] * (n * n), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(s.ravel()) for s in sums)]
        yield pa.RecordBatch.from_arrays(columns, names=["trace_id", "i", "j", *KINDS])


def lagged_moments(trace: DataFrame, lag: int = 1) -> DataFrame:
    """One row a trace: (trace_id, vars, means, i, j, whole, past, next, cross), the last six as arrays over all pairs of variables, 0 being the constant. Values are taken from their means first."""
    rows = trace.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("t").cast("long").alias("t"), "var", F.col("value").cast("double").alias("value"))
    means = rows.groupBy("trace_id", "var").agg(F.avg("value").alias("mean"))
    names = means.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("var", "mean"))).alias("named"))
    names = materialise(names.select("trace_id", F.col("named.var").alias("vars"), F.col("named.mean").alias("means")), "variables")
    ticks = rows.where("value IS NOT NULL").groupBy("trace_id", "t").agg(F.array_sort(F.collect_list(F.struct("var", "value"))).alias("named"))
    ticks = ticks.join(names, "trace_id").where("named.var = vars")
    ticks = materialise(ticks.select("trace_id", "t", F.zip_with("named.value", "means", lambda a, b: a - b).alias("x")), "ticks")
    later = ticks.select("trace_id", (F.col("t") - lag).alias("t"), F.col("x").alias("y"))
    pairs = ticks.join(later, ["trace_id", "t"], "left").select("trace_id", "x", "y")
    sums = pairs.mapInArrow(_sums, "trace_id string, i int, j int, " + ", ".join(f"{k} double" for k in KINDS))
    cells = sums.groupBy("trace_id", "i", "j").agg(*[F.sum(k).alias(k) for k in KINDS])
    whole = cells.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", *KINDS))).alias("cells"))
    return names.join(whole, "trace_id").select("trace_id", "vars", "means", *[F.col(f"cells.{k}").alias(k) for k in ("i", "j", *KINDS)])


def lagged_covariances(moments: DataFrame) -> DataFrame:
    """(trace_id, i, j, past, next, cross): covariances, with the number of pairs below, of variables i and j now, later, and i now with j later."""
    cell = F.explode(F.arrays_zip("i", "j", *KINDS[1:])).alias("c")
    cells = moments.select("trace_id", "vars", cell).select("trace_id", "vars", "c.*")
    row = Window.partitionBy("trace_id", "i")
    column = Window.partitionBy("trace_id", "j")
    first = lambda k, of, w: F.max(F.when(F.col(of) == 0, F.col(k))).over(w)
    # Sums of i: its products with the constant; in ``cross`` the constant is later as a column and now as a row.
    with_sums = cells.select("*", *[first(k, "j", row).alias(f"{k}_i") for k in KINDS[1:]], *[first(k, "i", column).alias(f"{k}_j") for k in KINDS[1:]], F.max(F.when(F.col("i") + F.col("j") == 0, F.col("past"))).over(Window.partitionBy("trace_id")).alias("n"))
    name = lambda k: F.get("vars", F.col(k) - 1).alias(k)
    found = with_sums.where("i > 0 AND j > 0 AND n > 0")
    return found.select("trace_id", name("i"), name("j"), F.col("n").cast("long").alias("n"), *[(F.col(k) / F.col("n") - F.col(f"{k}_i") * F.col(f"{k}_j") / F.col("n") ** 2).alias(k) for k in KINDS[1:]])


@dataclass(frozen=True)
class Moments:
    """One trace's moments."""

    vars: list[str]
    whole: np.ndarray
    past: np.ndarray
    next: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(row: pd.Series) -> Moments:
        n = len(row["vars"]) + 1
        return Moments(list(row["vars"]), *(np.asarray(row[k], float).reshape(n, n) for k in KINDS))

    @property
    def pairs(self) -> float:
        return float(self.past[0, 0])

    @staticmethod
    def _covariance(sums: np.ndarray) -> np.ndarray:
        n = max(sums[0, 0], 1)
        return sums[1:, 1:] / n - np.outer(sums[1:, 0], sums[0, 1:]) / n**2

    def covariance(self, kind: str) -> np.ndarray:
        return self._covariance(getattr(self, kind))

    def joint(self, later: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Covariance of linear forms of later values (columns of ``later``) followed by forms of values now."""
        across = later.T @ self.covariance("cross").T @ now
        return np.block([[later.T @ self.covariance("next") @ later, across], [across.T, now.T @ self.covariance("past") @ now]])

    def outside(self, members: list[int], most: int) -> np.ndarray:
        """Leading components of the variables that are no members, as forms of all variables."""
        others = [k for k in range(len(self.vars)) if k not in set(members)]
        forms = np.zeros((len(self.vars), min(most, len(others))))
        if others:
            _, vectors = np.linalg.eigh(self.covariance("whole")[np.ix_(others, others)])
            forms[others] = vectors[:, ::-1][:, : forms.shape[1]]
        return forms


def _units(n: int, of: list[int]) -> np.ndarray:
    return np.eye(n)[:, of]


def _correlations(cross: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sd = lambda c: np.sqrt(np.maximum(np.diag(c), 0)) + 1e-12
    return cross / np.outer(sd(a), sd(b))


def assign_roles(m: Moments, members: list[int], outside: np.ndarray, n_sensors: int = 1, n_actions: int = 1) -> tuple[list[int], list[int], list[int]]:
    """Sensors (followed most from outside), actions (lead the outside most) and internal members; at least one member stays internal."""
    mine = _units(len(m.vars), members)
    past, following, cross = m.covariance("past"), m.covariance("next"), m.covariance("cross")
    if outside.shape[1]:
        into = np.abs(_correlations(outside.T @ cross @ mine, outside.T @ past @ outside, mine.T @ following @ mine)).mean(0)
        out = np.abs(_correlations(mine.T @ cross @ outside, mine.T @ past @ mine, outside.T @ following @ outside)).mean(1)
    else:
        into = out = np.zeros(len(members))
    n_sensors = min(n_sensors, max(0, len(members) - 1))
    n_actions = min(n_actions, max(0, len(members) - 1 - n_sensors))
    by = lambda score, of: sorted(of, key=lambda k: (-score[k], -k))
    sensors = by(into, range(len(members)))[:n_sensors]
    actions = by(out, [k for k in range(len(members)) if k not in sensors])[:n_actions]
    internal = [k for k in range(len(members)) if k not in sensors and k not in actions]
    return tuple([members[k] for k in x] for x in (sensors, actions, internal))


def loss_of_roles(m: Moments, internal: list[int], external: list[int] | np.ndarray, interface: list[int], ridge: float = RIDGE) -> float | None:
    """I(internal later; external later | interface now); ``external`` may be forms of variables."""
    n = len(m.vars)
    forms = external if isinstance(external, np.ndarray) else _units(n, external)
    if not internal or not forms.shape[1] or m.pairs < 3:
        return None
    cov = m.joint(np.hstack([_units(n, internal), forms]), _units(n, interface))
    a, b = len(internal), len(internal) + forms.shape[1]
    return gaussian_information(cov, list(range(a)), list(range(a, b)), list(range(b, len(cov))), ridge)


def autonomy(m: Moments, members: list[int], outside: np.ndarray, ridge: float = RIDGE) -> float | None:
    """I(members later; members now | outside now)."""
    if not members or not outside.shape[1] or m.pairs < 3:
        return None
    mine = _units(len(m.vars), members)
    cov = m.joint(mine, np.hstack([mine, outside]))
    a = len(members)
    return gaussian_information(cov, list(range(a)), list(range(a, 2 * a)), list(range(2 * a, len(cov))), ridge)


def _by_sets(moments: DataFrame, sets: DataFrame, schema: str, run: Callable[[Moments, pd.Series], dict]) -> DataFrame:
    """``run`` on every row of ``sets`` with its trace's moments, both dealt in chunks by a hash of the row."""
    sets = sets.withColumn("chunk", F.pmod(F.xxhash64("set_id", "draw"), F.lit(CHUNKS)).cast("int"))
    spread = moments.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
    names = [c.split()[0] for c in schema.split(", ")]

    def both(own: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(of):
            return pd.DataFrame(columns=names, dtype=object)
        m = Moments.of(of.iloc[0])
        return pd.DataFrame([run(m, row) for _, row in own.iterrows()], columns=names, dtype=object)

    return sets.groupBy("trace_id", "chunk").cogroup(spread.groupBy("trace_id", "chunk")).applyInPandas(both, schema)


def _places(m: Moments, names: list[str]) -> list[int]:
    at = {v: k for k, v in enumerate(m.vars)}
    return sorted({at[v] for v in names if v in at})


def _as_sets(members: DataFrame) -> DataFrame:
    """(trace_id, set_id, draw, members) with sorted distinct members; ``draw`` is 0 unless there is one."""
    own = members if "draw" in members.columns else members.withColumn("draw", F.lit(0))
    keys = [F.col("trace_id").cast("string").alias("trace_id"), F.col("set_id").cast("string").alias("set_id"), F.col("draw").cast("int").alias("draw")]
    return own.select(*keys, "var").groupBy("trace_id", "set_id", "draw").agg(F.array_sort(F.collect_set("var")).alias("members"))


def boundary_loss(moments: DataFrame, roles: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """(trace_id, set_id, draw, loss) of given roles: ``roles`` has (trace_id, set_id, var, role), role internal, external or interface."""
    keys = ["trace_id", "set_id", "draw"]
    own = roles if "draw" in roles.columns else roles.withColumn("draw", F.lit(0))
    of = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("var")))).alias(role)
    sets = own.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("set_id").cast("string").alias("set_id"), F.col("draw").cast("int").alias("draw"), "var", "role").groupBy(*keys).agg(*[of(r) for r in ("internal", "external", "interface")])

    def run(m: Moments, row: pd.Series) -> dict:
        return {**{k: row[k] for k in keys}, "loss": loss_of_roles(m, *(_places(m, row[r]) for r in ("internal", "external", "interface")), ridge)}

    return _by_sets(moments, sets, "trace_id string, set_id string, draw int, loss double", run)


def member_scores(moments: DataFrame, members: DataFrame, n_sensors: int = 1, n_actions: int = 1, outside: int = OUTSIDE, ridge: float = RIDGE) -> DataFrame:
    """(trace_id, set_id, draw, size, loss, autonomy, sensors, actions, internal) of sets (trace_id, set_id, var)."""

    def run(m: Moments, row: pd.Series) -> dict:
        own = _places(m, row["members"])
        forms = m.outside(own, outside)
        roles = assign_roles(m, own, forms, n_sensors, n_actions)
        names = [[m.vars[k] for k in sorted(r)] for r in roles]
        return {"trace_id": row["trace_id"], "set_id": row["set_id"], "draw": row["draw"], "size": len(own), "loss": loss_of_roles(m, roles[2], forms, roles[0] + roles[1], ridge), "autonomy": autonomy(m, own, forms, ridge), "sensors": names[0], "actions": names[1], "internal": names[2]}

    return _by_sets(moments, _as_sets(members), "trace_id string, set_id string, draw int, size int, loss double, autonomy double, sensors array<string>, actions array<string>, internal array<string>", run)


def random_members(moments: DataFrame, members: DataFrame, draws: int = DRAWS, pool: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """For each set ``draws`` sets of its size from the trace's variables, or from its ``pool`` (trace_id, var), without replacement: (trace_id, set_id, draw, var)."""
    known = moments.select("trace_id", F.explode("vars").alias("var"))
    if pool is not None:
        known = known.join(pool.select(F.col("trace_id").cast("string").alias("trace_id"), "var").distinct(), ["trace_id", "var"])
    sizes = _as_sets(members).join(moments.select("trace_id", "vars"), "trace_id").select("trace_id", "set_id", F.size(F.array_intersect("members", "vars")).alias("size"))
    drawn = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).join(known, "trace_id")
    order = Window.partitionBy("trace_id", "set_id", "draw").orderBy(F.xxhash64(F.lit(seed), "trace_id", "set_id", "draw", "var"), "var")
    picked = drawn.withColumn("place", F.row_number().over(order)).where("place <= size")
    enough = known.groupBy("trace_id").agg(F.count(F.lit(1)).alias("known"))
    return picked.join(enough, "trace_id").where("size <= known").select("trace_id", "set_id", "draw", "var")


def _against(null: DataFrame, observed: DataFrame, keys: list[str], score: str) -> DataFrame:
    """p (share of draws at or under the observed score, one added to both) and z (population deviation, 0 without spread)."""
    rows = null.where(F.col(score).isNotNull()).join(observed.select(*keys, F.col(score).alias("seen")), keys).where("seen IS NOT NULL")
    sd = F.stddev_pop(score)
    p = (F.count_if(F.col(score) <= F.col("seen")) + 1) / (F.count(F.lit(1)) + 1)
    return rows.groupBy(*keys).agg(p.alias(f"{score}_p"), F.when(sd > 1e-12, (F.max("seen") - F.avg(score)) / sd).otherwise(0.0).alias(f"{score}_z"), F.count(F.lit(1)).alias(f"{score}_draws"))


def member_null(moments: DataFrame, members: DataFrame, draws: int = DRAWS, pool: DataFrame | None = None, seed: int = 0, **how: int) -> DataFrame:
    """Each set's loss and autonomy against random sets of its size, and whether it lies in the corner of low loss and high autonomy. Sets of under two members, or without an outside, are left out."""
    keys = ["trace_id", "set_id"]
    observed = member_scores(moments, members, **how).where("size >= 2 AND loss IS NOT NULL AND autonomy IS NOT NULL")
    observed = materialise(observed, "observed")
    null = member_scores(moments, random_members(moments, members, draws, pool, seed), **how).where("loss IS NOT NULL AND autonomy IS NOT NULL")
    null = materialise(null.select("trace_id", "set_id", "draw", "loss", "autonomy"), "null")
    found = observed.join(_against(null, observed, keys, "loss"), keys).join(_against(null, observed, keys, "autonomy").drop("autonomy_draws"), keys)
    corner = (F.col("loss_p") < 0.5) & (F.col("autonomy_p") > 0.5)
    return found.select(*keys, "size", "loss", "autonomy", "loss_p", "loss_z", "autonomy_p", "autonomy_z", F.col("loss_draws").alias("draws"), corner.alias("corner"))


def partition_null(moments: DataFrame, roles: DataFrame, draws: int = DRAWS, seed: int = 0, ridge: float = RIDGE) -> DataFrame:
    """Given roles' loss against random disjoint roles of the same sizes: (trace_id, set_id, loss, p, z, draws)."""
    observed = materialise(boundary_loss(moments, roles, ridge), "observed")
    own = roles.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("set_id").cast("string").alias("set_id"), "var", "role").distinct()
    sizes = own.groupBy("trace_id", "set_id").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("internal", "interface", "external")])
    dealt = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).join(moments.select("trace_id", F.explode("vars").alias("var")), "trace_id")
    order = Window.partitionBy("trace_id", "set_id", "draw").orderBy(F.xxhash64(F.lit(seed), "trace_id", "set_id", "draw", "var"), "var")
    placed = dealt.withColumn("place", F.row_number().over(order))
    role = F.when(F.col("place") <= F.col("n_internal"), "internal").when(F.col("place") <= F.expr("n_internal + n_interface"), "interface").when(F.col("place") <= F.expr("n_internal + n_interface + n_external"), "external")
    null = boundary_loss(moments, placed.withColumn("role", role).where("role IS NOT NULL").select("trace_id", "set_id", "draw", "var", "role"), ridge)
    keys = ["trace_id", "set_id"]
    return observed.join(_against(null, observed, keys, "loss"), keys).select(*keys, "loss", F.col("loss_p").alias("p"), F.col("loss_z").alias("z"), F.col("loss_draws").alias("draws"))


def class_members(classes: DataFrame, sets: DataFrame, least: int = 3) -> DataFrame:
    """Members of class sets in every trace with at least ``least`` of them: ``classes`` has (trace_id, var, class), ``sets`` (set_id, draw, class)."""
    own = classes.select(F.col("trace_id").cast("string").alias("trace_id"), "var", "class").where("class IS NOT NULL").distinct().join(sets.select("set_id", "draw", "class").distinct(), "class").select("trace_id", "set_id", "draw", "var").distinct()
    enough = own.groupBy("trace_id", "set_id", "draw").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    return own.join(enough, ["trace_id", "set_id", "draw"])


def class_universe(classes: DataFrame) -> DataFrame:
    """The distinct classes of all traces."""
    return classes.select("class").where("class IS NOT NULL").distinct()


def random_class_sets(classes: DataFrame, sets: DataFrame, n_sets: int = 40, seed: int = 0) -> DataFrame:
    """For each class set (set_id, class) ``n_sets`` sets of its size from all classes, without replacement: (set_id, draw, class)."""
    sizes = sets.groupBy("set_id").agg(F.count_distinct("class").alias("size")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_sets))))
    order = Window.partitionBy("set_id", "draw").orderBy(F.xxhash64(F.lit(seed), "set_id", "draw", "class"), "class")
    return sizes.join(class_universe(classes), how="cross").withColumn("place", F.row_number().over(order)).where("place <= size").select("set_id", "draw", "class")


def class_set_null(moments: DataFrame, classes: DataFrame, sets: DataFrame, n_sets: int = 40, least: int = 3, seed: int = 0, **how: int) -> DataFrame:
    """The mean loss of a class set over traces against that of random class sets of its size: (set_id, traces, loss, p, z, draws)."""
    every = sets.select("set_id", F.lit(0).alias("draw"), "class").unionByName(random_class_sets(classes, sets, n_sets, seed))
    scored = member_scores(moments, class_members(classes, every, least), **how).where("loss IS NOT NULL")
    pooled = materialise(scored.groupBy("set_id", "draw").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("traces")), "pooled")
    observed, null = pooled.where("draw = 0"), pooled.where("draw > 0").select("set_id", "draw", "loss")
    return observed.join(_against(null, observed, ["set_id"], "loss"), "set_id").select("set_id", "traces", "loss", F.col("loss_p").alias("p"), F.col("loss_z").alias("z"), F.col("loss_draws").alias("draws"))
