"""The detector end to end: bins, lag-max information, clusters at every k, roles, boundary tests, choice of k.

All traces and all numbers of clusters run as one job: each (trace, k) is a trace of its
own for the role and boundary operators. The number of variables bounds what a task
holds; ticks only meet grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutua.operators import dense, grouping, information, preprocess, roles
from mutua.storage import materialise


def _by_k(table: DataFrame, cuts: DataFrame) -> DataFrame:
    """``table`` once for each k of its trace, with trace and k as the trace's name."""
    ks = cuts.select("trace_id", "k").distinct()
    return table.join(ks, "trace_id").withColumn("trace_id", F.concat_ws("#", "trace_id", "k")).drop("k")


def detect(trace: DataFrame, bins: int = 4, max_lag: int = 3, most: int = 8, weak: float = 0.5, tolerance: float = 0.1) -> DataFrame:
    """One row per trace, k and cluster: members, roles, violation and whether it is valid (null: not tested).

    Variables without variance are left out; clusters of one variable are never tested.
    """
    active = trace.join(preprocess.ACTIVE(trace=trace).select("trace_id", "var"), ["trace_id", "var"], "left_semi")
    binned = materialise(preprocess.quantile_bins(bins)(trace=active.select("trace_id", "t", "var", "value")), "bins")
    similarity = materialise(information.lag_max_mi(max_lag)(bins=binned).withColumnRenamed("mi", "w"), "similarity")
    cuts = materialise(dense.cluster_variables(information.SIMILARITY_DISTANCE(similarity=similarity), most), "cuts")
    labels = cuts.select(F.concat_ws("#", "trace_id", "k").alias("trace_id"), "var", "cluster")
    pruned = grouping.weak_members(weak)(similarity=_by_k(similarity, cuts), labels=labels).where("not weak").select("trace_id", "var", "cluster")
    pruned = materialise(pruned, "members")
    per_k = materialise(_by_k(binned, cuts), "bins-by-k")
    role_table = materialise(roles.classify_roles()(bins=per_k, labels=pruned), "roles")
    tests = roles.blanket_test(tolerance)(states=per_k, roles=role_table)
    members = role_table.groupBy("trace_id", "cluster").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("var")))).alias(name) for r, name in (("S", "sensors"), ("A", "actions"), ("I", "internal"))]
    )
    name = F.split("trace_id", "#")
    out = members.join(tests, ["trace_id", "cluster"])
    return out.select(F.get(name, F.lit(0)).alias("trace_id"), F.get(name, F.lit(1)).cast("int").alias("k"), F.col("cluster").cast("string").alias("label"), "sensors", "actions", "internal", "violation", "valid")


def choose_k(detected: DataFrame, least_rate: float = 0.7) -> DataFrame:
    """For each trace the largest k with a valid cluster and enough of them valid, else the k with the most valid ones, by rate and then the larger k."""
    rates = detected.groupBy("trace_id", "k").agg(F.count_if(F.coalesce("valid", F.lit(True))).alias("n_valid"), F.avg(F.coalesce("valid", F.lit(True)).cast("int")).alias("rate"))
    good = (F.col("n_valid") > 0) & (F.col("rate") >= least_rate)
    best = rates.groupBy("trace_id").agg(F.max_by(F.struct("k", "n_valid", "rate"), F.struct(good.cast("int"), F.when(good, F.col("k")).otherwise(F.col("n_valid")), F.col("rate"), F.col("k"))).alias("b"))
    return best.select("trace_id", "b.k", "b.n_valid", "b.rate")


def peel(trace: DataFrame, passes: int = 2, **settings: object) -> DataFrame:
    """Find a cluster in each trace, take its variables out, and look again: one row per trace and pass.

    A pass takes, at the chosen k, the valid tested cluster of the least violation. Peeled variables are left
    out of later passes altogether. A trace without such a cluster, or with too few variables left, ends.
    """
    left, found = trace, None
    for k in range(1, passes + 1):
        detected = materialise(detect(left, **settings), "detected")
        best = detected.join(choose_k(detected).select("trace_id", "k"), ["trace_id", "k"], "left_semi").where("valid")
        best = best.groupBy("trace_id").agg(F.min_by(F.struct("k", "label", "sensors", "actions", "internal", "violation"), F.struct("violation", "label")).alias("c"))
        taken = materialise(best.select("trace_id", F.lit(k).alias("pass"), "c.*"), "peeled")
        found = taken if found is None else found.unionByName(taken)
        gone = taken.select("trace_id", F.explode(F.concat("sensors", "actions", "internal")).alias("var"))
        left = materialise(left.join(taken.select("trace_id"), "trace_id", "left_semi").join(gone, ["trace_id", "var"], "left_anti").select("trace_id", "t", "var", "value"), "unpeeled")
    return found
