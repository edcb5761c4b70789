"""Communities of variables by lagged affinity: one dendrogram a trace, kept as a table, cut anywhere by a join.

Affinity is the larger size of two variables' correlations over ``lag`` ticks, either way, from lagged moment tables. Linkage is by
nearest-neighbour chains, in time and space of the pairs; a task holds one trace's pairs. The dendrogram lists for
every variable all nodes above it, so that a cut at any threshold is the last node below it.

Ties go to the first pair by name. A trace of one variable has one node. Pairs that are missing, or null (a variable without spread), have no affinity. Empty inputs give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutua.operators import members

#: A link's distance, and the sizes of a community.
DISTANCE, LEAST_SIZE, MOST_SIZE, LEAST_CLASSES = 0.6, 3, 30, 3


def lagged_affinity(moments: DataFrame) -> DataFrame:
    """(trace_id, i, j, w) of pairs i < j."""
    cov = members.lagged_covariances(moments)
    own = cov.where("i = j").select("trace_id", "i", F.sqrt("past").alias("before"), F.sqrt("next").alias("after"))
    pairs = cov.where("i <> j").join(own.select("trace_id", "i", "before"), ["trace_id", "i"]).join(own.select("trace_id", F.col("i").alias("j"), "after"), ["trace_id", "j"])
    r = F.abs(F.col("cross") / ((F.col("before") + 1e-12) * (F.col("after") + 1e-12)))
    return pairs.select("trace_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), r.alias("r")).groupBy("trace_id", "i", "j").agg(F.max("r").alias("w"))


def chain_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of average linkage by rising height, as (leaf of one side, leaf of the other, height)."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    n, sizes, chain, merges = len(d), np.ones(len(d)), [], []
    alive = np.ones(n, bool)
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            top = chain[-1]
            near = int(np.argmin(d[top]))
            if len(chain) > 1 and d[top, chain[-2]] <= d[top, near]:
                break
            chain.append(near)
        a, b = sorted(chain[-2:])
        del chain[-2:]
        merges.append((a, b, float(d[a, b])))
        joined = (sizes[a] * d[a] + sizes[b] * d[b]) / (sizes[a] + sizes[b])
        joined[a] = np.inf
        joined[~alive] = np.inf
        d[a], d[:, a] = joined, joined
        d[b], d[:, b] = np.inf, np.inf
        sizes[a] += sizes[b]
        alive[b] = False
    return sorted(merges, key=lambda m: m[2])


def dendrogram(affinity: DataFrame) -> DataFrame:
    """(trace_id, var, node, height, size): every node above each variable, itself at height -1; nodes are numbered upwards."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pairs["i"]) | set(pairs["j"]))
        at = {v: k for k, v in enumerate(names)}
        d = np.ones((len(names), len(names)))
        i, j, w = pairs["i"].map(at).to_numpy(), pairs["j"].map(at).to_numpy(), pairs["w"].fillna(0).to_numpy(float)
        d[i, j] = d[j, i] = 1 - w
        group = [[k] for k in range(len(names))]
        of = list(range(len(names)))
        rows = [(names[k], k, -1.0, 1) for k in range(len(names))]
        for step, (a, b, height) in enumerate(chain_linkage(d)):
            one, two = of[a], of[b]
            group[one] += group[two]
            for k in group[two]:
                of[k] = one
            rows += [(names[k], len(names) + step, height, len(group[one])) for k in group[one]]
        return pd.DataFrame(rows, columns=["var", "node", "height", "size"]).assign(trace_id=pairs["trace_id"].iloc[0])[["trace_id", "var", "node", "height", "size"]]

    return affinity.groupBy("trace_id").applyInPandas(run, "trace_id string, var string, node int, height double, size int")


def cut(tree: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(trace_id, threshold, var, node, size): each variable's last node below each ``threshold``."""
    below = tree.join(thresholds, F.col("height") < F.col("threshold"))
    return below.groupBy("trace_id", "threshold", "var").agg(F.max(F.struct("node", "size")).alias("last")).select("trace_id", "threshold", "var", "last.node", "last.size")


def communities(cuts: DataFrame, least: int = LEAST_SIZE, most: int = MOST_SIZE) -> DataFrame:
    """(trace_id, threshold, node, members) of the nodes of a cut that are neither small nor giant."""
    kept = cuts.where(f"size BETWEEN {least} AND {most}")
    return kept.groupBy("trace_id", "threshold", "node").agg(F.array_sort(F.collect_list("var")).alias("members"))


def class_sets(found: DataFrame, classes: DataFrame, least: int = LEAST_CLASSES) -> DataFrame:
    """(trace_id, threshold, classes): each community's known classes, sets of at least ``least``, each once a trace. ``classes`` has (trace_id, var, class)."""
    named = found.select("trace_id", "threshold", "node", F.explode("members").alias("var")).join(classes.where("class IS NOT NULL"), ["trace_id", "var"])
    sets = named.groupBy("trace_id", "threshold", "node").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return sets.where(F.size("classes") >= least).select("trace_id", "threshold", "classes").distinct()


def coverage(cuts: DataFrame, least: int = LEAST_SIZE, most: int = MOST_SIZE) -> DataFrame:
    """(trace_id, threshold, n, covered, chosen): communities and variables in them at each threshold; chosen is the one that covers most, then has fewer communities, then is lower."""
    known = cuts.select("trace_id", "threshold").distinct()
    kept = cuts.where(f"size BETWEEN {least} AND {most}").groupBy("trace_id", "threshold").agg(F.count_distinct("node").alias("n"), F.count(F.lit(1)).alias("covered"))
    rows = known.join(kept, ["trace_id", "threshold"], "left").fillna(0, ["n", "covered"])
    best = rows.groupBy("trace_id").agg(F.max(F.struct("covered", (-F.col("n")).alias("few"), (-F.col("threshold")).alias("low"))).alias("best"))
    return rows.join(best, "trace_id").select("trace_id", "threshold", "n", "covered", (F.col("threshold") == -F.col("best.low")).alias("chosen"))
