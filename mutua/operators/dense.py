"""Operators on the dense matrix of one trace: small linear algebra inside grouped pandas functions.

Spark deals traces over tasks; a group is one trace's pair table or moment table, whose size
depends on the number of variables, never on the number of ticks. Ticks are reduced
to moments by an aggregate first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linkage(distance: np.ndarray, complete: bool = True) -> list[tuple[int, int, float, int]]:
    """Merges of agglomerative clustering as (a, b, height, new id); ties go to the smallest pair."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, sizes, merges = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        a, b = divmod(int(np.argmin(d)), n)
        a, b = min(a, b), max(a, b)
        height = float(d[a, b])
        merges.append((ids[a], ids[b], height, n + step))
        joined = np.maximum(d[a], d[b]) if complete else (sizes[a] * d[a] + sizes[b] * d[b]) / (sizes[a] + sizes[b])
        joined[~np.isfinite(d[a]) | ~np.isfinite(d[b])] = np.inf
        d[a], d[:, a] = joined, joined
        d[b], d[:, b] = np.inf, np.inf
        d[a, a] = np.inf
        ids[a], sizes[a] = n + step, sizes[a] + sizes[b]
    return merges


def cut(merges: list[tuple[int, int, float, int]], n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels 0.. by first member, at a number of clusters or below a height."""
    used = merges[: max(0, n - clusters)] if clusters is not None else [m for m in merges if m[2] <= height]
    parent = {i: i for i in range(2 * n)}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _, new in used:
        parent[root(a)], parent[root(b)] = new, new
    numbers: dict[int, int] = {}
    return np.array([numbers.setdefault(root(i), len(numbers)) for i in range(n)])


def _matrix(pairs: pd.DataFrame, value: str) -> tuple[list[str], np.ndarray]:
    names = sorted(set(pairs["i"]) | set(pairs["j"]))
    at = {v: k for k, v in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    i, j = pairs["i"].map(at).to_numpy(), pairs["j"].map(at).to_numpy()
    m[i, j] = m[j, i] = pairs[value].to_numpy()
    return names, m


def cluster_variables(distances: DataFrame, most: int = 8, complete: bool = True) -> DataFrame:
    """Labels of every variable at every number of clusters up to ``most``, from one linkage per trace of (trace_id, i, j, distance)."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pairs, "distance")
        merges = linkage(d, complete)
        rows = [(pairs["trace_id"].iloc[0], k, v, int(c)) for k in range(1, min(most, len(names)) + 1) for v, c in zip(names, cut(merges, len(names), k))]
        return pd.DataFrame(rows, columns=["trace_id", "k", "var", "cluster"])

    return distances.groupBy("trace_id").applyInPandas(run, "trace_id string, k int, var string, cluster int")


def moments(trace: DataFrame) -> DataFrame:
    """Covariances (trace_id, i, j, cov, n) of all pairs of variables with i <= j, ddof 1, by one equi-join on ticks."""
    a = trace.select("trace_id", "t", F.col("var").alias("i"), F.col("value").alias("x"))
    b = trace.select("trace_id", "t", F.col("var").alias("j"), F.col("value").alias("y"))
    return a.join(b, ["trace_id", "t"]).where("i <= j").groupBy("trace_id", "i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.count(F.lit(1)).alias("n"))


def gaussian_information(cov: np.ndarray, x: list[int], y: list[int], z: list[int], ridge: float = 1e-6) -> float:
    """I(x; y | z) of a Gaussian with this covariance, standardised first, never below 0."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    c = cov / np.outer(sd, sd) + ridge * np.eye(len(cov))
    det = lambda k: np.linalg.slogdet(c[np.ix_(k, k)])[1] if k else 0.0
    return max(0.0, 0.5 * (det(x + z) + det(y + z) - det(z) - det(x + y + z)))


def block_information(moment_table: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """For each variable, its Gaussian information with all others, and with the next in name given the rest."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        names, c = _matrix(pairs, "cov")
        n = len(names)
        rows = []
        for k, v in enumerate(names):
            rest = [m for m in range(n) if m != k]
            other = (k + 1) % n
            given = [m for m in rest if m != other]
            rows.append((pairs["trace_id"].iloc[0], v, gaussian_information(c, [k], rest, [], ridge), gaussian_information(c, [k], [other], given, ridge) if n > 1 else 0.0))
        return pd.DataFrame(rows, columns=["trace_id", "var", "with_all", "with_next"])

    return moment_table.groupBy("trace_id").applyInPandas(run, "trace_id string, var string, with_all double, with_next double")


def principal_components(moment_table: DataFrame, components: int = 2) -> DataFrame:
    """Variance share and loadings of the leading components; the largest loading of each is positive."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        names, c = _matrix(pairs, "cov")
        values, vectors = np.linalg.eigh(c)
        rows = []
        for k in range(min(components, len(names))):
            v = vectors[:, -1 - k]
            v = v * np.sign(v[np.argmax(np.abs(v))] or 1)
            rows += [(pairs["trace_id"].iloc[0], k, float(values[-1 - k] / max(values.sum(), 1e-12)), name, float(x)) for name, x in zip(names, v)]
        return pd.DataFrame(rows, columns=["trace_id", "component", "share", "var", "loading"])

    return moment_table.groupBy("trace_id").applyInPandas(run, "trace_id string, component int, share double, var string, loading double")


def assign(weight: np.ndarray) -> np.ndarray:
    """Column of each row so that the total weight is largest, one to one (rows at most columns): successive shortest paths."""
    n, m = weight.shape
    cost = weight.max(initial=0) - weight
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            seen[j0] = True
            i0 = match[j0]
            free = ~seen[1:]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[j1]
            u[match[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.empty(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def match_clusters(counts: DataFrame) -> DataFrame:
    """One-to-one matching of clusters a with groups b of (grp, a, b, n) that shares most rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="a", columns="b", values="n", aggfunc="sum", fill_value=0)
        flip = table.shape[0] > table.shape[1]
        w = table.to_numpy(float).T if flip else table.to_numpy(float)
        found = [(k, int(c)) for k, c in enumerate(assign(w))]
        pairs = [(c, k) for k, c in found] if flip else found
        return pd.DataFrame([(rows["grp"].iloc[0], int(table.index[a]), int(table.columns[b]), int(table.iat[a, b])) for a, b in pairs], columns=["grp", "a", "b", "n"])

    return counts.groupBy("grp").applyInPandas(run, "grp string, a long, b long, n long")


def phase_surrogate(trace: DataFrame, seed: int = 1) -> DataFrame:
    """Each series with its spectrum kept and its phases drawn anew (those of the mean and of an even length's middle are kept)."""

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("t")
        x = series["value"].to_numpy()
        rng = np.random.default_rng([seed, *map(ord, f"{series['trace_id'].iloc[0]}|{series['var'].iloc[0]}")])
        f = np.fft.rfft(x)
        turn = np.exp(2j * np.pi * rng.random(len(f)))
        turn[0] = 1
        if len(x) % 2 == 0:
            turn[-1] = 1
        return series.assign(value=np.fft.irfft(f * turn, len(x)))

    return trace.groupBy("trace_id", "var").applyInPandas(run, trace.schema)


def transition_surrogate(steps: DataFrame, seed: int = 1) -> DataFrame:
    """A path for each group drawn from its own smoothed first-order transitions, as long as the group's (grp, k, state)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        names, codes = np.unique(rows["state"].to_numpy(str), return_inverse=True)
        counts = np.full((len(names), len(names)), 0.5)
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
        edges = np.cumsum(counts / counts.sum(1, keepdims=True), 1)
        draws = np.random.default_rng([seed, *map(ord, str(rows["grp"].iloc[0]))]).random(len(codes))
        path = np.empty(len(codes), int)
        path[0] = codes[0]
        for k in range(1, len(codes)):
            path[k] = min(np.searchsorted(edges[path[k - 1]], draws[k], "right"), len(names) - 1)
        return rows.assign(state=names[path])

    return steps.groupBy("grp").applyInPandas(run, steps.schema)


def saturating_counters(binary: DataFrame, most: int = 6) -> DataFrame:
    """A counter for each series that goes up with ones and down with zeros, held between 0 and ``most``; (trace_id, t, var, x)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        now = 0
        for rows in batches:
            out = np.empty(len(rows), int)
            for k, (trace, var, x) in enumerate(zip(rows["trace_id"], rows["var"], rows["x"])):
                if (trace, var) != held:
                    held, now = (trace, var), 0
                now = min(most, max(0, now + (1 if x else -1)))
                out[k] = now
            yield rows.assign(counter=out)

    ordered = binary.repartition("trace_id", "var").sortWithinPartitions("trace_id", "var", "t")
    return ordered.mapInPandas(run, binary.schema.simpleString()[7:-1].replace(":", " ") + ", counter int")
