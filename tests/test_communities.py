"""Dendrograms against plain average linkage, and communities of planted groups."""

import numpy as np
import pytest

from mutua.operators import communities, dense, members


def partition(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in np.unique(labels)}


@pytest.mark.parametrize("seed", range(4))
def test_chains_give_average_linkage(seed):
    rng = np.random.default_rng(seed)
    n = 14
    d = rng.random((n, n))
    d = (d + d.T) / 2
    plain, found = dense.linkage(d, complete=False), communities.chain_linkage(d)
    assert [m[2] for m in found] == pytest.approx(sorted(m[2] for m in plain))
    for height in (0.2, 0.35, 0.45, 0.6):
        root = list(range(n))
        for a, b, h in found:
            if h < height:
                root = [root[a] if r == root[b] else r for r in root]
        assert partition(np.array(root)) == partition(dense.cut(plain, n, height=height))


def test_planted_groups(spark):
    rng = np.random.default_rng(5)
    drivers = rng.normal(size=(3, 400))
    columns = {f"{'abc'[k]}{i}": np.roll(drivers[k], i % 2) + 0.3 * rng.normal(size=400) for k in range(3) for i in range(4)} | {"lone": rng.normal(size=400), "flat": np.zeros(400)}
    trace = spark.createDataFrame([("x", t, v, float(y)) for v, ys in columns.items() for t, y in enumerate(ys)], "trace_id string, t long, var string, value double")
    affinity = communities.lagged_affinity(members.lagged_moments(trace))
    w = {(r.i, r.j): r.w for r in affinity.collect()}
    r = lambda u, v: abs(np.corrcoef(columns[u][:-1], columns[v][1:])[0, 1])
    assert len(w) == 14 * 13 // 2
    assert w["a0", "a1"] == pytest.approx(max(r("a0", "a1"), r("a1", "a0")), abs=1e-9) and w["a0", "flat"] == pytest.approx(0, abs=1e-6)
    tree = communities.dendrogram(affinity)
    cuts = communities.cut(tree, spark.createDataFrame([(0.6,), (0.01,), (2.0,)], "threshold double")).cache()
    found = communities.communities(cuts, least=2)
    at = {(r.threshold, tuple(r.members)) for r in found.collect()}
    linked = {tuple(m) for t, m in at if t == 0.6}
    # Variables of one driver that lag each other are linked, those without a lag between them by way of the others.
    assert all(len({v[0] for v in m}) == 1 for m in linked) and {m[0][0] for m in linked} == {"a", "b", "c"}
    assert (2.0, tuple(sorted(columns))) in at and not [m for t, m in at if t == 0.01]
    classes = spark.createDataFrame([("x", v, v[0] if v != "a3" else None) for v in columns], "trace_id string, var string, class string")
    sets = communities.class_sets(found, classes, least=2).collect()
    assert [(r.threshold, r.classes) for r in sets] == [(2.0, ["a", "b", "c", "f", "l"])]
    chosen = {r.threshold: r for r in communities.coverage(cuts, least=2, most=13).collect()}
    assert chosen[0.6].chosen and not chosen[2.0].chosen and chosen[0.01].covered == 0
    assert communities.dendrogram(affinity.limit(0)).collect() == []
