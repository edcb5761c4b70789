"""Operators against numpy and hand-made cases."""

import math

import numpy as np
import pandas as pd
import pytest

from mutua.operators import dense, directed, graph, influence, information, metrics, preprocess, segments
from mutua.sqltext import Op, _expand


def _trace(spark, columns, trace_id="a"):
    rows = [(trace_id, t, v, float(x)) for v, xs in columns.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "trace_id string, t long, var string, value double")


def _mi(a, b):
    total = 0.0
    for x in set(a):
        for y in set(b):
            p = np.mean((a == x) & (b == y))
            if p:
                total += p * math.log(p / (np.mean(a == x) * np.mean(b == y)))
    return total


def test_macros_nest_and_quote():
    assert _expand("PCT(abs(x), 0.5)", 0) == "percentile(abs(x), 0.5)"
    assert _expand("XOR(XOR(a, b), c)", 1) == "xor(xor(a, b), c)"
    assert "x" in Op("SELECT x FROM {t}").duckdb(t="SELECT 1 AS x")


def test_quantile_bins_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200).round(1)
    got = preprocess.quantile_bins(5)(trace=_trace(spark, {"x": x})).orderBy("t").toPandas()
    edges = np.quantile(x, [0.2, 0.4, 0.6, 0.8])
    assert (got.bin.to_numpy() == (x[:, None] >= edges).sum(1)).all()


def test_lag_max_mi_finds_a_delayed_copy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 400)
    y = np.concatenate([[0, 0], x[:-2]])
    bins = _trace(spark, {"x": x, "y": y}).selectExpr("trace_id", "t", "var", "cast(value as int) as bin")
    got = information.lag_max_mi(3)(bins=bins).first()
    assert math.isclose(got.mi, _mi(x[:-2], y[2:]), rel_tol=1e-9)
    per_lag = {r.lag: r.mi for r in information.lagged_mi(3)(bins=bins).where("i = 'x'").collect()}
    assert max(per_lag, key=per_lag.get) == 2


def _dense_cmi(x, y, z, alpha):
    kx, ky, kz = (len(set(v)) for v in (x, y, z))
    p = np.full((kx, ky, kz), alpha)
    ix, iy, iz = (np.unique(v, return_inverse=True)[1] for v in (x, y, z))
    np.add.at(p, (ix, iy, iz), 1)
    p /= p.sum()
    return float((p * np.log(p * p.sum((0, 1), keepdims=True) / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())


@pytest.mark.parametrize("alpha", [0.1, 0.5])
def test_smoothed_cmi_matches_the_dense_table(spark, alpha):
    rng = np.random.default_rng(2)
    z = rng.integers(0, 4, 300)
    x, y = (z + rng.integers(0, 2, 300)) % 4, rng.integers(0, 3, 300)
    rows = spark.createDataFrame([("k", int(a), int(b), int(c)) for a, b, c in zip(x, y, z)], "keys string, x int, y int, z int")
    got = information.smoothed_cmi(alpha)(observed=rows).first().cmi
    assert math.isclose(got, max(0, _dense_cmi(x, y, z, alpha)), rel_tol=1e-9)
    assert information.smoothed_cmi(alpha)(observed=rows.limit(5)).first().cmi == 0


def test_transfer_entropy_has_a_direction(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, 4000)
    y = np.concatenate([[0], x[:-1] ^ (rng.random(3999) < 0.1)])
    binary = _trace(spark, {"x": x, "y": y}).selectExpr("trace_id", "t", "var", "cast(value as int) as x")
    te = {r.pair: r.te for r in information.transfer_entropy()(binary=binary).collect()}
    h = -(0.1 * math.log(0.1) + 0.9 * math.log(0.9))
    assert abs(te["a|x|y"] - (math.log(2) - h)) < 0.03 and te["a|y|x"] < 0.01
    roles = spark.createDataFrame([("x", 0), ("y", -1)], "var string, agent int")
    scores = {r["var"]: r for r in directed.PAIRWISE_SCORES(transfer=information.transfer_entropy()(binary=binary), variables=roles).collect()}
    assert math.isclose(scores["x"].out_env, te["a|x|y"]) and math.isclose(scores["y"].push_in, te["a|x|y"])


def test_preparation(spark):
    trace = _trace(spark, {"x": [1, 2, 4, 7], "c": [5, 5, 5, 5]})
    assert [r.var for r in preprocess.ACTIVE(trace=trace).collect()] == ["x"]
    shifted = preprocess.edge_shift(2)(trace=trace).where("var = 'x'").orderBy("t").toPandas().value.tolist()
    assert shifted == [1, 1, 1, 2]
    z = preprocess.ZSCORE(trace=trace).where("var = 'c'").toPandas().z
    assert (z == 0).all()
    samples = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 4.0, 40.0)], "trace_id string, clock double, value double")
    got = preprocess.RESAMPLE_UNIFORM(samples=samples).orderBy("t").toPandas().value.tolist()
    assert np.allclose(got, np.interp([0, 2, 4], [0, 1, 4], [0, 10, 40]))


def test_runs_and_segments(spark):
    active = [0, 1, 1, 0, 1, 0, 1, 1, 1]
    mask = spark.createDataFrame([("a", t, bool(v)) for t, v in enumerate(active)], "trace_id string, t long, active boolean")
    got = sorted((r.start_t, r.end_t) for r in segments.active_runs(2)(mask=mask).collect())
    assert got == [(1, 3), (6, 9)]


def test_auroc_with_ties(spark):
    rows = [("g", 1.0, True), ("g", 1.0, False), ("g", 0.5, False), ("g", 2.0, True), ("h", 1.0, True)]
    got = {r.grp: r.auroc for r in influence.AUROC(scored=spark.createDataFrame(rows, "grp string, score double, label boolean")).collect()}
    assert got["g"] == 0.875 and got["h"] is None


def test_adjusted_rand_and_fisher(spark):
    same = spark.createDataFrame([("g", k % 3, k % 3) for k in range(30)], "grp string, a int, b int")
    assert metrics.ADJUSTED_RAND(labelled=same).first().ari == 1
    tests = spark.createDataFrame([("g", 0.1, 1.0), ("g", 0.2, 2.0)], "grp string, p double, z double")
    half = -math.log(0.1) - math.log(0.2)
    assert math.isclose(metrics.FISHER_POOL(tests=tests).first().combined_p, math.exp(-half) * (1 + half), rel_tol=1e-9)


def test_surrogates_keep_values(spark):
    trace = _trace(spark, {"x": range(50), "y": range(50, 100)})
    turned = influence.circular_shift(2)(trace=trace).toPandas()
    for _, g in turned.groupby(["perm", "var"]):
        assert sorted(g.t) == list(range(50)) and len(set(g.value)) == 50
    phased = dense.phase_surrogate(trace).toPandas()
    x = phased[phased["var"] == "x"].sort_values("t").value
    assert np.allclose(np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(np.arange(50.0))))


def test_linkage_and_cuts():
    points = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])
    d = np.abs(points[:, None] - points[None])
    for complete in (True, False):
        merges = dense.linkage(d, complete)
        assert dense.cut(merges, 6, clusters=3).tolist() == [0, 0, 0, 1, 1, 2]
        assert dense.cut(merges, 6, height=1.0).tolist() == [0, 0, 0, 1, 1, 2]
    assert dense.linkage(np.zeros((1, 1))) == []


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for _ in range(20):
        w = rng.integers(0, 9, (4, 5)).astype(float)
        best = max(sum(w[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        a = dense.assign(w)
        assert len(set(a.tolist())) == 4 and w[np.arange(4), a].sum() == best


def test_gaussian_information(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=2000)
    y = x + rng.normal(size=2000)
    got = dense.block_information(dense.moments(_trace(spark, {"x": x, "y": y}))).toPandas().set_index("var")
    r = np.corrcoef(x, y)[0, 1]
    assert abs(got.with_all["x"] + 0.5 * math.log(1 - r * r)) < 1e-4


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(500, 500)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: root(i) for i in parent}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_counters_saturate(spark):
    rows = [("a", t, "x", int(v)) for t, v in enumerate([1, 1, 1, 0, 0, 0, 0, 1])]
    got = dense.saturating_counters(spark.createDataFrame(rows, "trace_id string, t long, var string, x int"), 2).orderBy("t").toPandas()
    assert got.counter.tolist() == [1, 2, 2, 1, 0, 0, 0, 1]
    assert isinstance(got, pd.DataFrame)


def test_chi_square_tail_and_independence(spark):
    from mutua.operators import independence

    for x, dof, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (16.918977604620448, 9, 0.05)):
        assert math.isclose(independence.chi_square_tail(x, dof), p, rel_tol=1e-9)
    rng = np.random.default_rng(7)
    rows = [("free", int(a), int(b), int(c)) for a, b, c in rng.integers(0, 3, (900, 3))] + [("tied", int(a), int(a), int(c)) for a, c in rng.integers(0, 3, (300, 2))]
    got = {r["keys"]: r.p for r in independence.conditional_independence(spark.createDataFrame(rows, "keys string, x int, y int, z int")).collect()}
    assert got["free"] > 0.01 and got["tied"] < 1e-9
    two = spark.createDataFrame([("k", a, b, 0) for a, b, n in ((0, 0, 10), (0, 1, 20), (1, 0, 30), (1, 1, 40)) for _ in range(n)], "keys string, x int, y int, z int")
    assert math.isclose(independence.CHI_SQUARE(observed=two).first().chi2, 0.4464285714285714, rel_tol=1e-9)


def test_cross_validated_fit(spark):
    from mutua.operators import independence

    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    rows = [("fit", k, float(v), float(2 * v + 1 + 0.1 * e)) for k, (v, e) in enumerate(zip(x, rng.normal(size=400)))] + [("noise", k, float(v), float(e)) for k, (v, e) in enumerate(rng.normal(size=(400, 2)))]
    got = {r.grp: r.r2 for r in independence.cross_validated_r2(spark.createDataFrame(rows, "g string, k long, x double, y double"), "y", ["x"], "g", "k").collect()}
    assert got["fit"] > 0.99 and abs(got["noise"]) < 0.1
