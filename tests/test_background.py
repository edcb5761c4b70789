"""Background removal against a plain singular value decomposition."""

import numpy as np
import pytest

from mutua.operators import background


def _frame(spark, traces):
    rows = [(name, t, f"v{j:02d}", float(x)) for name, m in traces.items() for t, row in enumerate(m) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "trace_id string, t long, var string, value double")


def _matrix(rows, name, shape):
    out = np.zeros(shape)
    for r in rows:
        if r.trace_id == name:
            out[r.t, int(r.var[1:])] = r.value
    return out


def _plain(m, k):
    mean = m.mean(0)
    u, s, v = np.linalg.svd(m - mean, full_matrices=False)
    return m - (u[:, :k] * s[:k]) @ v[:k], (s[:k] ** 2).sum() / (s**2).sum()


@pytest.mark.parametrize("components", [1, 2])
def test_narrow_traces_are_exact(spark, components):
    rng = np.random.default_rng(0)
    t = np.arange(400)
    planted = np.sin(0.02 * t)[:, None] * np.array([1.0, 0.9, 0.85, 0.1]) + 0.2 * rng.normal(size=(400, 4))
    traces = {"a": planted, "b": rng.normal(size=(50, 6)) @ rng.normal(size=(6, 6)) + 100}
    got = background.remove_background(_frame(spark, traces), components).collect()
    for name, m in traces.items():
        want, share = _plain(m, components)
        assert np.allclose(_matrix(got, name, m.shape), want, atol=1e-8)
        assert {round(r.share, 9) for r in got if r.trace_id == name} == {round(share, 9)}
    if components == 1:
        assert next(r.share for r in got if r.trace_id == "a") > 0.5
        left = _matrix(got, "a", planted.shape)
        assert left[:, 0].var() < 0.5 * planted[:, 0].var()


def test_wide_trace_by_passes(spark):
    rng = np.random.default_rng(1)
    m = np.outer(np.cumsum(rng.normal(size=120)), rng.normal(size=40)) + rng.normal(size=(120, 40))
    got = background.remove_background(_frame(spark, {"w": m}), 1).collect()
    want, share = _plain(m, 1)
    assert np.allclose(_matrix(got, "w", m.shape), want, atol=1e-6)
    assert got[0].share == pytest.approx(share, abs=1e-9)


def test_defined_cases(spark):
    still = np.full((5, 3), 2.0)
    got = background.remove_background(_frame(spark, {"still": still, "one": np.array([[1.0, 5.0]])}), 1).collect()
    assert {(r.trace_id, round(r.value, 9), r.share) for r in got} == {("still", 2.0, 0.0), ("one", 1.0, 0.0), ("one", 5.0, 0.0)}
    empty = _frame(spark, {"x": np.zeros((1, 1))}).limit(0)
    assert background.remove_background(empty, 1).collect() == []
    some = _frame(spark, {"x": np.arange(6.0).reshape(3, 2)})
    assert sorted(r.value for r in background.remove_background(some, 0).collect()) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("components", [1, 2])
def test_traces_of_few_ticks_are_exact_without_passes(spark, components):
    """Noise has no gap between its components, so passes would leave an error; a trace of many ticks lies beside short ones, and some values are missing."""
    rng = np.random.default_rng(4)
    traces = {"noise": rng.normal(size=(12, 150)) + 50, "other": rng.normal(size=(20, 30)) * 3, "still": np.full((3, 9), 2.0), "one": np.arange(1.0, 4.0).reshape(1, 3), "long": np.cumsum(rng.normal(size=(60, 4)), 0)}
    frame = _frame(spark, traces).where("not (trace_id = 'noise' and t = 3 and var < 'v04')")
    got = background.remove_background(frame, components, passes=1).collect()
    assert len(got) == sum(m.size for m in traces.values()) - 4
    for name, m in traces.items():
        filled, missing = m.copy(), np.zeros(m.shape, bool)
        if name == "noise":
            missing[3, :4] = True
            filled[3, :4] = np.delete(m, 3, 0)[:, :4].mean(0)
        want, share = _plain(filled, components) if name not in ("still", "one") else (m, 0.0)
        found = _matrix(got, name, m.shape)
        assert np.allclose(found[~missing], want[~missing], atol=1e-9)
        assert {round(r.share, 9) for r in got if r.trace_id == name} == {round(share, 9)}


def test_the_trace_of_parts_is_dealt_over_tasks(spark, sf_dir):
    """Its variables are one trace's, and no exchange of its values is by the trace alone."""
    from mutua.plans import registry

    left = registry.queries()["background_of_parts"](spark, sf_dir)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(trace_id" not in plan
