"""Grown keys and block scores against plain counting, and a parity that only keys reveal."""

import numpy as np
import pytest

from mutua.operators import keys


def plain_flow(x, y, zs, alpha=0.1):
    """I(y later; x | y, zs), smoothed over all cells of the joint table of labels that occur."""
    dense = lambda *c: np.unique(np.stack(c, 1), axis=0, return_inverse=True)[1].ravel()
    a, b, c = dense(y[1:]), dense(x[:-1]), dense(y[:-1], *[z[:-1] for z in zs])
    table = np.zeros((a.max() + 1, b.max() + 1, c.max() + 1))
    np.add.at(table, (a, b, c), 1)
    total = table.sum() + alpha * table.size
    p = (table + alpha) / total
    return max(0.0, float((p * np.log(p * p.sum((0, 1)) / (p.sum(1)[:, None] * p.sum(0)[None]))).sum()))


def majority(seed=13, n=6000):
    """The next A is the majority of B1, B2 and G, E follows A, G is slow."""
    rng = np.random.default_rng(seed)
    b1, b2 = rng.integers(0, 2, (2, n))
    g = np.cumsum(rng.random(n) < 0.015) % 2
    a = np.concatenate([[0], ((b1 + b2 + g)[:-1] >= 2) ^ (rng.random(n - 1) < 0.04)]).astype(int)
    e = np.concatenate([[0], np.cumsum(a[:-1] ^ (rng.random(n - 1) < 0.03)) % 2])
    return {"A": a, "B1": b1, "B2": b2, "E": e, "G": g}


def parity(seed=21, n=8000):
    by = majority(seed, n)
    rng = np.random.default_rng(seed + 1)
    a = np.concatenate([[0], (by["B1"] ^ by["B2"] ^ by["G"])[:-1] ^ (rng.random(n - 1) < 0.04)]).astype(int)
    e = np.concatenate([[0], np.cumsum(a[:-1] ^ (rng.random(n - 1) < 0.03)) % 2])
    return {**by, "A": a, "E": e}


def frame(spark, traces):
    rows = [(name, t, v, int(x)) for name, by in traces.items() for v, xs in by.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "trace_id string, t long, var string, x int")


def test_grown_keys(spark):
    by = majority()
    got = {(r.src.var, r.dst.var): r for r in keys.grown_flows(keys.variable_labels(frame(spark, {"m": by}))).collect()}
    assert len(got) == 20
    for (s, d), r in got.items():
        best = plain = plain_flow(by[s], by[d], [])
        chosen = []
        for _ in range(2):
            tried = {k: plain_flow(by[s], by[d], [by[c] for c in [*chosen, k]]) for k in sorted(by) if k not in (s, d, *chosen)}
            chosen.append(max(tried, key=tried.get))
            best = max(best, tried[chosen[-1]])
        assert (r.plain, r.best) == pytest.approx((plain, best), abs=1e-9)
        assert [k.var for k in r["keys"]] == chosen
    one = max(plain_flow(by["G"], by["A"], [by[k]]) for k in ("B1", "B2", "E"))
    assert got["G", "A"].best > one + 0.05  # the second key earns its place
    fused = spark.createDataFrame([("m", v, 0.01) for v in by], "trace_id string, var string, push_in double")
    scores = {r["var"]: r for r in keys.grown_scores(keys.grown_flows(keys.variable_labels(frame(spark, {"m": by}))), fused, "E").collect()}
    assert scores["G"].out_sys == pytest.approx(sum(got["G", d].best for d in by if d != "G")) and scores["E"].out_env is None
    assert scores["G"].out_env == pytest.approx(got["G", "E"].best)


def joint(*columns):
    return np.unique(np.stack(columns, 1), axis=0, return_inverse=True)[1].ravel()


@pytest.mark.parametrize("architecture", ["keyring", "menu"])
def test_blocks_reveal_a_parity(spark, architecture):
    by = parity()
    block = ("A", "B1", "B2", "G")
    blocks = spark.createDataFrame([("p", v, "one") for v in block] + [("p", "E", None)], "trace_id string, var string, block string")
    got = {r["var"]: r for r in keys.block_scores(frame(spark, {"p": by}), blocks, architecture, "E").collect()}
    assert set(got) == set(by)
    own = {v: joint(*[by[c] for c in block if c != v]) for v in block}
    for v in block:
        targets = [own[v], by["E"]]
        if architecture == "keyring":
            into = plain_flow(own[v], by[v], []) + plain_flow(by["E"], by[v], [own[v]])
            out = plain_flow(by[v], own[v], []) + max(plain_flow(by[v], by["E"], []), plain_flow(by[v], by["E"], [own[v]]))
        else:
            into = sum(plain_flow(x, by[v], []) for x in targets)
            out = sum(max(plain_flow(by[v], x, []), plain_flow(by[v], x, [z])) for x, z in (targets, targets[::-1]))
        assert (got[v].push_in, got[v].out_sys) == pytest.approx((into, out), abs=1e-9)
    whole = joint(*[by[c] for c in block])
    assert got["E"].push_in == pytest.approx(plain_flow(whole, by["E"], []), abs=1e-9) and got["E"].out_env is None
    assert got["G"].out_sys > 0.25 and got["G"].polarity > 0.9 and got["G"].polarity > got["A"].polarity
    assert plain_flow(by["G"], by["A"], []) < 0.03  # without keys there is nothing to see


def test_budget_and_empty(spark):
    by = parity(n=500)
    blocks = spark.createDataFrame([("p", v, "one") for v in by], "trace_id string, var string, block string")
    labels = keys.block_labels(frame(spark, {"p": by}), blocks, budget=4).where("element.block IS NOT NULL AND element.var IS NULL").groupBy("label").count().collect()
    assert {r.label for r in labels} == {0, 1, 2, 3} and sum(r["count"] for r in labels) == 500
    none = frame(spark, {"p": {"A": [0]}}).limit(0)
    assert keys.grown_flows(keys.variable_labels(none)).collect() == []
    with pytest.raises(ValueError):
        keys.block_scores(none, blocks, "other")
