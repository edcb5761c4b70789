"""Set scores from moments against plain computations on the ticks themselves, and planted systems."""

import numpy as np
import pytest

from mutua.operators import members

NAMES = ["ia", "ib", "sense", "act", "e0", "e1"] + [f"bg{k}" for k in range(6)]


def planted(seed, ticks=2500):
    """Two internal variables that meet two outside ones only through a sensor and an action; six others follow one slow latent."""
    rng = np.random.default_rng(seed)
    step = np.zeros((6, 6))
    step[0, [0, 2]] = step[1, [1, 2]] = step[4, [4, 3]] = step[5, [5, 3]] = 0.6, 0.25
    x = np.zeros((ticks, 6))
    for t in range(ticks):
        if t:
            x[t, [0, 1, 4, 5]] = (step @ x[t - 1])[[0, 1, 4, 5]] + 0.3 * rng.normal(size=4)
        x[t, 2] = 0.5 * (x[t, 4] + x[t, 5]) + 0.3 * rng.normal()
        x[t, 3] = 0.35 * (x[t, 0] + x[t, 1]) + 0.3 * rng.normal()
    slow = np.zeros(ticks)
    for t in range(1, ticks):
        slow[t] = 0.8 * slow[t - 1] + rng.normal()
    return np.column_stack([x, slow[:, None] + 0.5 * rng.normal(size=(ticks, 6))])


def frame(spark, traces, names=NAMES):
    rows = [(name, t, v, float(x)) for name, m in traces.items() for t, row in enumerate(m) for v, x in zip(names, row)]
    return spark.createDataFrame(rows, "trace_id string, t long, var string, value double")


def plain_information(x, y, z):
    def det(*blocks):
        blocks = [b for b in blocks if b.shape[1]]
        if not blocks:
            return 0.0
        m = np.hstack(blocks)
        m = (m - m.mean(0)) / m.std(0)
        return np.linalg.slogdet(m.T @ m / len(m) + 1e-6 * np.eye(m.shape[1]))[1]

    return max(0.0, 0.5 * (det(x, z) + det(y, z) - det(z) - det(x, y, z)))


def plain_scores(m, own, lag=1, most=6):
    rest = [k for k in range(m.shape[1]) if k not in own]
    centred = m[:, rest] - m[:, rest].mean(0)
    pcs = centred @ np.linalg.svd(centred, full_matrices=False)[2][:most].T
    a, b = slice(None, -lag), slice(lag, None)
    corr = lambda u, v: abs(np.corrcoef(u, v)[0, 1])
    into = {k: np.mean([corr(p[a], m[b, k]) for p in pcs.T]) for k in own}
    out = {k: np.mean([corr(m[a, k], p[b]) for p in pcs.T]) for k in own}
    sensor = max(own, key=into.get)
    action = max((k for k in own if k != sensor), key=out.get)
    inner = [k for k in own if k not in (sensor, action)]
    loss = plain_information(m[b][:, inner], pcs[b], m[a][:, [sensor, action]])
    return sensor, action, inner, loss, plain_information(m[b][:, own], m[a][:, own], pcs[a])


@pytest.fixture(scope="module")
def systems(spark):
    traces = {f"s{k}": planted(k) for k in range(3)}
    moments = members.lagged_moments(frame(spark, traces)).cache()
    return traces, moments


def sets(spark, traces, **of):
    rows = [(name, s, NAMES[k]) for name in traces for s, own in of.items() for k in own]
    return spark.createDataFrame(rows, "trace_id string, set_id string, var string")


AGENT, DECOY = [0, 1, 2, 3], [6, 7, 8, 9]


def test_lagged_covariances(systems):
    traces, moments = systems
    got = {(r.i, r.j): r for r in members.lagged_covariances(moments).where("trace_id = 's1'").collect()}
    m = traces["s1"]
    assert len(got) == len(NAMES) ** 2
    for a, b in ((0, 2), (5, 1), (7, 7)):
        r = got[NAMES[a], NAMES[b]]
        cov = lambda u, v: np.mean(u * v) - u.mean() * v.mean()
        assert r.n == len(m) - 1
        assert (r.past, r.next, r.cross) == pytest.approx((cov(m[:-1, a], m[:-1, b]), cov(m[1:, a], m[1:, b]), cov(m[:-1, a], m[1:, b])), abs=1e-9)


def test_scores_equal_plain_ones(spark, systems):
    traces, moments = systems
    got = members.member_scores(moments, sets(spark, traces, agent=AGENT, decoy=DECOY, mixed=[0, 4, 7])).collect()
    assert len(got) == 9
    for r in got:
        own = {"agent": AGENT, "decoy": DECOY, "mixed": [0, 4, 7]}[r.set_id]
        sensor, action, inner, loss, autonomy = plain_scores(traces[r.trace_id], own)
        assert (r.sensors, r.actions, r.internal) == ([NAMES[sensor]], [NAMES[action]], sorted(NAMES[k] for k in inner))
        assert (r.loss, r.autonomy) == pytest.approx((loss, autonomy), abs=1e-6)


def test_planted_boundary_lies_in_the_corner(spark, systems):
    traces, moments = systems
    got = {(r.trace_id, r.set_id): r for r in members.member_null(moments, sets(spark, traces, agent=AGENT, decoy=DECOY), draws=60).collect()}
    for name in traces:
        agent, decoy = got[name, "agent"], got[name, "decoy"]
        assert agent.corner and not decoy.corner
        assert agent.loss_p < decoy.loss_p and agent.autonomy_p > decoy.autonomy_p
        assert agent.draws == 60 and agent.loss_p < 0.1


def test_random_members(spark, systems):
    traces, moments = systems
    own = sets(spark, traces, agent=AGENT)
    pool = spark.createDataFrame([(n, v) for n in traces for v in NAMES[:5]], "trace_id string, var string")
    drawn = members.random_members(moments, own, 20, pool).collect()
    by = {}
    for r in drawn:
        by.setdefault((r.trace_id, r.draw), set()).add(r.var)
    assert len(by) == 60 and all(len(x) == 4 and x <= set(NAMES[:5]) for x in by.values())
    assert len({frozenset(x) for x in by.values()}) > 3
    small = pool.where("var < 'b'")
    assert members.random_members(moments, own, 2, small).count() == 0


def test_roles_and_partitions(spark, systems):
    traces, moments = systems
    rows = [("s0", "cut", v, r) for v, r in zip(NAMES[:6], ("internal", "internal", "interface", "interface", "external", "external"))]
    roles = spark.createDataFrame(rows, "trace_id string, set_id string, var string, role string")
    m = traces["s0"]
    want = plain_information(m[1:, :2], m[1:, 4:6], m[:-1, 2:4])
    got = members.partition_null(moments, roles, draws=60).first()
    assert got.loss == pytest.approx(want, abs=1e-7)
    assert got.p < 0.2 and got.draws == 60
    undefined = members.boundary_loss(moments, roles.where("role <> 'internal'")).first()
    assert undefined.loss is None


def test_class_sets(spark, systems):
    traces, moments = systems
    classes = spark.createDataFrame([(n, v, v.upper()) for n in traces for v in NAMES], "trace_id string, var string, class string")
    own = spark.createDataFrame([("agent", NAMES[k].upper()) for k in AGENT] + [("none", c) for c in ("IA", "NO", "NOR")], "set_id string, class string")
    got = {r.set_id: r for r in members.class_set_null(moments, classes, own, n_sets=30).collect()}
    assert set(got) == {"agent"}  # a set with fewer than three members anywhere has no score
    want = np.mean([plain_scores(m, AGENT)[3] for m in traces.values()])
    assert got["agent"].traces == 3 and got["agent"].loss == pytest.approx(want, abs=1e-6)
    assert got["agent"].p < 0.2


def test_defined_cases(spark):
    odd = frame(spark, {"a": np.array([[1.0, 2.0], [2.0, 1.0], [4.0, 4.0], [0.0, 1.0], [3.0, 3.0]])}, ["x", "y"])
    holes = odd.where("NOT (t = 1 AND var = 'y')")
    moments = members.lagged_moments(holes)
    row = moments.first()
    assert row.whole[0] == 4 and row.past[0] == 2  # tick 1 is left out, 0 and 2 have no partner
    own = spark.createDataFrame([("a", "s", "x"), ("a", "s", "x"), ("a", "s", "nobody"), ("b", "s", "x")], "trace_id string, set_id string, var string")
    got = members.member_scores(moments, own).collect()
    assert [(r.trace_id, r.size, r.loss) for r in got] == [("a", 1, None)]
    assert members.member_scores(members.lagged_moments(odd.limit(0)), own).collect() == []
    assert members.member_null(moments, own, draws=3).collect() == []
