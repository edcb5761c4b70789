"""Operators against numpy on planted series: the formulas are written again here, from their definitions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from mutua.operators import detector, directed, grouping, influence, information, metrics, preprocess, roles, segments


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _binary(spark, columns, trace_id="a"):
    return _frame(spark, [(trace_id, t, v, int(x)) for v, xs in columns.items() for t, x in enumerate(xs)], "trace_id string, t long, var string, x int")


def _trace(spark, columns, trace_id="a"):
    return _frame(spark, [(trace_id, t, v, float(x)) for v, xs in columns.items() for t, x in enumerate(xs)], "trace_id string, t long, var string, value double")


def _series(spark, named):
    rows = [(k, t, float(a), float(o), float(c)) for k, cols in named.items() for t, (a, o, c) in enumerate(zip(*cols))]
    return _frame(spark, rows, "trace_id string, t long, action double, outcome double, control double")


def _number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


# ---- influence


def _residual(y, x):
    design = np.column_stack([np.ones(len(y)), x])
    return y - design @ np.linalg.lstsq(design, y, rcond=None)[0]


def _mean_ratio(y, bad, mask, least):
    if (bad & mask).sum() < least or (~bad & mask).sum() < least:
        return 1.0
    return (y[bad & mask].mean() + 1e-6) / (y[~bad & mask].mean() + 1e-6)


def plain_odds(action, outcome, control):
    if len(action) < 40:
        return 1.0, 1.0, None
    y, o = np.abs(_residual(np.abs(action), control)), np.round(_residual(outcome, control), 9)
    bad = o >= round(np.quantile(o, 0.8), 9)
    if bad.sum() < 5 or (~bad).sum() < 5:
        return 1.0, 1.0, None
    move = np.abs(np.diff(outcome, prepend=outcome[0]))
    lively, calm = move >= np.quantile(move, 0.6), move <= np.quantile(move, 0.4)
    selectivity = _mean_ratio(y, bad, lively, 3) / (_mean_ratio(y, bad, calm, 3) + 1e-6) if lively.sum() >= 8 and calm.sum() >= 8 else 1.0
    return _mean_ratio(y, bad, np.ones(len(y), bool), 5), selectivity, (y, bad)


@pytest.fixture(scope="module")
def agents():
    """A defender acts when the outcome is bad, and so lowers it; a drifter acts at random; a short series."""
    rng = np.random.default_rng(5)
    control, outcome, action = rng.normal(size=400), np.zeros(400), np.zeros(400)
    for t in range(1, 400):
        outcome[t] = 0.8 * outcome[t - 1] + rng.normal() - 1.5 * action[t - 1]
        action[t] = max(0.0, outcome[t] - 0.5) + 0.1 * rng.random()
    walk = rng.normal(size=300).cumsum()
    return {"defender": (action, outcome, control), "drifter": (rng.normal(size=300), walk, rng.normal(size=300)), "short": (rng.normal(size=30),) * 3}


def test_odds_ratio(spark, agents):
    got = {r.trace_id: r for r in influence.ODDS_RATIO(series=_series(spark, agents)).collect()}
    for k, (a, o, c) in agents.items():
        odds, selectivity, _ = plain_odds(a, o, c)
        assert math.isclose(got[k].odds, odds, rel_tol=1e-6) and math.isclose(got[k].selectivity, selectivity, rel_tol=1e-6), k
    assert got["defender"].odds > 1.65 > got["drifter"].odds and got["short"].odds == 1


def test_bootstrapped_odds(spark, agents):
    got = {r.trace_id: r for r in influence.bootstrap_odds(25)(series=_series(spark, agents)).collect()}
    for k, (a, o, c) in agents.items():
        known = plain_odds(a, o, c)[2]
        if known is None:
            assert (got[k].low, got[k].n) == (1, 0)
            continue
        y, bad = known
        odds = []
        for rep in range(1, 26):
            pick = np.array([_number(f"{k}|{i}|{rep}") % len(y) for i in range(len(y))])
            if bad[pick].sum() >= 3 and (~bad[pick]).sum() >= 3:
                odds.append((y[pick][bad[pick]].mean() + 1e-6) / (y[pick][~bad[pick]].mean() + 1e-6))
        assert got[k].n == len(odds) and math.isclose(got[k].low, np.quantile(odds, 0.1), rel_tol=1e-6)
        assert len({round(x, 12) for x in odds}) > 20  # resamples differ


@pytest.mark.parametrize(
    ("infl", "odds", "low", "selectivity", "flagged"),
    [(0.1, 1.5, 1.1, 0.1, True), (-0.1, 1.5, 1.1, 0.1, False), (-0.1, 1.7, 1.2, 0.1, True), (0.26, 1.0, 1.0, 0.8, True), (0.26, 1.0, 1.0, 0.7, False), (-0.31, 1.0, 1.0, 0.1, True), (0.2, 1.3, 1.2, 2.0, False)],
)
def test_influence_flag(spark, infl, odds, low, selectivity, flagged):
    r = influence.INFLUENCE_FLAG(
        influence=_frame(spark, [("a", infl)], "trace_id string, influence double"),
        odds=_frame(spark, [("a", odds, selectivity)], "trace_id string, odds double, selectivity double"),
        bootstrap=_frame(spark, [("a", low)], "trace_id string, low double"),
    ).first()
    assert r.flagged == flagged and math.isclose(r.combined, max(odds / 1.4, abs(infl) / 0.25, selectivity / 1.05))


def test_regulation(spark):
    rng = np.random.default_rng(6)
    drive = rng.normal(size=500)
    flat, action = 0.05 * rng.normal(size=500), np.concatenate([-drive[1:], [0]]) + 0.2 * rng.normal(size=500)
    named = {"held": (action, flat, drive), "moving": (action, drive + flat, drive), "undriven": (action, flat, np.ones(500))}
    got = {r.trace_id: r for r in influence.REGULATION(series=_series(spark, named)).collect()}
    for k, (a, o, c) in named.items():
        vc, vd = o.var(), c.var()
        f = max(0, 1 - vc / (vd + 1e-9)) if vd > 1e-9 else 0
        comp = max(0, -np.corrcoef(a[:-1], c[1:])[0, 1]) if a[:-1].std() * c[1:].std() > 1e-9 else 0
        ratio = vc / (vd + 1e-9) if vd > 1e-9 else math.inf
        assert math.isclose(got[k].flatness, f, abs_tol=1e-9) and math.isclose(got[k].compensation, comp, abs_tol=1e-9)
        assert math.isclose(got[k].regulation, f * comp if ratio <= 0.012 else 0, abs_tol=1e-9)
    assert got["held"].regulation > 0.9 and got["moving"].regulation == 0 and got["undriven"].ratio is None


# ---- surrogates


def test_turns_and_scrambles_differ_between_variables(spark):
    """Names of one length and one first letter get their own offsets and orders, and traces theirs."""
    x = list(range(40))
    trace = _trace(spark, {"agent0.sensor": x, "agent0.action": x}).unionByName(_trace(spark, {"agent0.sensor": x}, "b"))
    turned = influence.circular_shift(6)(trace=trace).toPandas()
    offsets = {}
    for (perm, tid, var), g in turned.groupby(["perm", "trace_id", "var"]):
        offset = {int(t - v) % 40 for t, v in zip(g.t, g.value)}
        assert offset == {1 + _number(f"{tid}|{var}|{perm}") % 39}
        offsets[perm, tid, var] = offset.pop()
    of = lambda tid, var: [offsets[p, tid, var] for p in range(1, 7)]
    assert of("a", "agent0.sensor") != of("a", "agent0.action") and of("a", "agent0.sensor") != of("b", "agent0.sensor")
    mixed = influence.scramble(3)(trace=trace).toPandas()
    orders = {k: g.sort_values("t").value.tolist() for k, g in mixed.groupby(["trace_id", "var"])}
    assert all(sorted(o) == x and o != x for o in orders.values()) and len({tuple(o) for o in orders.values()}) == 3
    for (tid, var), o in orders.items():
        assert o == sorted(x, key=lambda k: _number(f"{tid}|{var}|3|{k}"))


# ---- segments


def plain_parameters(a):
    width = int(np.clip(len(a) // 6, 80, 300))
    size, sd = np.abs(a).mean(), a.std()
    coefficient = None if size < 1e-6 or sd / (size + 1e-6) < 0.08 else 0.15 + 0.45 * (1 - (a > np.median(a)).mean())
    return width, max(width // 2, 20), max(40, min(width // 2, 120)), coefficient


def test_segment_parameters(spark):
    rng = np.random.default_rng(7)
    bursts = np.where(np.arange(600) % 80 < 12, 1.0, 0.0)
    named = {"bursts": bursts, "constant": np.ones(300), "none": np.zeros(90), "busy": rng.random(2400)}
    activity = _frame(spark, [(k, t, float(x)) for k, xs in named.items() for t, x in enumerate(xs)], "trace_id string, t long, value double")
    for r in segments.SEGMENT_PARAMETERS(activity=activity).collect():
        width, step, least, coefficient = plain_parameters(named[r.trace_id])
        assert (r.width, r.step, r.least_run) == (width, step, least)
        assert r.coefficient is None if coefficient is None else math.isclose(r.coefficient, coefficient, rel_tol=1e-9)


def test_should_segment(spark):
    sparse = np.where(np.arange(600) % 80 < 12, 1.0, 0.0)
    half = np.where(np.arange(600) % 2 == 0, 1.0, 0.0)
    traces = {"episodic": [sparse, sparse], "steady": [np.ones(600), np.ones(600)], "short": [sparse[:200], sparse[:200]], "one": [sparse, np.ones(600), np.ones(600)], "idle": [np.zeros(600), sparse], "half": [half, half]}
    rows = [(k, f"agent{j}", t, float(x)) for k, xs in traces.items() for j, series in enumerate(xs) for t, x in enumerate(series)]
    got = {r.trace_id: r for r in segments.should_segment()(activity=_frame(spark, rows, "trace_id string, agent string, t long, value double")).collect()}

    def share(a):
        size, sd = np.abs(a).mean(), a.std()
        return 0.0 if size < 1e-6 else 1.0 if sd / (size + 1e-6) < 0.08 else (a > np.median(a) + 0.25 * sd).mean()

    for k, xs in traces.items():
        shares = [share(a) for a in xs]
        assert math.isclose(got[k].least_share, min(shares)) and math.isclose(got[k].middle_share, np.median(shares))
        assert got[k].segment == (len(xs[0]) >= 250 and min(shares) < 0.22 and np.median(shares) < 0.40)
    assert [k for k in traces if got[k].segment] == ["episodic", "idle"]


# ---- groups and roles


def test_autocorrelations(spark):
    rng = np.random.default_rng(8)
    named = {"walk": rng.normal(size=80).cumsum(), "flat": np.ones(9), "two": np.array([1.0, 2.0])}
    got = {r["var"]: r for k, x in named.items() for r in preprocess.LAG1_AUTOCORRELATION(trace=_trace(spark, {k: x})).collect()}
    x = named["walk"] - named["walk"].mean()
    assert math.isclose(got["walk"].paired, (x[:-1] @ x[1:]) / math.sqrt((x[:-1] ** 2).sum() * (x[1:] ** 2).sum()), rel_tol=1e-9)
    assert got["flat"].paired == 0 and got["two"].paired == 0


def _stats(spark):
    rows = [("1|0", 0.5, 0.2, 3), ("1|1", 0.9, 0.01, 2), ("1|2", -0.5, 0.3, 4), ("10|0", 0.12, 0.015, 2), ("10|1", 0.7, 0.4, 1)]
    auto = _frame(spark, [(k, v, p) for k, p, _, _ in rows for v in ("own", "rest")], "trace_id string, var string, paired double")
    mi = _frame(spark, [(k, m) for k, _, m, _ in rows], "trace_id string, mi double")
    h = _frame(spark, [(k, "own", 1.0) for k, *_ in rows], "trace_id string, var string, nats double")
    labels = _frame(spark, [(*k.split("|"), f"v{k}{j}") for k, *_, n in rows for j in range(n)], "trace_id string, cluster string, var string")
    return rows, labels, grouping.precursor_stats()(autocorrelation=auto, information=mi, entropy=h, labels=labels)


def test_precursors_and_partition_score(spark):
    rows, _, stats = _stats(spark)
    passes = {k: n >= 2 and p >= 0.12 and m >= 0.015 for k, p, m, n in rows}
    assert {r.trace_id: r.passes for r in stats.collect()} == passes == {"1|0": True, "1|1": False, "1|2": False, "10|0": True, "10|1": False}
    got = {r.trace_id: r for r in grouping.PARTITION_SCORE(stats=stats).collect()}
    assert set(got) == {"1", "10"}
    for trace in got:
        own = [(p + m, passes[k]) for k, p, m, _ in rows if k.split("|")[0] == trace]
        rate, signal = np.mean([ok for _, ok in own]), np.mean([s for s, ok in own if ok])
        assert math.isclose(got[trace].score, rate * (signal + 1e-6) + 0.02 * len(own))


@pytest.mark.parametrize("by_size", [False, True])
def test_cluster_rank(spark, by_size):
    rows, labels, stats = _stats(spark)
    similarity = _frame(spark, [("1", "v1|00", "v1|01", 0.4), ("1", "v1|00", "v1|02", 0.8), ("1", "v1|01", "v1|02", 0.6), ("1", "v1|00", "v1|20", 9.0)], "trace_id string, i string, j string, w double")
    penalties = _frame(spark, [("1|2", 0.85)], "trace_id string, penalty double")
    got = {r.trace_id: r for r in grouping.cluster_rank(by_size)(labels=labels, similarity=similarity, stats=stats, penalties=penalties).collect()}
    within = {"1|0": 0.6}
    want = {k: (max(p, 0) + m + 0.3 * within.get(k, 0)) * (math.sqrt(n) if by_size else 1) * (0.25 if n <= 2 else 1) - (0.85 if k == "1|2" else 0) for k, p, m, n in rows}
    assert all(math.isclose(got[k].score, want[k]) for k in want)
    assert got["10|0"].place + got["10|1"].place == 3 and got["1|0"].place == 1


def test_role_signature(spark):
    roles_of = {0: "SAI", 1: "SI", 2: "A", 3: "II"}
    rows = [("a", c, f"v{c}{j}", r) for c, rs in roles_of.items() for j, r in enumerate(rs)]
    got = {r.cluster: r for r in roles.ROLE_SIGNATURE(roles=_frame(spark, rows, "trace_id string, cluster int, var string, role string")).collect()}
    for c, rs in roles_of.items():
        assert math.isclose(got[c].penalty, 0.85 * ("A" not in rs) + 0.35 * ("S" not in rs) + 0.15 * ("I" not in rs), abs_tol=1e-12)
        assert (got[c].passes_strict, got[c].passes_actions_only) == (set(rs) == set("SAI"), "A" in rs)


# ---- directional scores


def _plugin(*columns):
    n = Counter(zip(*columns))
    total = sum(n.values())
    return -sum(c / total * math.log2(c / total) for c in n.values())


def _cmi_bits(x, y, *z):
    z = z or ([0] * len(x),)
    return max(0.0, _plugin(x, *z) + _plugin(y, *z) - _plugin(*z) - _plugin(x, y, *z))


def _dense_cmi(x, y, z, alpha=0.1):
    ix, iy, iz = (np.unique(np.array([str(a) for a in v]), return_inverse=True)[1] for v in (x, y, z))
    p = np.full((ix.max() + 1, iy.max() + 1, iz.max() + 1), alpha)
    np.add.at(p, (ix, iy, iz), 1)
    p /= p.sum()
    return max(0.0, float((p * np.log(p * p.sum((0, 1), keepdims=True) / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum()))


def test_fused_scores(spark):
    """Names that hold each other: the rest of 'a' must not lose parts of 'ba'."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2, 300)
    cols = {"a": a, "ba": np.concatenate([[0], a[:-1]]), "b": rng.integers(0, 2, 300)}
    got = {r["var"]: r for r in directed.fused_scores()(binary=_binary(spark, cols)).collect()}
    for v, x in cols.items():
        rest = list(zip(*(cols[k].tolist() for k in cols if k != v)))
        assert math.isclose(got[v].push_in, _dense_cmi(x[1:], rest[:-1], x[:-1]), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(got[v].push_out, _dense_cmi(rest[1:], x[:-1], rest[:-1]), rel_tol=1e-9, abs_tol=1e-12)


def test_turned_flows_both_ways(spark):
    rng = np.random.default_rng(12)
    x = rng.integers(0, 2, 60)
    cols = {"click": x, "error": np.concatenate([[0], x[:-1]])}
    got = {r.pair: r.te for r in information.turned_transfer(20, both=True)(binary=_binary(spark, cols)).collect()}
    assert len(got) == 80
    for shift in range(1, 21):
        for of in cols:
            turned = {**cols, of: np.roll(cols[of], 2 + _number(f"a|{of}|{shift}") % 56)}
            for src, dst in (("click", "error"), ("error", "click")):
                d, s = turned[dst], turned[src]
                assert math.isclose(got[f"a:{shift}|{src}|{dst}|{of}"], _dense_cmi(d[1:], s[:-1], d[:-1]), rel_tol=1e-9, abs_tol=1e-12)
    assert [_number(f"a|click|{k}") % 56 for k in range(1, 21)] != [_number(f"a|error|{k}") % 56 for k in range(1, 21)]


@pytest.mark.parametrize("least_z", [None, 2.0])
def test_signature_flags(spark, least_z):
    scores = {"driver": (0.01, 0.5, 0.51), "follower": (0.5, 0.01, 0.51), "quiet": (0.0, 0.0, 0.0), "mixed": (0.2, 0.5, 0.7), "frozen": (0.0, 0.5, 0.5), "narrow": (0.0, 0.106, 0.2)}
    floors = {v: {k: (0.1, 0.05, 0.0 if v == "frozen" else 0.03) for k in ("push_in", "out_sys", "total_flow")} for v in scores}
    rows = [("a", v, k, *f) for v, by in floors.items() for k, f in by.items()]
    got = {r["var"]: r for r in directed.signature_flags(least_z=least_z)(scores=_frame(spark, [("a", v, *s) for v, s in scores.items()], "trace_id string, var string, push_in double, out_sys double, total_flow double"), floors=_frame(spark, rows, "trace_id string, var string, name string, p95 double, mean double, sd double")).collect()}

    def clears(score, f):
        return score > f[0] and (least_z is None or f[2] > 0 and (score - f[1]) / f[2] >= least_z)

    for v, (push_in, out_sys, total) in scores.items():
        f = floors[v]
        net_out, net_in = max(0, out_sys - f["out_sys"][0]), max(0, push_in - f["push_in"][0])
        drives, rankable, one_way = clears(out_sys, f["out_sys"]), clears(total, f["total_flow"]), net_out > 0 and net_out >= 9 * net_in
        assert (got[v].drives, got[v].rankable, got[v].one_way, got[v].signature, got[v].intake_at_floor) == (drives, rankable, one_way, drives and rankable and one_way, net_in == 0), v
    assert got["driver"].signature and not got["mixed"].signature and got["frozen"].signature == (least_z is None) and got["narrow"].signature == (least_z is None)


def _loop(n=900):
    """A loop: the goal is fixed by phase, the base follows the sensor, the action is base xor goal, the effect follows the action, the sensor the effect."""
    rng = np.random.default_rng(10)
    b = s = a = e = 0
    rows = []
    for t in range(n):
        g = t // 90 % 2
        flip = lambda x, p=0.1: x ^ int(rng.random() < p)
        b, s, e = flip(s), flip(e), flip(a)
        a = flip(b ^ g, 0.02)
        rows.append((b, s, a, g, e))
    return dict(zip("bsage", np.array(rows).T))


def test_passive_score_and_next_operation(spark):
    cols = _loop()
    binary = _binary(spark, cols)
    candidates = directed.ROLE_CANDIDATES(binary=binary)
    terms = information.PLUGIN_CMI(observed=directed.LOOP_OBSERVATIONS(binary=binary))
    bins = binary.where(f"t < {len(cols['b']) - 1}").selectExpr("trace_id", "t", "var", "x as bin")
    scored = directed.PASSIVE_SCORE(candidates=candidates, terms=terms, entropies=information.ENTROPY(bins=bins)).cache()
    rows = scored.collect()
    assert len(rows) == 120
    now, then = {k: x[:-1].tolist() for k, x in cols.items()}, {k: x[1:].tolist() for k, x in cols.items()}
    for r in rows[::7]:
        sensor = _cmi_bits(then[r.b], now[r.s], now[r.b])
        policy = _cmi_bits(now[r.a], list(zip(now[r.b], now[r.g])))
        control = _cmi_bits(then[r.e], now[r.a], now[r.e])
        blanket = _cmi_bits(then[r.b], then[r.e], now[r.s], now[r.a])
        activity = sum(_plugin(now[k]) for k in (r.b, r.s, r.a, r.g, r.e)) / 5
        assert math.isclose(r.score, 1.15 * sensor + policy + 1.2 * control - 1.1 * blanket + 0.08 * activity, abs_tol=1e-8)
    best = min(rows, key=lambda r: r.place)
    assert best.score == max(r.score for r in rows)
    posterior = directed.posterior()(scored=scored)
    masses = directed.ROLE_MASS(posterior=posterior)
    mass = {(r.role, r["var"]): r.mass for r in masses.collect()}
    tried = []
    for role in ("a", "s", "g"):
        r = directed.NEXT_OPERATION(posterior=posterior, masses=masses, tried=_frame(spark, tried, "trace_id string, role string, var string")).first()
        assert (r.role, r["var"], r.of_best) == (role, best[role], True) and math.isclose(r.mass, mass[role, best[role]])
        tried.append(("a", role, best[role]))
    r = directed.NEXT_OPERATION(posterior=posterior, masses=masses, tried=_frame(spark, tried, "trace_id string, role string, var string")).first()
    left = {k: p * (1.25 - p) for k, p in mass.items() if k[0] in "asg" and ("a", *k) not in tried}
    assert not r.of_best and math.isclose(r.gain, max(left.values())) and math.isclose(left[r.role, r["var"]], r.gain)


def test_empty_inputs(spark):
    none = _series(spark, {})
    for op in (influence.ODDS_RATIO, influence.bootstrap_odds(5), influence.REGULATION):
        assert op(series=none).count() == 0
    assert influence.scramble()(trace=_trace(spark, {})).count() == 0 and directed.fused_scores()(binary=_binary(spark, {})).count() == 0


def test_choice_of_k(spark):
    """The largest k with enough valid clusters; without any, the most valid ones, then the rate, then the larger k."""
    rows = [("a", 8, c, c < 1) for c in range(2)] + [("a", 6, c, c < 3) for c in range(4)] + [("a", 3, c, True) for c in range(2)]
    rows += [("b", 6, 0, True), ("b", 6, 1, False), ("b", 3, 0, True), ("b", 3, 1, False)]
    rows += [("c", 2, 0, None), ("c", 1, 0, False)]
    detected = spark.createDataFrame([(t, k, str(c), v) for t, k, c, v in rows], "trace_id string, k int, label string, valid boolean")
    got = {r.trace_id: (r.k, r.n_valid, r.rate) for r in detector.choose_k(detected).collect()}
    assert got == {"a": (6, 3, 0.75), "b": (6, 1, 0.5), "c": (2, 1, 1.0)}


def test_pooled_p_of_one(spark):
    tests = spark.createDataFrame([("none", 1.0, 0.0), ("none", 1.0, 1.0), ("mixed", 1.0, 0.0), ("mixed", 0.01, 3.0)], "grp string, p double, z double")
    got = {r.grp: r.combined_p for r in metrics.FISHER_POOL(tests=tests).collect()}
    half = -math.log(0.01)
    assert got["none"] == 1 and got["mixed"] == pytest.approx(math.exp(-half) * (1 + half))


def test_found_sets_without_a_match(spark):
    found = spark.createDataFrame([(1, 10), (1, 11), (2, 90)], "owner long, item long")
    known = spark.createDataFrame([(7, 10), (7, 12)], "owner long, item long")
    got = {r.owner: (r.known, r.recall, r.extra, r.clean) for r in grouping.PURITY_MATCH(found=found, known=known).collect()}
    assert got == {1: (7, 0.5, 0.5, False), 2: (-1, 0.0, 1.0, False)}


def test_bootstrap_without_replicates_is_the_point_estimate(spark):
    """One resample of 40 ticks, 8 of them bad, now and then holds fewer than 3 bad ones."""
    rng = np.random.default_rng(4)
    rows = [(f"a{k}", t, float(a), float(o), float(c)) for k in range(500) for t, (a, o, c) in enumerate(rng.normal(size=(40, 3)))]
    series = _frame(spark, rows, "trace_id string, t long, action double, outcome double, control double")
    odds = {r.trace_id: r.odds for r in influence.ODDS_RATIO(series=series).collect()}
    got = {r.trace_id: r for r in influence.bootstrap_odds(1)(series=series).collect()}
    assert len(got) == 500
    without = [r for r in got.values() if r.n == 0]
    assert without and all(r.low == pytest.approx(odds[r.trace_id]) for r in without)
    assert any(abs(r.low - odds[r.trace_id]) > 1e-6 for r in got.values())
