"""Interventional scores against plain entropies, and a loop whose true roles come first in the end."""

import numpy as np
import pytest

from mutua.operators import interventions

NAMES = ["B", "S", "A", "G", "E", "S2", "A2", "D"]
TRUE = ("B", "S", "A", "G", "E")


def world(seed=0, n=6000):
    """A sensor follows the effect, a base the sensor, an action is base xor goal, and turns the effect; two are noisy copies, one is noise. Every third tick something is done to one of them."""
    rng = np.random.default_rng(seed)
    b, e, g = rng.integers(0, 2, 3)
    rows, done = [], []
    for t in range(n):
        op, handle = None, None
        if t % 3 == 0:
            op = ("sensor_flip", "action_block", "goal_flip")[rng.integers(3)]
            handle = {"sensor_flip": ("S", "S2", "D"), "action_block": ("A", "A2", "D"), "goal_flip": ("G", "E", "D")}[op][rng.integers(3)]
        noise = rng.random(6) < 0.05
        s = e ^ noise[0]
        a = b ^ g ^ (op == "goal_flip" and handle == "G") ^ noise[1]
        rows.append((b, s, a, g, e, s ^ noise[4], a ^ noise[5], rng.integers(2)))
        done.append((op, handle))
        b = s ^ (op == "sensor_flip" and handle == "S") ^ noise[2]
        e = e ^ (a and not (op == "action_block" and handle == "A")) ^ noise[3]
        g = g ^ (rng.random() < 0.02)
    return np.array(rows, int), done


def bits(*columns):
    counts = np.unique(np.stack(columns, 1), axis=0, return_counts=True)[1]
    p = counts / counts.sum()
    return -(p * np.log2(p)).sum()


def cmi(x, y, *z):
    return max(0.0, bits(x, *z) + bits(y, *z) - bits(*z) - bits(x, y, *z))


def plain(m, done, b, s, a, g, e):
    x, x1, done = m[:-1], m[1:], done[: len(m) - 1]
    at = {v: k for k, v in enumerate(NAMES)}
    free = np.array([op is None for op, _ in done])

    def rows(op, handle):
        hit = np.array([d == (op, handle) for d in done])
        both = free | hit
        return (both, hit[both].astype(int)) if hit.sum() >= 25 and both.sum() >= 50 else None

    sensor = action = goal = 0.0
    if got := rows("sensor_flip", s):
        sensor = cmi(got[1], x1[got[0], at[a]], x[got[0], at[e]], x[got[0], at[g]]) - 0.020
    if (got := rows("action_block", a)) and got[1].sum() > 25 and (1 - got[1]).sum() > 25:
        part = lambda on: cmi(x1[got[0], at[e]][got[1] == on], x[got[0], at[a]][got[1] == on], x[got[0], at[e]][got[1] == on])
        action = part(0) - part(1) - 0.12
    if got := rows("goal_flip", g):
        goal = cmi(got[1], x[got[0], at[a]], x[got[0], at[b]], x[got[0], at[e]]) - 0.002
    return sensor, action, goal


@pytest.fixture(scope="module")
def tables(spark):
    m, done = world()
    binary = spark.createDataFrame([("w", t, v, int(x)) for t, row in enumerate(m) for v, x in zip(NAMES, row)], "trace_id string, t long, var string, x int")
    operations = spark.createDataFrame([("w", t, op, handle) for t, (op, handle) in enumerate(done)], "trace_id string, t long, op string, handle string")
    sets = [TRUE, ("B", "S2", "A", "G", "E"), ("B", "S", "A2", "G", "E"), ("B", "D", "A", "G", "E"), ("S", "S2", "A2", "E", "G"), ("B", "S", "A", "D", "E"), ("D", "S", "A", "G", "E"), ("B", "S2", "A2", "D", "E")]
    candidates = spark.createDataFrame([("w", *c) for c in sets] + [("none", *TRUE)], "trace_id string, b string, s string, a string, g string, e string")
    return m, done, binary, operations, candidates, sets


def test_scores(spark, tables):
    m, done, binary, operations, candidates, sets = tables
    got = {(r.trace_id, r.b, r.s, r.a, r.g, r.e): r for r in interventions.score_interventions(binary, operations, candidates).collect()}
    assert len(got) == len(sets) + 1 and got["none", *TRUE].interventional == 0
    for c in sets:
        sensor, action, goal = plain(m, done, *c)
        r = got["w", *c]
        assert (r.sensor_int, r.action_int, r.goal_int) == pytest.approx((sensor, action, goal), abs=1e-9)
        assert r.interventional == pytest.approx(30 * sensor + 4 * action + 4 * goal, abs=1e-7)
    best = max((r for k, r in got.items() if k[0] == "w"), key=lambda r: r.interventional)
    assert best.s == "S" and best.a == "A"


def test_few_operations_count_for_nothing(spark, tables):
    _, _, binary, operations, candidates, _ = tables
    few = operations.where("op IS NULL OR (handle = 'S' AND t < 200)")
    got = interventions.score_interventions(binary, few, candidates.where("trace_id = 'w'")).collect()
    assert {r.interventional for r in got} == {0.0}


def test_loop_finds_the_true_roles(spark, tables):
    _, _, binary, operations, candidates, sets = tables
    passive = spark.createDataFrame([("w", *c, 0.05 * k, len(sets) - k) for k, c in enumerate(sets)], "trace_id string, b string, s string, a string, g string, e string, score double, place int")
    rows = interventions.active_loop(binary, operations, passive, rounds=4, batch=400).collect()
    places = {k: next(r.place for r in rows if r.round == k and (r.b, r.s, r.a, r.g, r.e) == TRUE) for k in range(1, 5)}
    assert next(r.place for r in passive.collect() if (r.b, r.s, r.a, r.g, r.e) == TRUE) == len(sets)  # last at first
    assert places[4] <= 2 and places[4] <= places[1]
    assert len({(r.round, r.role, r["var"]) for r in rows}) == 4
