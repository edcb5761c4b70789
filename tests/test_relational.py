"""Relational operators on hand-made cases: nulls, ties, repeated rows and empty tables among them."""

import math

import numpy as np
import pytest

from mutua.operators import relational as rel


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


TRACE = "trace_id string, t long, var string, value double"


def test_aliases_and_appends(spark):
    trace = _frame(spark, [("a", 0, "x", 1.0), ("a", 0, "y", None), ("a", 0, "y", None)], TRACE)
    aliases = _frame(spark, [("x",), (None,)], "var string")
    assert _rows(rel.DROP_ALIASES(trace=trace, aliases=aliases)) == [("a", 0, "y", None)] * 2
    assert rel.DROP_ALIASES(trace=trace, aliases=aliases.limit(0)).count() == 3
    assert rel.APPEND(first=trace, second=trace.limit(0)).count() == 3 and rel.APPEND(first=trace, second=trace).count() == 6


def test_controls_keep_the_first_place(spark):
    first = _frame(spark, [("a", "x", 1), ("a", "y", 2), ("a", "y", 3)], "trace_id string, var string, place int")
    second = _frame(spark, [("a", "y", 1), ("a", "z", 2), ("b", "x", 1)], "trace_id string, var string, place int")
    assert [(r.trace_id, r["var"], r.place) for r in rel.CONTROLS(first=first, second=second).orderBy("trace_id", "place").collect()] == [("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "x", 1)]


def test_operation_masks(spark):
    rows = [("a", 0, "flip", "x"), ("a", 1, "flip", "y"), ("a", 2, None, None), ("a", 3, "block", "x")]
    t = _frame(spark, rows, "trace_id string, t long, op string, handle string")
    chosen = lambda op: [r.t for r in op(transitions=t).where("chosen").orderBy("t").collect()]
    assert chosen(rel.operation_mask("flip")) == [0, 1] and chosen(rel.operation_mask("flip", "x")) == [0] and chosen(rel.operation_mask("flip", "x", or_none=True)) == [0, 2]


def test_truth_and_outer_joins(spark):
    p = _frame(spark, [("g", 1, 0.5), ("g", 2, 0.5), (None, 1, 0.5)], "grp string, item long, score double")
    t = _frame(spark, [("g", 1, True), ("h", 2, True)], "grp string, item long, label boolean")
    assert [r.label for r in rel.WITH_TRUTH(predictions=p, truth=t).orderBy("grp", "item").collect()] == [False, True, False]
    left, right = _frame(spark, [(1, 5), (None, 6)], "k long, n long"), _frame(spark, [(1, 7), (2, 8)], "k long, n long")
    assert _rows(rel.FULL_OUTER(left=left, right=right)) == sorted([(1, 5, 7), (2, None, 8), (None, 6, None)], key=repr)


def test_sets(spark):
    m = _frame(spark, [(1, "a"), (1, "b"), (1, "c"), (1, None), (2, "c"), (2, "b"), (2, "a"), (3, "a"), (3, "b")], "community long, class string")
    assert _rows(rel.class_sets()(members=m)) == [(1, "a,b,c")]
    known = _frame(spark, [("g", 1), ("g", 2), ("g", 2), ("h", 1)], "grp string, item long")
    admitted = _frame(spark, [("g", 2), ("g", 9)], "grp string, item long")
    assert _rows(rel.ADMITTED_RECALL(known=known, admitted=admitted)) == [("g", 1, 2, 0.5), ("h", 0, 1, 0.0)]


def test_winners_and_rounds(spark):
    rows = _frame(spark, [(1, 2, 10, 0.5), (1, 2, 9, 0.5), (1, 3, 1, 0.1)], "seed int, slots int, place int, score double")
    assert _rows(rel.BEST_OF_GROUP(rows=rows)) == [(1, 2, 9, 0.5), (1, 3, 1, 0.1)]
    rounds = _frame(spark, [("g", 1, 2, 5.0), ("g", 1, 1, 9.0), ("g", 1, 1, 7.0)], "grp string, round int, place int, value double")
    assert _rows(rel.ROUND_SUMMARY(rows=rounds)) == [("g", 1, 7.0, 7.0, 7.0, 3)]


@pytest.mark.parametrize(
    ("row", "reason"),
    [((True, 0.0, 0.0, False, True, True), "admitted"), ((False, 0.9, 0.9, False, True, True), "agency_gate_blocked"), ((False, 0.9, 0.9, None, True, True), "partial_peel_orphan"), ((False, 0.5, 0.1, True, False, False), "refine_or_train_degraded"), ((False, 0.2, 0.1, None, False, False), "mi_merge_below_threshold"), ((False, 0.0, 0.0, None, False, False), "never_in_mi_cluster"), ((False, 0.5, 0.5, None, False, False), "unknown")],
)
def test_miss_reasons(spark, row, reason):
    agents = _frame(spark, [(1, *row)], "agent int, admitted boolean, proposal double, trained double, agency_passed boolean, gate_blocked boolean, peeled boolean")
    assert rel.miss_reason()(agents=agents).first().reason == reason


def test_gaps_rates_and_digests(spark):
    import hashlib

    rows = _frame(spark, [("e", 250, "m", 0.75, None), ("e", 60, "m", 0.5, None), ("f", 60, "m", 0.5, 0.9)], "kind string, width int, method string, ari double, own double")
    ref = _frame(spark, [("e", 250, 1.0), ("f", 60, 0.1)], "kind string, width int, ari double")
    assert _rows(rel.REFERENCE_GAP(rows=rows, reference=ref)) == [("e", 250, "m", 1.0, 0.25), ("f", 60, "m", 0.9, 0.4)]
    flags = _frame(spark, [("a", True, True), ("a", False, True), ("b", False, False)], "family string, flagged boolean, expected boolean")
    assert _rows(rel.FAMILY_RATES(rows=flags)) == [("a", 2, 0.5, 0.5), ("b", 1, 0.0, 1.0)]
    texts = _frame(spark, [(1, "é"), (2, ""), (3, None)], "id int, text string")
    assert dict(_rows(rel.CHECKSUM(texts=texts))) == {1: hashlib.sha256("é".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest(), 3: None}


def test_truncated_merge(spark):
    rows = [("a", t, v, float(t)) for v in "xy" for t in range(5)] + [("b", t + 10, "z", float(t)) for t in range(3)]
    got = rel.TRUNCATE_ALIGNED(trace=_frame(spark, rows, TRACE)).collect()
    assert {(r.trace_id, r["var"]): r.agent for r in got} == {("a", "x"): 0, ("a", "y"): 1, ("b", "z"): 2}
    assert len(got) == 9 and {r.t for r in got} == {0, 1, 2}


def test_conservation_of_information(spark):
    """Over whole sequences the two directions account for all information."""
    rng = np.random.default_rng(1)
    rows = []
    for run in range(4000):
        x, y = rng.integers(0, 2, 3), rng.integers(0, 2, 3)
        y[1:] = np.where(rng.random(2) < 0.9, x[:-1], y[1:])
        rows += [("x", "y", str(run), k, int(a), int(b)) for k, (a, b) in enumerate(zip(x, y))]
    r = rel.conservation(3)(runs=_frame(spark, rows, "src string, dst string, run string, step int, x int, y int")).first()
    h = lambda p: -p * math.log(p) - (1 - p) * math.log(1 - p)
    assert abs(r.forward - 2 * (math.log(2) - h(0.95))) < 0.05 and abs(r.residual) < 0.01 and r.backward < 0.02


def test_bootstrapped_information(spark):
    rows = [("k", k, k % 2, k % 2, 0) for k in range(200)]
    r = rel.bootstrap_cmi(30)(observed=_frame(spark, rows, "keys string, k long, x int, y int, z int")).first()
    assert r.n == 30 and 0.97 < r.low <= r.mean <= r.high <= 1 and 0 < r.sd < 0.02
