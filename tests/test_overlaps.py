"""Overlaps of sets against brute force and the text of the operators."""

import re

import numpy as np
import pytest

from mutua.operators import grouping, overlaps
from mutua.plans import registry


def _sets(spark, seed, owners, first):
    """Small sets, one item of all owners, an owner of many items, ids beyond 32 bits, and rows without an owner or an item."""
    rng = np.random.default_rng(seed)
    rows = {(first + int(o) * 7, int(i)) for o, i in zip(rng.integers(0, owners, 3 * owners), rng.integers(0, 300, 3 * owners))}
    rows |= {(first + o * 7, 1000) for o in range(owners)} | {(first, i) for i in range(300)} | {(1 << 60, 5), (-(1 << 60), 5)}
    return spark.createDataFrame([*rows, (None, 5), (None, None), (first, None), (1 << 59, None)], "owner long, item long")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("entries", [overlaps.ENTRIES, 50])
def test_overlaps_are_those_of_the_text(spark, monkeypatch, entries):
    monkeypatch.setattr(overlaps, "CHUNK", 32)
    monkeypatch.setattr(overlaps, "ENTRIES", entries)
    found, known = _sets(spark, 1, 200, -100), _sets(spark, 2, 90, 40)
    assert _rows(overlaps.jaccard_pairs(found)) == _rows(grouping.JACCARD(members=found))
    for k in (known, known.unionByName(known)):
        assert _rows(overlaps.purity_match(found, k)) == _rows(grouping.PURITY_MATCH(found=found, known=k))
    none = found.limit(0)
    assert _rows(overlaps.jaccard_pairs(none)) == [] == _rows(overlaps.purity_match(none, known))
    assert {(r.known, r.clean) for r in overlaps.purity_match(found, none).collect()} == {(-1, False)}


def test_an_owner_of_many_batches_is_counted_whole():
    """Batches end inside owners; ids that fit no common code are sorted apart."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lists = [(o, 9, rng.choice(spread, int(rng.integers(1, 9)), replace=False).tolist()) for o, rows, spread in ((-5, 40, 60), (2, 1, 60), (8, 90, 60)) for _ in range(rows)]
    for scale in (1, 1 << 55):
        raw = pa.RecordBatch.from_pydict({"owner": [x[0] for x in lists], "n": [x[1] for x in lists], "partners": pa.array([[v * scale for v in x[2]] for x in lists]), "sizes": pa.array([[v + 1 for v in x[2]] for x in lists])})
        packed = next(overlaps._packed(iter([raw]), False))
        got = {}
        for batch in overlaps._by_owner((packed.slice(k, 7) for k in range(0, len(lists), 7)), overlaps._pairs):
            for a, b, shared in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shared"))):
                assert (a, b) not in got
                got[a, b] = shared
        want = {}
        for o, _, some in lists:
            for v in some:
                want[o, v * scale] = want.get((o, v * scale), 0) + 1
        assert got == want


@pytest.mark.parametrize("name", ["jaccard", "purity_match"])
def test_pairs_of_owners_are_not_shuffled(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^()]*)\)", plan)
    assert dealt and all(len(re.findall(r"#\d+", keys)) == 1 for keys in dealt)
