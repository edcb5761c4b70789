"""Readers, and the detector on a planted trace."""

import bz2
import json

import numpy as np
import pytest

from mutua.operators import detector
from mutua.sources import readers


def test_records_lines_and_results(spark, tmp_path):
    path = tmp_path / "trace.json"
    path.write_text(json.dumps([{"a": 1, "b": 2}, {"a": 3, "b": 4}]))
    got = sorted((r.t, r["var"], r.value) for r in readers.read_records(spark, str(path)).collect())
    assert got == [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0), (1, "b", 4.0)]
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.npy")
    assert readers.read_lines(spark, str(tmp_path / "none.jsonl"), "t long").count() == 0
    (tmp_path / "some.jsonl").write_text('{"t": 1}\n\n{"t": 2}\n')
    lines = readers.read_lines(spark, str(tmp_path / "some.jsonl"), "t long")
    assert lines.count() == 2
    first = readers.write_result(lines, str(tmp_path / "out"))
    assert readers.write_result(lines, str(tmp_path / "out")) != first


def test_bundles(spark, tmp_path):
    bundle = {"metadata": {"uid": "u", "dataset_type": ["NeuroPAL", "baseline"], "n_neuron": 2}, "gcamp": {"trace_array": [[1, 2, 3], [4, 5, 6]]}, "label": {"0": {"neuron_class": "AVA"}, "9": {"neuron_class": "X"}}}
    (tmp_path / "u.json.bz2").write_bytes(bz2.compress(json.dumps(bundle).encode()))
    read = readers.read_bundles(spark, str(tmp_path))
    assert sorted((r.t, r["var"], r.value) for r in readers.bundle_traces(read).collect())[0] == (0, "n0", 1.0)
    assert [(r["var"], r.neuron_class) for r in readers.bundle_classes(read).collect()] == [("n0", "AVA")]
    assert readers.cohort(read).count() == 1 and readers.cohort(read, ("heat",)).count() == 0
    nested = spark.createDataFrame([((1.0, (2,), "s"),)], "o struct<pos:double,image:struct<p:int>,name:string>")
    assert readers.numeric_leaves(nested) == ["o.pos"]
    assert readers.to_long(spark.createDataFrame([(0, 1.5, 2)], "t long, a double, b int")).count() == 2


def test_detector_finds_planted_clusters(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(2):
        hidden = np.cumsum(rng.normal(size=600)) % 6
        for k in range(3):
            x = hidden + 0.05 * rng.normal(size=600)
            rows += [("a", t, f"g{g}v{k}", float(v)) for t, v in enumerate(x)]
    rows += [("a", t, "flat", 1.0) for t in range(600)]
    out = detector.detect(spark.createDataFrame(rows, "trace_id string, t long, var string, value double"), most=3).where("k = 2").collect()
    members = sorted(sorted([*r.sensors, *r.actions, *r.internal]) for r in out)
    assert members == [["g0v0", "g0v1", "g0v2"], ["g1v0", "g1v1", "g1v2"]]
    peeled = detector.peel(spark.createDataFrame(rows, "trace_id string, t long, var string, value double"), passes=2, most=2, tolerance=1.0).collect()
    assert sorted(r["pass"] for r in peeled) in ([1], [1, 2]) and len({v for r in peeled for v in [*r.sensors, *r.actions, *r.internal]}) >= 3
