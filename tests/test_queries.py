"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mutua.plans import registry

#: A query of each kind; the driver compares all of them.
CHOSEN = ("quantile_bins", "lag_max_mi", "smoothed_cmi", "transfer_entropy", "role_classification", "weak_members", "pairwise_scores", "auroc", "sliding_segments", "adjusted_rand", "fisher_pool", "resample_uniform", "json_field", "jaccard", "next_operation", "conservation", "truncate_aligned", "full_outer", "controls")


def _cell(v):
    if pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return float(v) if isinstance(v, (int, float, np.number)) else str(v)


def _plain(df: pd.DataFrame) -> list[tuple]:
    """Cells of every row, columns by name, in an order that close numbers do not change."""
    rows = [tuple(_cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: repr([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]))


def _same(a, b) -> bool:
    return a == pytest.approx(b, rel=1e-9, abs=2e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, duck, sf_dir, name):
    want = duck.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert len(want) == len(got)
    for a, b in zip(_plain(want), _plain(got)):
        assert all(map(_same, a, b)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_each_view_of_a_query_is_written_once(spark, sf_dir, monkeypatch):
    from mutua.sources import views

    written, put = [], views.materialise
    monkeypatch.setattr(views, "materialise", lambda df, name: (written.append(name), put(df, name))[1])
    for name in ("next_operation", "cluster_rank"):
        written.clear()
        registry.queries()[name](spark, sf_dir)
        assert len(written) == len(set(written)) > 1


def test_scratch_is_under_one_folder(spark, sf_dir):
    from mutua import storage

    assert storage.scratch(spark, "x").startswith(storage.run_dir(spark)) and spark.sparkContext.applicationId in storage.run_dir(spark)


def test_greedy_match(spark):
    from mutua.operators import relational

    rows = [("g", 1, 1, 5), ("g", 1, 2, 9), ("g", 2, 2, 8), ("g", 2, 1, 1), ("g", 3, 2, 7), ("h", 1, 1, 2)]
    got = relational.greedy_match(spark.createDataFrame(rows, "grp string, a long, b long, n long")).collect()
    assert sorted((r.grp, r.a, r.b, r.n) for r in got) == [("g", 1, 2, 9), ("g", 2, 1, 1), ("h", 1, 1, 2)]


def test_null_of_a_users_statistic(spark):
    from mutua.operators import relational

    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    series = {"a": {"x": x, "y": x + 0.1 * rng.normal(size=200)}, "b": {"x": x, "y": rng.normal(size=200)}}
    trace = spark.createDataFrame([(k, t, v, float(z)) for k, by in series.items() for v, zs in by.items() for t, z in enumerate(zs)], "trace_id string, t long, var string, value double")

    def coupling(table):
        wide = table.groupBy("trace_id", "t").pivot("var", ["x", "y"]).sum("value")
        return wide.groupBy("trace_id").agg({"*": "count"}).drop("count(1)").join(wide.groupBy("trace_id").agg(F.abs(F.corr("x", "y")).alias("score")), "trace_id")

    got = {r.trace_id: r for r in relational.null_p_value(trace, coupling, 49).collect()}
    assert got["a"].p == 1 / 50 and got["a"].z > 5 and got["b"].p > 0.05
    assert relational.null_distribution(trace, coupling, 7).count() == 14


def test_nulls_have_as_many_samples_as_the_reference(spark, sf_dir):
    floors = registry.queries()["null_floors"](spark, sf_dir).collect()
    assert floors and {r.n for r in floors} == {200}


def test_sets_are_of_whole_ids(spark, duck, sf_dir):
    bought = {}
    for owner, item in duck.execute("SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey").fetchall():
        bought.setdefault(owner, set()).add(item)
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in registry.queries()["jaccard"](spark, sf_dir).collect()}
    want = {(a, b): len(x & y) for a, x in bought.items() for b, y in bought.items() if a < b and x & y}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(abs(j - n / len(bought[a] | bought[b])) < 1e-8 for (a, b), (n, j) in got.items())
    supplied = {}
    for owner, item in duck.execute("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem").fetchall():
        supplied.setdefault(owner, set()).add(item)
    matches = registry.queries()["purity_match"](spark, sf_dir).collect()
    assert {r.owner for r in matches} == set(bought)
    for r in matches:
        x = bought[r.owner]
        best = min((-len(x & y) / len(x | y), k) for k, y in supplied.items())[1]
        assert r.known == best and abs(r.recall - len(x & supplied[best]) / len(supplied[best])) < 1e-8


@pytest.mark.parametrize(("name", "kind", "column"), [("customer_part_components", "part", "l_partkey"), ("components", "supplier", "l_suppkey")])
def test_components_of_whole_tables(spark, duck, sf_dir, name, kind, column):
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for c, p in duck.execute(f"SELECT DISTINCT o_custkey, {column} FROM orders JOIN lineitem ON l_orderkey = o_orderkey").fetchall():
        a, b = sorted((root(f"customer {c}"), root(f"{kind} {p}")))
        parent[b] = a
    got = {r.node: r.component for r in registry.queries()[name](spark, sf_dir).collect()}
    assert got == {i: root(i) for i in parent}
