"""Shared background of a trace: its leading components, and what is left without them.

The leading vectors come from randomised range finding on the ticks themselves, so no
task holds a matrix of all pairs of variables. A block of ``width`` vectors is multiplied by the
centred trace (a join on the variable, a sum by tick) and by its transpose (a join on the
tick, a sum by variable); between the two only a ``width`` by ``width`` table of products a
trace is put in order by one small function. With at most ``width`` variables the block spans all and
one pass is exact; beyond that passes are repeated ``passes`` times, and the error falls with the
ratio of the ``width``-th and the last wanted singular value to the power of twice the passes.

Traces of at most ``MOST_TICKS`` ticks and no fewer variables than ticks need no passes: their products of ticks with ticks are
summed over the variables, which gives the leading components exactly, and each variable's ticks lie in one row
from then on. Their values are shuffled once, by variable; a row of ticks meets its trace's components by Spark's choice of join.

A trace is (trace_id, t, var, value) with one row a tick and variable, and no null values; a tick without a
variable counts as that variable's mean. Traces with fewer than two ticks, and ``components`` of 0, keep
their values and explain nothing. A trace without spread has no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutua.storage import materialise

OVERSAMPLE, PASSES = 8, 8
#: Directions with less than this share of the block's largest product are noise of rounding.
LEAST_SHARE = 1e-13
#: Ticks whose products are summed, and parts in which a trace's variables are dealt for it.
MOST_TICKS, MOST_PARTS = 256, 4096


def centred(trace: DataFrame) -> DataFrame:
    """(trace_id, t, var, mean, x) with x the value less the variable's mean."""
    means = trace.groupBy("trace_id", "var").agg(F.avg("value").alias("mean"))
    return trace.join(means, ["trace_id", "var"]).select("trace_id", "t", "var", "mean", (F.col("value") - F.col("mean")).alias("x"))


def _block(width: int) -> list[str]:
    return [f"w{k}" for k in range(width)]


def _start(width: int, seed: int) -> list[Column]:
    """A start that depends on the variable's name only: uniform numbers from a hash, no two columns alike."""
    return [(F.pmod(F.xxhash64("var", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 19) - 1.0).alias(f"w{k}") for k in range(width)]


def _products(rows: DataFrame, width: int) -> DataFrame:
    """(trace_id, g) with the ``width`` by ``width`` products of the block's columns, row by row."""
    pairs = [F.sum(F.col(f"w{a}") * F.col(f"w{b}")) for a in range(width) for b in range(width)]
    return rows.groupBy("trace_id").agg(F.array(*pairs).alias("g"))


def _turned(rows: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """The block times each trace's own matrix ``m``, row by row."""
    mixed = [sum(F.col(f"w{a}") * F.get("m", F.lit(a * width + b)) for a in range(width)).alias(f"w{b}") for b in range(width)]
    return rows.join(turns.select("trace_id", "m"), "trace_id").select(*[c for c in rows.columns if not c.startswith("w")], *mixed)


def _orthonormal(products: DataFrame, width: int) -> DataFrame:
    """(trace_id, m, s): the matrix that makes the block's columns orthonormal and orders them by their squared lengths ``s``; null directions become 0."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for trace, g in zip(frame["trace_id"], frame["g"]):
            s, u = np.linalg.eigh(np.asarray(g, float).reshape(width, width))
            s, u = s[::-1], u[:, ::-1]
            scale = np.where(s > LEAST_SHARE * max(s[0], 0), 1 / np.sqrt(np.maximum(s, 1e-300)), 0)
            found.append((trace, (u * scale).ravel().tolist(), np.where(scale > 0, s, 0).tolist()))
        return pd.DataFrame(found, columns=["trace_id", "m", "s"])

    kind = products.schema["trace_id"].dataType.simpleString()
    return products.mapInPandas(lambda frames: map(run, frames), f"trace_id {kind}, m array<double>, s array<double>")


def leading_vectors(trace: DataFrame, components: int = 1, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(trace_id, var, mean, w0..) with orthonormal loadings of the leading components, and (trace_id, shares) with each one's share of the variance."""
    x = materialise(centred(trace), "centred")
    variables = x.groupBy("trace_id", "var").agg(F.first("mean").alias("mean"), F.sum(F.col("x") ** 2).alias("square"))
    variables = materialise(variables, "variables")
    most = variables.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    width = min(components + oversample, most)
    if not width:
        return variables.select("trace_id", "var", "mean"), variables.select("trace_id").distinct().withColumn("shares", F.array().cast("array<double>"))
    names = _block(width)
    x = x.select("trace_id", "t", "var", "x")
    block = variables.select("trace_id", "var", *_start(width, seed))
    for k in range(1 if most <= width else passes + 1):
        by_tick = x.join(block, ["trace_id", "var"]).groupBy("trace_id", "t").agg(*[F.sum(F.col("x") * F.col(w)).alias(w) for w in names])
        by_tick = materialise(by_tick, "by-tick")
        by_tick = _turned(by_tick, _orthonormal(_products(by_tick, width), width), width)
        by_variable = x.join(by_tick, ["trace_id", "t"]).groupBy("trace_id", "var").agg(*[F.sum(F.col("x") * F.col(w)).alias(w) for w in names])
        by_variable = materialise(by_variable, "by-variable")
        ordered = materialise(_orthonormal(_products(by_variable, width), width), "ordered")
        block = _turned(by_variable, ordered, width)
    total = variables.groupBy("trace_id").agg(F.sum("square").alias("total"))
    shares = ordered.join(total, "trace_id").select("trace_id", F.transform(F.slice("s", 1, components), lambda s: s / F.greatest("total", F.lit(1e-12))).alias("shares"))
    sign = lambda w: F.when(F.max_by(w, F.abs(w)) < 0, -1.0).otherwise(1.0)
    signs = block.groupBy("trace_id").agg(*[sign(w).alias(f"sign_{w}") for w in names[:components]])
    block = block.join(signs, "trace_id").select("trace_id", "var", *[(F.col(w) * F.col(f"sign_{w}")).alias(w) for w in names[:components]])
    return block.join(variables.select("trace_id", "var", "mean"), ["trace_id", "var"]), shares


def remove_background(trace: DataFrame, components: int = 1, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """(trace_id, t, var, value, share): the trace without its leading ``components``, means kept, and the share of the variance that they explained."""
    if components < 1:
        return _kept(centred(trace))
    sizes = trace.groupBy("trace_id", "t").count().groupBy("trace_id").agg(F.count(F.lit(1)).alias("ticks"), F.sum("count").alias("rows"))
    sizes = materialise(sizes.withColumn("short", (F.col("ticks") <= MOST_TICKS) & (F.col("rows") >= F.col("ticks") * F.col("ticks"))), "trace-sizes")
    kinds = {r.short for r in sizes.select("short").distinct().collect()}
    if kinds == {True}:
        return _remove_from_short(trace, sizes, components)
    if True not in kinds:
        return _remove_by_passes(trace, components, oversample, passes)
    of = lambda short: trace.join(sizes.where(F.col("short") == short).select("trace_id"), "trace_id", "left_semi")
    return _remove_from_short(of(True), sizes.where("short"), components).unionByName(_remove_by_passes(of(False), components, oversample, passes))


def _kept(x: DataFrame) -> DataFrame:
    return x.select("trace_id", "t", "var", (F.col("x") + F.col("mean")).alias("value"), F.lit(0.0).alias("share"))


def _remove_by_passes(trace: DataFrame, components: int, oversample: int, passes: int) -> DataFrame:
    ticks = trace.groupBy("trace_id").agg(F.count_distinct("t").alias("ticks"))
    x = centred(trace)
    block, shares = leading_vectors(trace, components, oversample, passes)
    names = [c for c in block.columns if c.startswith("w")]
    if not names:
        return _kept(x)
    block = materialise(block, "loadings")
    loaded = x.join(block.drop("mean"), ["trace_id", "var"])
    scores = loaded.groupBy("trace_id", "t").agg(*[F.sum(F.col("x") * F.col(w)).alias(f"score_{w}") for w in names])
    kept = loaded.join(scores, ["trace_id", "t"]).join(ticks, "trace_id").join(shares, "trace_id")
    background = F.when(F.col("ticks") > 1, sum(F.col(w) * F.col(f"score_{w}") for w in names)).otherwise(0.0)
    share = F.when(F.col("ticks") > 1, F.aggregate("shares", F.lit(0.0), lambda a, s: a + s)).otherwise(0.0)
    return kept.select("trace_id", "t", "var", (F.col("x") - background + F.col("mean")).alias("value"), share.alias("share"))


# ---- traces of few ticks
def _series(trace: DataFrame, sizes: DataFrame) -> DataFrame:
    """(trace_id, var, ts, xs) with a row for each variable, those of a trace beside each other in a task."""
    parts = sizes.select("trace_id", F.least(F.greatest(F.floor(F.col("rows") / (4 * F.col("ticks") * F.col("ticks"))), F.lit(1)), F.lit(MOST_PARTS)).alias("parts"))
    rows = trace.join(parts, "trace_id").select("trace_id", "t", "var", "value", F.pmod(F.xxhash64("var"), F.col("parts")).alias("part"))
    each = rows.repartition("trace_id", "part").groupBy("trace_id", "part", "var").agg(F.collect_list(F.struct("t", "value")).alias("rows"))
    each = each.select("trace_id", "var", F.col("rows.t").alias("ts"), F.col("rows.value").alias("xs"))
    return materialise(each.sortWithinPartitions("trace_id", "var"), "series")


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal names."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def _dense(batch: pa.RecordBatch, ticks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Variables by ``ticks``, centred, with 0 where a tick is missing; the means; row and column of each value."""
    ts, xs = batch.column("ts"), batch.column("xs")
    length = ts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    at = np.searchsorted(ticks, ts.flatten().to_numpy(zero_copy_only=False))
    x = xs.flatten().to_numpy(zero_copy_only=False).astype(float)
    mean = np.bincount(row, x, len(length)) / length
    dense = np.zeros((len(length), len(ticks)))
    dense[row, at] = x - mean[row]
    return dense, mean, row, at


def _tick_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trace_id, i, j, g) for i <= j: products of ticks over the task's variables of a trace; a task's rows are in order of traces."""
    trace, known, total = None, np.empty(0, np.int64), np.zeros((0, 0))

    def told() -> Iterator[pa.RecordBatch]:
        if len(known):
            i, j = np.triu_indices(len(known))
            yield pa.RecordBatch.from_arrays([pa.array([trace] * len(i), kind), pa.array(known[i]), pa.array(known[j]), pa.array(total[i, j])], names=["trace_id", "i", "j", "g"])

    for batch in batches:
        kind = batch.schema.field("trace_id").type
        for a, b in _runs(batch.column("trace_id")):
            part = batch.slice(a, b - a)
            name = part.column("trace_id")[0].as_py()
            if name != trace:
                yield from told()
                trace, known, total = name, np.empty(0, np.int64), np.zeros((0, 0))
            own = np.union1d(known, part.column("ts").flatten().to_numpy(zero_copy_only=False))
            if len(own) > len(known):
                grown, at = np.zeros((len(own), len(own))), np.searchsorted(own, known)
                grown[np.ix_(at, at)] = total
                known, total = own, grown
            dense = _dense(part, known)[0]
            total += dense.T @ dense
    yield from told()


def _tick_vectors(frame: pd.DataFrame, components: int) -> pd.DataFrame:
    """A trace's ticks, its leading components over them, and each one's share, as bytes of longs and doubles."""
    ticks = np.unique(frame["i"].to_numpy())
    g = np.zeros((len(ticks), len(ticks)))
    i, j = (np.searchsorted(ticks, frame[c].to_numpy()) for c in ("i", "j"))
    g[i, j] = g[j, i] = frame["g"].to_numpy()
    total = np.trace(g)
    s, u = np.linalg.eigh(g)
    s, u = s[::-1][:components], u[:, ::-1][:, :components]
    u = u * (s > LEAST_SHARE * max(s[0], 0))
    share = float(s[s > LEAST_SHARE * max(s[0], 0)].sum() / max(total, 1e-12)) if len(ticks) > 1 else 0.0
    return pd.DataFrame([(frame["trace_id"].iloc[0], ticks.astype("<i8").tobytes(), np.ascontiguousarray(u, "<f8").tobytes(), share)], columns=["trace_id", "ticks", "vectors", "share"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _runs(batch.column("trace_id")):
            part = batch.slice(a, b - a)
            ticks = np.frombuffer(part.column("ticks")[0].as_py(), "<i8")
            u = np.frombuffer(part.column("vectors")[0].as_py(), "<f8").reshape(len(ticks), -1)
            dense, mean, row, at = _dense(part, ticks)
            left = (dense - (dense @ u) @ u.T + mean[:, None])[row, at]
            ts = part.column("ts")
            ends = np.concatenate([[0], np.cumsum(ts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (ts.flatten(), pa.array(left))]
            yield pa.RecordBatch.from_arrays([part.column("trace_id"), part.column("var"), *lists, part.column("share")], names=["trace_id", "var", "ts", "values", "share"])


def _remove_from_short(trace: DataFrame, sizes: DataFrame, components: int) -> DataFrame:
    kinds = {c: trace.schema[c].dataType.simpleString() for c in ("trace_id", "t", "var")}
    series = _series(trace.where("t is not null and var is not null").withColumn("t", F.col("t").cast("long")), sizes)
    products = series.select("trace_id", "ts", "xs").mapInArrow(_tick_products, f"trace_id {kinds['trace_id']}, i long, j long, g double")
    summed = products.groupBy("trace_id", "i", "j").agg(F.sum("g").alias("g"))
    found = summed.groupBy("trace_id").applyInPandas(lambda frame: _tick_vectors(frame, components), f"trace_id {kinds['trace_id']}, ticks binary, vectors binary, share double")
    met = series.join(materialise(found, "tick-vectors"), "trace_id")
    left = met.mapInArrow(_without, f"trace_id {kinds['trace_id']}, var {kinds['var']}, ts array<long>, values array<double>, share double")
    each = left.select("trace_id", "var", "ts", "share", F.posexplode("values").alias("at", "value"))
    return each.select("trace_id", F.get("ts", "at").cast(kinds["t"]).alias("t"), "var", "value", "share")
