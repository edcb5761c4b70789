"""Directional flows given grown keys, and scores of variables against blocks.

The flow from a source to a target is I(target later; source now | target now, keys now), smoothed. Labels of
a tick make one vector; a task takes a stretch of ticks of one trace, and refines the cells of the
target by the keys already chosen before it tries each further key, so no table joins several variables by
tick. Only counts of cells are shuffled; all flows of a round are one job.

``labels`` has (trace_id, t, element, label): an element is a variable or a block of variables, a struct (block, var); ticks are whole numbers and
those that lack an element are left out. Ties between keys go to the first in order. Flows of fewer than 10 ticks are 0; without ticks there are none.
Null labels are not allowed; empty inputs give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutua.operators.information import _entropy_terms
from mutua.storage import materialise

#: Ticks in one stretch.
STRETCH = 16_384
ALPHA = 0.1
BUDGET = 64
ELEMENT = "element struct<block:string,var:string>"


def single(var: str = "var") -> Column:
    """A variable as an element."""
    return F.struct(F.lit(None).cast("string").alias("block"), F.col(var).cast("string").alias("var"))


def variable_labels(binary: DataFrame) -> DataFrame:
    """Labels of the variables of (trace_id, t, var, x), numbered from 0 in order of their values."""
    values = binary.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("t").cast("long").alias("t"), single().alias("element"), "x")
    return _numbered(values, F.col("x"))


def _numbered(values: DataFrame, order: Column) -> DataFrame:
    known = values.select("trace_id", "element", "x").distinct()
    numbers = known.withColumn("label", F.row_number().over(Window.partitionBy("trace_id", "element").orderBy(order)) - 1)
    return values.join(numbers, ["trace_id", "element", "x"]).select("trace_id", "t", "element", "label")


def _ticks(labels: DataFrame, lag: int) -> tuple[DataFrame, DataFrame]:
    """(trace_id, elements, sizes) with the number of each element's labels, and (trace_id, stretch, x, y) with the labels now and later."""
    names = labels.groupBy("trace_id", "element").agg((F.max("label") + 1).alias("size")).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("element", "size"))).alias("named"))
    names = materialise(names.select("trace_id", F.col("named.element").alias("elements"), F.col("named.size").alias("sizes")), "elements")
    ticks = labels.groupBy("trace_id", "t").agg(F.array_sort(F.collect_list(F.struct("element", "label"))).alias("named")).join(names, "trace_id").where("named.element = elements")
    ticks = materialise(ticks.select("trace_id", "t", F.col("named.label").alias("x")), "ticks")
    pairs = ticks.join(ticks.select("trace_id", (F.col("t") - lag).alias("t"), F.col("x").alias("y")), ["trace_id", "t"])
    return names, materialise(pairs.select("trace_id", F.floor(F.col("t") / STRETCH).alias("stretch"), "x", "y"), "pairs")


_CELLS = "trace_id string, src int, dst int, ring int, key int, x int, y int, z long, n long"
_NAMES = [c.split()[0] for c in _CELLS.split(", ")]


def _cells(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Counts of (target later, source, cell of target and keys) for every asked flow over one stretch."""
    if not len(own) or not len(asked):
        return pd.DataFrame(columns=_NAMES)
    now, later, sizes = np.vstack(own["x"]).astype(np.int64), np.vstack(own["y"]).astype(np.int64), np.asarray(asked["sizes"].iloc[0], np.int64)
    found = []
    for row in asked.itertuples(index=False):
        cell = now[:, row.dst]
        for k in row.chosen:
            cell = cell * sizes[k] + now[:, k]
        ends = later[:, row.dst] * sizes[row.src] + now[:, row.src]
        width = int(sizes[row.dst] * sizes[row.src])
        for key in row.pool if len(row.pool) else [-1]:
            z = cell if key < 0 else cell * sizes[key] + now[:, key]
            codes, n = np.unique(z * width + ends, return_counts=True)
            z, ends_of = np.divmod(codes, width)
            x, y = np.divmod(ends_of, sizes[row.src])
            found.append(np.stack([np.full(len(n), row.src), np.full(len(n), row.dst), np.full(len(n), row.ring), np.full(len(n), key), x, y, z, n], 1))
    return pd.DataFrame(np.concatenate(found), columns=_NAMES[1:]).assign(trace_id=own["trace_id"].iloc[0])[_NAMES]


def _flows(names: DataFrame, ticks: DataFrame, asked: DataFrame, alpha: float) -> DataFrame:
    """(trace_id, src, dst, ring, key, te) for asked flows (trace_id, src, dst, ring, chosen, pool), elements by place; ``ring`` only tells flows apart. Without a pool there is one flow, of key -1."""
    stretches = ticks.select("trace_id", F.col("stretch").alias("part")).distinct()
    spread = asked.join(names.select("trace_id", "sizes"), "trace_id").join(stretches, "trace_id")
    counted = ticks.groupBy("trace_id", "stretch").cogroup(spread.groupBy("trace_id", "part")).applyInPandas(_cells, _CELLS)
    keys = F.struct("trace_id", "src", "dst", "ring", "key")
    cells = counted.groupBy(keys.alias("keys"), "x", "y", "z").agg(F.sum("n").alias("n"))
    cells = materialise(cells, "cells")
    te = cells.sparkSession.sql(f"WITH cells AS (SELECT * FROM {{counted}}), {_entropy_terms(alpha)} SELECT keys, cmi AS te FROM cmi", counted=cells)
    return te.select("keys.*", "te")


def grown_flows(labels: DataFrame, depth: int = 2, lag: int = 1, alpha: float = ALPHA) -> DataFrame:
    """(trace_id, src, dst, keys, plain, best) of every ordered pair: up to ``depth`` keys, each the one that gives most beside those before; ``best`` is the most of all stages."""
    names, ticks = _ticks(labels, lag)
    place = lambda c: names.select("trace_id", F.posexplode("elements").alias(c, "_")).drop("_")
    pairs = place("src").join(place("dst"), "trace_id").where("src <> dst").join(names.select("trace_id", F.size("elements").alias("n")), "trace_id")
    none = F.array().cast("array<int>")
    asked = pairs.select("trace_id", "src", "dst", F.lit(0).alias("ring"), none.alias("chosen"), none.alias("pool"))
    state = materialise(_flows(names, ticks, asked, alpha).select("trace_id", "src", "dst", none.alias("chosen"), F.col("te").alias("plain"), F.col("te").alias("best")), "flows")
    for _ in range(depth):
        free = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.concat("chosen", F.array("src", "dst")))
        asked = state.join(names.select("trace_id", F.size("elements").alias("n")), "trace_id").select("trace_id", "src", "dst", F.lit(0).alias("ring"), "chosen", free.alias("pool")).where("size(pool) > 0")
        tried = _flows(names, ticks, asked, alpha).groupBy("trace_id", "src", "dst").agg(F.max(F.struct("te", (-F.col("key")).alias("k"))).alias("most"))
        grown = state.join(tried, ["trace_id", "src", "dst"], "left")
        state = materialise(grown.select("trace_id", "src", "dst", F.when(F.col("most").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array(-F.col("most.k")))).alias("chosen"), "plain", F.greatest("best", "most.te").alias("best")), "flows")
    of = lambda c: F.get("elements", F.col(c)).alias(c)
    return state.join(names, "trace_id").select("trace_id", of("src"), of("dst"), F.transform("chosen", lambda k: F.get("elements", k)).alias("keys"), "plain", "best")


def grown_scores(flows: DataFrame, fused: DataFrame, environment: str | None = None) -> DataFrame:
    """(trace_id, var, push_in, out_sys, out_env, polarity, total_flow): fused intake (trace_id, var, push_in) and grown flows to all others, to the environment alone in ``out_env``."""
    to = lambda c: F.when(F.col("dst.var") == c, F.col("best")) if c is not None else F.lit(None).cast("double")
    out = flows.groupBy("trace_id", F.col("src.var").alias("var")).agg(F.sum("best").alias("out_sys"), F.max(to(environment)).alias("out_env"))
    return _scored(out.join(fused.select("trace_id", "var", "push_in"), ["trace_id", "var"]))


def _scored(rows: DataFrame) -> DataFrame:
    total = F.col("out_sys") + F.col("push_in")
    return rows.select("trace_id", "var", "push_in", "out_sys", "out_env", F.when(total > 0, (F.col("out_sys") - F.col("push_in")) / total).otherwise(0.0).alias("polarity"), total.alias("total_flow"))


def block_labels(binary: DataFrame, blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Labels of every variable, of every block (trace_id, var, block), and of every block without each of its members: the ``budget`` - 1 most frequent joint states, and one for the rest. Ties between states go by hash."""
    own = binary.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("t").cast("long").alias("t"), F.col("var").cast("string").alias("var"), "x")
    members = blocks.where("block IS NOT NULL").select(F.col("trace_id").cast("string").alias("trace_id"), F.col("var").cast("string").alias("var"), F.col("block").cast("string").alias("block")).distinct()
    state = own.join(members, ["trace_id", "var"]).withColumn("h", F.xxhash64("var", "x"))
    # A joint state is the sum of its members' hashes; without a member, the sum less its own.
    whole = state.groupBy("trace_id", "t", "block").agg(F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("k"))
    parts = whole.select("trace_id", "t", F.struct("block", F.lit(None).cast("string").alias("var")).alias("element"), F.col("s").cast("string").alias("x"))
    without = state.join(whole.where("k > 1"), ["trace_id", "t", "block"]).select("trace_id", "t", F.struct("block", "var").alias("element"), (F.col("s") - F.col("h")).cast("string").alias("x"))
    joint = materialise(parts.unionByName(without), "joint-states")
    ranked = joint.groupBy("trace_id", "element", "x").count().withColumn("label", F.least(F.row_number().over(Window.partitionBy("trace_id", "element").orderBy(F.desc("count"), F.xxhash64("x"))), F.lit(budget)) - 1)
    fused = joint.join(ranked, ["trace_id", "element", "x"]).select("trace_id", "t", "element", "label")
    return variable_labels(binary).unionByName(fused)


def block_scores(binary: DataFrame, blocks: DataFrame, architecture: str = "keyring", environment: str | None = None, budget: int = BUDGET, lag: int = 1, alpha: float = ALPHA) -> DataFrame:
    """Scores of each variable against blocks, its own block without it, and single variables that are in none: (trace_id, var, push_in, out_sys, out_env, polarity, total_flow).

    ``keyring`` conditions on the variable's own block wherever that gives more, ``menu`` on the best single element.
    """
    if architecture not in ("keyring", "menu"):
        raise ValueError(f"no architecture {architecture}")
    names, ticks = _ticks(block_labels(binary, blocks, budget), lag)
    at = names.select("trace_id", F.posexplode("elements").alias("place", "element"))
    at = materialise(at.select("trace_id", "place", "element.block", "element.var"), "places")
    variables = at.where("block IS NULL").select("trace_id", "var", F.col("place").alias("v"))
    own = at.where("block IS NOT NULL AND var IS NOT NULL").select("trace_id", "var", F.col("place").alias("own"), F.col("block").alias("my_block"))
    mine = blocks.where("block IS NOT NULL").select(F.col("trace_id").cast("string").alias("trace_id"), F.col("var").cast("string").alias("var"), F.col("block").cast("string").alias("my_block")).distinct()
    variables = materialise(variables.join(own, ["trace_id", "var"], "left").drop("my_block").join(mine, ["trace_id", "var"], "left"), "variables")
    free = at.where("block IS NULL").join(mine.select("trace_id", "var"), ["trace_id", "var"], "left_anti").select("trace_id", F.col("place").alias("e"), F.lit(None).cast("string").alias("of"))
    others = free.unionByName(at.where("block IS NOT NULL AND var IS NULL").select("trace_id", F.col("place").alias("e"), F.col("block").alias("of")))
    elements = variables.join(others, "trace_id").where("e <> v AND (of IS NULL OR my_block IS NULL OR of <> my_block)").select("trace_id", "v", "e", "own")
    elements = materialise(elements.unionByName(variables.where("own IS NOT NULL").select("trace_id", "v", F.col("own").alias("e"), "own")), "targets")
    ring = F.when(F.col("own").isNotNull() & (F.col("e") != F.col("own")), F.array("own")).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    ask = lambda rows, src, dst, no, chosen, pool=none: rows.select("trace_id", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(no).alias("ring"), chosen.alias("chosen"), pool.alias("pool"))
    world = at.where((F.col("var") == environment) & F.col("block").isNull()).select("trace_id", F.col("place").alias("w")) if environment is not None else None
    to_world = variables.join(world, "trace_id").where("v <> w") if world is not None else None
    if architecture == "keyring":
        asked = ask(elements, "e", "v", 0, ring).unionByName(ask(elements, "v", "e", 1, none)).unionByName(ask(elements.where("own IS NOT NULL AND e <> own"), "v", "e", 2, F.array("own")))
        if to_world is not None:
            asked = asked.unionByName(ask(to_world, "v", "w", 3, none)).unionByName(ask(to_world.where("own IS NOT NULL"), "v", "w", 3, F.array("own")).withColumn("ring", F.lit(4)))
    else:
        menu = elements.groupBy("trace_id", "v").agg(F.collect_list("e").alias("menu"))
        keyed = elements.join(menu, ["trace_id", "v"]).withColumn("pool", F.array_remove("menu", F.col("e"))).where("size(pool) > 0")
        asked = ask(elements, "e", "v", 0, none).unionByName(ask(elements, "v", "e", 1, none)).unionByName(ask(keyed, "v", "e", 2, none, F.col("pool")))
        if to_world is not None:
            asked = asked.unionByName(ask(to_world, "v", "w", 3, none)).unionByName(ask(to_world.join(menu, ["trace_id", "v"]), "v", "w", 4, none, F.col("menu")))
    te = materialise(_flows(names, ticks, asked, alpha), "flows")
    pushed = te.where("ring = 0").groupBy("trace_id", F.col("dst").alias("v")).agg(F.sum("te").alias("push_in"))
    sent = te.where("ring IN (1, 2)").groupBy("trace_id", "src", "dst").agg(F.max("te").alias("te")).groupBy("trace_id", F.col("src").alias("v")).agg(F.sum("te").alias("out_sys"))
    out = te.where("ring IN (3, 4)").groupBy("trace_id", F.col("src").alias("v")).agg(F.max("te").alias("out_env"))
    return _scored(variables.select("trace_id", "var", "v").join(pushed, ["trace_id", "v"]).join(sent, ["trace_id", "v"]).join(out, ["trace_id", "v"], "left"))
