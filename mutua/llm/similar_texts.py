"""Groups of similar texts: SimHash deletion variants propose, shingle bounds and exact similarity verify.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is
``least`` or more; components of the links are the groups.

1. Texts with equal words are one node. A node has ``PRINTS`` independently seeded
   SimHash fingerprints of its distinct words (``SHORT_PRINTS`` where it has few shingles: one
   word is a larger part of a short text), its number of distinct shingles, and a parity
   sketch of them (below).
2. Each fingerprint is cut into three segments; each segment is indexed once per bit with
   that bit as a wildcard, so equal keys propose pairs of which one segment differs by at
   most one bit. Proposed pairs must be within ``NEAR_BITS`` by that fingerprint; the other
   fingerprints give further chances, which is where the recall comes from.
3. First pass: within each key every node is tried with a few hubs (the node with most
   copies, and the first by several orders), chosen by one aggregation with map-side
   combine. The pairs are linear in the index whatever the size of a group; verified
   ones join most of each dense group.
4. Second pass: pairs between different groups of the first, which alone can still change
   a group. A node that is near none of another group leaves first. Groups of many nodes
   meet only nodes of small groups, and each other where they share a key, so no group is
   compared with itself. The bounds of 5 are part of the join's condition, so what it
   returns is nearly only links.
5. Bounds: similarity s needs |A xor B| <= (|A| + |B|) (1-s)/(1+s), and sizes within s. The
   sketch has the parity of the number of shingles in each of 512 classes; the
   differing bits of two sketches are never more than |A xor B|, so the bound loses no link.
   Of texts beyond ``EXACT_SHINGLES`` the sketch holds the shingles of a hash range, and
   the bound is five standard deviations wider; texts of different ranges pass.
6. Pairs within the bounds are verified on the texts. No key, group or pair is capped or dropped.

Joins by key and with texts are always sort-merge joins (``_merged``): Spark sizes an index by its nodes, of
which it has hundreds of rows each, and texts by their compressed files, so it would broadcast either through the driver.

Defined cases: null and wordless texts are one node without shingles, alone in its
group; a text of fewer words than a shingle is one shingle; repeated rows are copies; a null
doc_id does not count as smallest; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutua.llm.simhash import SEED, fingerprint_each, segments, shingle_hashes
from mutua.llm.text import blank_words
from mutua.operators.graph import connected_components
from mutua.storage import materialise, release_shuffles

PRINTS = 2
#: Fingerprints of texts of less than ``SHORT`` distinct shingles.
SHORT_PRINTS = 6
SHORT = 32
SEGMENT_BITS = 4
#: A proposed pair's fingerprints differ in at most so many bits; texts of similarity 0.8 in 6 of 64 on average.
NEAR_BITS = 10
SHINGLE_WORDS = 5
SKETCH_LONGS = 8
#: Texts of so many distinct shingles have all of them in the sketch.
EXACT_SHINGLES = 640
DEVIATIONS = 5.0
#: Orders of nodes by which hubs are the first: exclusive-ors with these. A further hub has most copies.
ORDERS = (0, 0x5BD1E9955BD1E995, -0x3C6EF372FE94F82B)
#: Nodes of a group that counts as large in the second pass.
LARGE = 32

_PRINTS = [f"fp{k}" for k in range(SHORT_PRINTS)]
_SKETCH = [f"s{k}" for k in range(SKETCH_LONGS)]


def row_hash() -> Column:
    """Of the text as it is, to tell rows of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def sketch_level(n: int) -> int:
    """Halvings of the hash range that the sketch covers."""
    return max(0, (max(n, 1) - 1) // EXACT_SHINGLES).bit_length()


def sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """Level and parity bits, as signed longs, of distinct shingle hashes."""
    level = sketch_level(len(shingles))
    kept = shingles[shingles & np.uint64((1 << level) - 1) == 0] >> np.uint64(16)
    odd = np.bincount((kept % np.uint64(64 * SKETCH_LONGS)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return level, np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def distinct_shingles(words: list[bytes], shingle_words: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, shingle_words)) if words else np.empty(0, np.uint64)


def prints_of(n: int) -> int:
    """Fingerprints of a text of ``n`` distinct shingles."""
    return SHORT_PRINTS if n < SHORT else PRINTS


def _describe(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            words = blank_words(text)
            shingles = distinct_shingles(words, shingle_words)
            level, bits = sketch(shingles)
            prints = (fingerprint_each(words, 0, prints_of(len(shingles))) + [0] * SHORT_PRINTS)[:SHORT_PRINTS]
            longs = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED), *prints], np.uint64).view(np.int64)
            rows.append(np.concatenate([longs, [len(shingles), level], bits]))
        table = np.array(rows, np.int64).reshape(-1, 3 + SHORT_PRINTS + SKETCH_LONGS)
        names = ["node", *_PRINTS, "n", "level", *_SKETCH]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(table[:, k]) for k in range(table.shape[1]))], names=["doc_id", "row_hash", *names])


def text_nodes(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per distinct sequence of words: ``node``, fingerprints, ``n``, ``level``, sketch, ``copies`` and the first row (``first_id``, ``first_hash``)."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_hash().alias("row_hash"))
    longs = ", ".join(f"{c} long" for c in ["node", *_PRINTS, "n", "level", *_SKETCH])
    rows = kept.mapInArrow(lambda b: _describe(b, shingle_words), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, row_hash long, {longs}")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_hash")))
    same = [F.min(c).alias(c) for c in [*_PRINTS, "n", "level", *_SKETCH]]
    found = rows.groupBy("node").agg(*same, F.count(F.lit(1)).alias("copies"), first.alias("first"))
    return found.select("node", *_PRINTS, "n", "level", *_SKETCH, "copies", F.col("first.doc_id").alias("first_id"), F.col("first.row_hash").alias("first_hash"))


def variants(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per node, fingerprint of its and wildcard bit: ``key``, ``fp`` and the named columns, ``n`` among them."""
    cases = lambda of, values: "CASE " + " ".join(f"WHEN {of} < {end} THEN {v}" for end, v in values) + " END"
    parts = segments(SEGMENT_BITS)
    low = cases("i % 64", [(a + width, a) for a, width in parts])
    mask = cases("i % 64", [(a + width, f"{(1 << width) - 1}L") for a, width in parts])
    count = F.when(F.col("n") < SHORT, 64 * SHORT_PRINTS).otherwise(64 * PRINTS)
    each = nodes.select(*columns, *_PRINTS, F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    fp = cases("i", [(64 * k + 64, c) for k, c in enumerate(_PRINTS)])
    each = each.select(*columns, "i", F.expr(fp).alias("fp"), F.expr(low).alias("low"), F.expr(mask).alias("mask"))
    key = "shiftleft(CAST(i AS BIGINT), 24) | (shiftright(fp, low) & mask & ~shiftleft(1L, i % 64 - low))"
    return each.select(F.expr(key).alias("key"), "fp", *columns)


def shared_keys(index: DataFrame, by: str, least: float) -> DataFrame:
    """The rows that may have a partner, written once: their key has two values of ``by`` or more, and the next smaller or larger text of the key is of a size that allows the similarity.

    Most rows are alone in their key and go here, after one exchange of narrow rows.
    """
    key = Window.partitionBy("key")
    in_order = key.orderBy("n")
    found = index.withColumns({"least": F.min(by).over(key), "most": F.max(by).over(key), "smaller": F.lag("n").over(in_order), "larger": F.lead("n").over(in_order)})
    fits = F.coalesce(_sizes_allow(F.col("n"), F.col("smaller"), least), F.lit(False)) | F.coalesce(_sizes_allow(F.col("n"), F.col("larger"), least), F.lit(False))
    kept = materialise(found.where((F.col("least") != F.col("most")) & fits).drop("least", "most", "smaller", "larger"), "shared-keys")
    release_shuffles(index.sparkSession)
    return kept


def _sizes_allow(n: Column, n_b: Column, least: float) -> Column:
    return (n >= n_b * F.lit(least) - 1e-9) & (n_b >= n * F.lit(least) - 1e-9)


def _suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def _merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, whatever size Spark estimates."""
    return df.hint("merge")


def _near(fp: Column, fp_b: Column, n: Column, n_b: Column, least: float) -> Column:
    """Within ``NEAR_BITS``, and of sizes that allow the similarity."""
    return (F.bit_count(fp.bitwiseXOR(fp_b)) <= NEAR_BITS) & _sizes_allow(n, n_b, least)


def within_bound(least: float, a: str = "", b: str = "_b") -> Column:
    """Whether sizes and sketches allow the similarity."""
    n, n_b, level, level_b = (F.col(f"{c}{s}") for c in ("n", "level") for s in (a, b))
    bits = reduce(Column.__add__, [F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in _SKETCH])
    most = (n + n_b) * F.lit((1 - least) / (1 + least)) / F.pow(F.lit(2.0), level)
    wider = F.when(level > 0, most + DEVIATIONS * F.sqrt(most)).otherwise(most)
    return _sizes_allow(n, n_b, least) & ((level != level_b) | (bits <= wider + 1e-6))


def hub_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """``src`` < ``dst``: within each key, every node near a hub, with that hub."""
    index = shared_keys(variants(nodes, "node", "n", "copies"), "node", least)
    firsts = [F.min_by(F.col(c), F.col("node").bitwiseXOR(F.lit(x))).alias(f"{c}_{k}") for k, x in enumerate(ORDERS) for c in ("node", "fp", "n")]
    most = [F.max_by(F.col(c), F.col("copies")).alias(f"{c}_{len(ORDERS)}") for c in ("node", "fp", "n")]
    hubs = index.groupBy("key").agg(*firsts, *most).withColumnRenamed("key", "hub_key")
    near = [(F.col("node") != F.col(f"node_{k}")) & _near(F.col("fp"), F.col(f"fp_{k}"), F.col("n"), F.col(f"n_{k}"), least) for k in range(len(ORDERS) + 1)]
    met = index.join(_merged(hubs), (F.col("key") == F.col("hub_key")) & reduce(Column.__or__, near))
    other = F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(x, F.col(f"node_{k}")) for k, x in enumerate(near)]))))
    return met.select("node", other.alias("other")).select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct()


def cross_pairs(labelled: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``src`` < ``dst`` of different groups (``grp``; ``large``), near by a fingerprint and within the bounds."""
    index = shared_keys(variants(labelled, "node", "n", "grp", "large"), "grp", least)
    other = _suffixed(index, "_b")
    meets = (F.col("key") == F.col("key_b")) & (F.col("grp") != F.col("grp_b"))
    near = meets & _near(F.col("fp"), F.col("fp_b"), F.col("n"), F.col("n_b"), least)
    shared = index.where("large").groupBy("key").agg(F.min("grp").alias("g"), F.max("grp").alias("h")).where("g <> h").select(F.col("key").alias("key_b"))
    left = [
        index.where("not large").join(_merged(other), near, "left_semi"),
        index.where("large").join(_merged(other.where("not large_b")), near, "left_semi"),
        index.where("large").join(_merged(shared), F.col("key") == F.col("key_b"), "left_semi"),
    ]
    member = materialise(reduce(DataFrame.unionByName, [x.select("node") for x in left]).distinct(), "nodes-between")
    full = labelled.select("node", "grp", "large").join(nodes.drop("copies", "first_id", "first_hash"), "node").join(member, "node", "left_semi")
    full = materialise(full, "nodes-between-full")
    fat = variants(full, "node", "n", "level", "grp", "large", *_SKETCH)
    fat_b = _suffixed(fat, "_b")
    linked = near & within_bound(least)
    pairs = [
        fat.where("not large").join(_merged(fat_b), linked & (F.col("large_b") | (F.col("node") < F.col("node_b")))),
        fat.where("large").join(_merged(shared), F.col("key") == F.col("key_b"), "left_semi").join(_merged(fat_b.where("large_b")), linked & (F.col("grp") < F.col("grp_b"))),
    ]
    ends = reduce(DataFrame.unionByName, [x.select("node", "node_b") for x in pairs])
    return ends.select(F.least("node", "node_b").alias("src"), F.greatest("node", "node_b").alias("dst")).distinct()


def similarity(a: list[bytes], b: list[bytes], shingle_words: int) -> float:
    """Jaccard similarity of the sets of shingles; of wordless texts 1."""
    sets = [set(zip(*(w[k:] for k in range(shingle_words)))) if len(w) >= shingle_words else {tuple(w)} for w in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _similar_batches(batches: Iterator[pa.RecordBatch], least: float, shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
        kept = pa.array([similarity(blank_words(a), blank_words(b), shingle_words) >= least for a, b in texts], pa.bool_())
        yield batch.select(["src", "dst"]).filter(kept)


def verified(edges: DataFrame, docs: DataFrame, nodes: DataFrame, least: float, shingle_words: int) -> DataFrame:
    """The edges whose texts are similar: by the bounds first, then on the texts, each of which moves once to the edges it is in."""
    bounds = nodes.select("node", "n", "level", *_SKETCH)
    ends_b = _suffixed(bounds, "_b")
    with_src = edges.join(bounds, F.col("src") == F.col("node")).drop("node")
    likely = materialise(with_src.join(ends_b, (F.col("dst") == F.col("node_b")) & within_bound(least)).select("src", "dst"), "likely-links")
    ends = likely.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("node", F.col("first_id").alias("wanted_id"), F.col("first_hash").alias("wanted_hash"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_hash().alias("row_hash"))
    texts = texts.join(wanted, (F.col("doc_id") == F.col("wanted_id")) & (F.col("row_hash") == F.col("wanted_hash")))
    texts = materialise(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
    left = texts.select(F.col("node").alias("src"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("dst"), F.col("text").alias("text_b"))
    pairs = likely.join(_merged(left), "src").join(_merged(right), "dst").select("src", "dst", "text_a", "text_b")
    return pairs.mapInArrow(lambda b: _similar_batches(b, least, shingle_words), "src long, dst long")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and its group ``grp``: the smallest node linked with it, over any number of links."""
    group = connected_components(links).select(F.col("node").alias("member"), "component")
    return nodes.join(group, F.col("node") == F.col("member"), "left").select("node", F.coalesce("component", "node").alias("grp"))


def similar_groups(docs: DataFrame, least: float, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``node``, ``grp`` and the node's first row (``first_id``, ``first_hash``). Rows without a doc_id take no part but as copies."""
    nodes = materialise(text_nodes(docs, shingle_words), "nodes")
    named = nodes.where("first_id is not null and n > 0")
    first = materialise(verified(materialise(hub_pairs(named, least), "hub-pairs"), docs, nodes, least, shingle_words), "first-links")
    release_shuffles(docs.sparkSession)
    group = materialise(_labelled(named.select("node"), first), "first-groups")
    large = group.groupBy("grp").agg((F.count(F.lit(1)) > LARGE).alias("large")).where("large").select(F.col("grp").alias("large_grp"))
    group = group.join(large, F.col("grp") == F.col("large_grp"), "left").select("node", "grp", F.col("large_grp").isNotNull().alias("large"))
    labelled = materialise(named.select("node", *_PRINTS, "n").join(group, "node"), "labelled")
    second = materialise(verified(materialise(cross_pairs(labelled, nodes, least), "cross-pairs"), docs, nodes, least, shingle_words), "second-links")
    release_shuffles(docs.sparkSession)
    # Groups of the first pass are joined by their labels: one edge for each link found since.
    label = group.select("node", "grp")
    joined = second.join(label.select(F.col("node").alias("src"), F.col("grp").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("grp").alias("b")), "dst")
    merged = connected_components(joined.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("old"), "component")
    final = label.join(merged, F.col("grp") == F.col("old"), "left").select(F.col("node").alias("member"), F.coalesce("component", "grp").alias("grp"))
    found = nodes.select("node", "first_id", "first_hash").join(final, F.col("node") == F.col("member"), "left")
    return found.select("node", F.coalesce("grp", "node").alias("grp"), "first_id", "first_hash")


def keep_one(docs: DataFrame, least: float, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group: of the smallest doc_id, then of the least ``row_hash``. Rows without a doc_id all stay.

    A doc_id may repeat: rows of one id and different texts are different rows.
    """
    member = similar_groups(docs, least, shingle_words).where("first_id is not null")
    first = member.groupBy("grp").agg(F.min(F.struct("first_id", "first_hash")).alias("kept"))
    kept = materialise(first.select(F.col("kept.first_id").alias("kept_id"), F.col("kept.first_hash").alias("kept_hash")), "kept")
    rows = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), row_hash().alias("own_hash"))
    one = rows.join(kept, (F.col("own_id") == F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash")), "left_semi").dropDuplicates(["own_id", "own_hash"])
    return one.select("row.*").unionByName(docs.where("doc_id is null"))
