"""Near-duplicate groups by SimHash with deletion-variant signatures.

1. Every document gets a 64-bit fingerprint over its word shingles (or its distinct
   words). Equal nodes are merged first, so copies are never expanded into pairs.
2. The fingerprint is cut into ``max_bits // 2 + 1`` segments. Of two fingerprints
   within ``max_bits`` one segment differs by at most one bit, so each segment is
   indexed once per bit with that bit as a wildcard: equal keys propose a pair. Keys have
   20 to 21 bits, so unrelated fingerprints meet, ever more with their square. With
   ``held=2`` there are five segments, of which two together differ by at most one bit: keys
   of 25 bits, four times the rows and a fifth of those meetings, for the same links. It is
   the better layout beyond some 10**8 distinct fingerprints.
3. Within a key, neighbours in fingerprint order are verified first: a number of
   pairs linear in the index, which joins most of a dense group. The second pass is
   the equality join of the index with itself; its condition keeps verified links
   between different groups of the first pass only, so a group of n near copies
   does not give n*n rows. No key is capped or dropped; a hot key is one that the
   adaptive skew join can split.
4. Components of the links are the groups.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; a text of fewer words than a shingle is one shingle; ties in the bit
votes give 0; repeated rows are copies of each other; a null doc_id does not count
as smallest unless its whole group has none; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutua.llm.text import blank_words
from mutua.operators.graph import connected_components
from mutua.storage import materialise, table

QUERY = "op3_simhash"
ORACLE_SQL = None  # DuckDB has no XXH64; tests compare with brute force
SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
BITS = 64


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same things, independent for each seed; seed 0 leaves them."""
    if not seed:
        return hashes
    z = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _votes(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):  # 64 bytes a hash at a time
        votes += np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def shingle_hashes(words: list[bytes], shingle_words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where it is shorter."""
    line = b" ".join(words)
    n = len(words) - shingle_words + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[: n - 1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(begins.tolist(), ends[shingle_words - 1 :].tolist())], np.uint64)


def fingerprint_each(words: list[bytes], shingle_words: int = SHINGLE_WORDS, prints: int = 1) -> list[int]:
    """Over the shingles, repeats included; over the distinct words for ``shingle_words`` 0. One for each of ``prints`` seeds."""
    if not words:
        return [0] * prints
    hashes = shingle_hashes(words, shingle_words) if shingle_words else np.array([xxhash.xxh64_intdigest(w, SEED) for w in set(words)], np.uint64)
    return [_votes(_mixed(hashes, k)) for k in range(prints)]


def fingerprint(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> int:
    """The first of ``fingerprint_each``."""
    return fingerprint_each(words, shingle_words)[0]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(blank_words(text), shingle_words) for text in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` as a signed long."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(lambda b: _fingerprint_batches(b, shingle_words), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp long")


def segments(max_bits: int, held: int = 1) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment: so many that of two fingerprints within ``max_bits`` some ``held`` segments together differ by at most one bit."""
    n = max_bits * held // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variant_index(nodes: DataFrame, max_bits: int = MAX_BITS, held: int = 1) -> DataFrame:
    """One row per node, ``held`` segments and wildcard bit in them: ``bit`` (and which segments), ``rest`` (the segments without that bit) and the node's columns."""
    kept = [[bit for low, width in some for bit in range(low, low + width)] for some in combinations(segments(max_bits, held), held)]
    variants = F.array(
        *[
            F.struct(F.lit(k * BITS + bit).cast("int").alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits if b != bit)))).alias("rest"))
            for k, bits in enumerate(kept)
            for bit in bits
        ]
    )
    return nodes.select("*", F.explode(variants).alias("v")).select("v.bit", "v.rest", *nodes.columns)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, max_bits: int = MAX_BITS, held: int = 1) -> DataFrame:
    """Edges ``src``, ``dst`` whose components are those of all links within ``max_bits``. ``nodes`` has distinct ``node`` and ``fp``."""
    key = Window.partitionBy("bit", "rest")

    def near(other: str) -> Column:
        return F.bit_count(F.col("fp").bitwiseXOR(F.col(other))) <= max_bits

    in_order = key.orderBy("fp", "node")
    chained = variant_index(nodes.select("node", "fp"), max_bits, held).withColumns({f"{c}_before": F.lag(c).over(in_order) for c in ("node", "fp")})
    tried = chained.where(F.col("node_before").isNotNull() & near("fp_before"))
    first = materialise(tried.select(F.least("node", "node_before").alias("src"), F.greatest("node", "node_before").alias("dst")).distinct(), "first-links")
    labelled = nodes.select("node", "fp").join(connected_components(first).select(F.col("node").alias("member"), "component"), F.col("node") == F.col("member"), "left")
    labelled = materialise(labelled.select("node", "fp", F.coalesce("component", "node").alias("grp")), "labelled")
    index = variant_index(labelled, max_bits, held)
    mixed = index.withColumns({"least": F.min("grp").over(key), "most": F.max("grp").over(key)}).where("least <> most").drop("least", "most")
    mixed = materialise(mixed, "mixed-keys")
    other = mixed.select(*[F.col(c).alias(f"{c}_b") for c in mixed.columns])
    pairs = mixed.join(other, (F.col("bit") == F.col("bit_b")) & (F.col("rest") == F.col("rest_b")) & (F.col("grp") < F.col("grp_b")) & near("fp_b"))
    second = pairs.select(F.least("node", "node_b").alias("src"), F.greatest("node", "node_b").alias("dst")).distinct()
    return first.unionByName(materialise(second, "second-links"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, held: int = 1) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, the smallest doc_id of its group."""
    prints = materialise(fingerprints(docs, shingle_words), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.col("fp")), "nodes")
    group = materialise(connected_components(materialise(links(nodes, max_bits, held), "links")), "groups")
    member = nodes.join(group.select(F.col("node").alias("member"), "component"), F.col("node") == F.col("member"), "left")
    member = member.select("node", "first_id", F.coalesce("component", "node").alias("grp"))
    least = member.groupBy("grp").agg(F.min("first_id").alias("component_id"))
    return prints.join(member.join(least, "grp").select("node", "component_id"), F.col("fp") == F.col("node")).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
