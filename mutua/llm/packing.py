"""Best-fit packing into several permitted sequence lengths.

Pieces of at most the largest capacity are packed by best fit in decreasing order of
length: a piece goes into the open bin that it leaves the least room in; if none
fits, a new bin is opened, of the capacity that costs least for the piece and what is
still to be packed: each capacity's cost is shared over the pieces that it would
take, the new piece first, filled greedily from the lengths that remain. At the end
every bin is downsized to the smallest capacity that holds its contents.

Documents are dealt by a hash of ids and texts into shards of about ``SHARD_TOKENS``
tokens; a shard packs lengths and ids alone. What sharding costs is at most a few
partly filled bins for each shard. Longer documents are cut into pieces of the
largest capacity and a rest, each piece with its offset, so every token is in
exactly one bin.

Defined cases: a null or empty document has length 0 and is returned with no bin;
equal lengths are ordered by id, then offset; repeated rows are pieces of their own;
an empty table gives an empty table; other columns are ignored; a negative length
counts as 0.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mutua.llm.text import WORD_PATTERN
from mutua.storage import table

QUERY = "op1_packing"
ORACLE_SQL = None  # a greedy packing has no SQL form; tests check it against a plain version and its invariants

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin besides its capacity, in tokens: what a sequence costs whatever its length.
BIN_COST = 32
SHARD_TOKENS = 4_000_000


def fill(left: dict[int, int], ordered: list[int], capacity: int, first: int) -> int:
    """Tokens that a new bin of ``capacity`` would hold: ``first``, then the longest remaining lengths that fit, once each."""
    room, held, k = capacity - first, first, len(ordered)
    while room > 0 and (k := min(k, bisect_right(ordered, room)) - 1) >= 0:
        length = ordered[k]
        take = min(left[length] - (length == first), room // length)
        room -= take * length
        held += take * length
    return held


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece, its offset in the bin, and each bin's final capacity. ``lengths`` is decreasing and positive."""
    caps = np.array(sorted(capacities))
    left: dict[int, int] = {}
    for x in lengths.tolist():
        left[x] = left.get(x, 0) + 1
    ordered = sorted(left)
    rooms: list[int] = []  # distinct rooms of open bins, sorted
    open_bins: dict[int, list[int]] = {}
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    size: list[int] = []
    used: list[int] = []
    for i, x in enumerate(lengths.tolist()):
        k = bisect_left(rooms, x)
        if k < len(rooms):
            room = rooms[k]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[k]
        else:
            fits = [int(c) for c in caps[np.searchsorted(caps, x) :]]
            b, room = len(size), min(fits, key=lambda c: ((c + bin_cost) / fill(left, ordered, c, x), c))
            size.append(room)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += x
        rest = room - x
        if rest > 0:
            if rest not in open_bins:
                open_bins[rest] = []
                insort(rooms, rest)
            open_bins[rest].append(b)
        left[x] -= 1
        if not left[x]:
            del left[x]
            del ordered[bisect_left(ordered, x)]
    return bins, offsets, caps[np.searchsorted(caps, np.array(used, np.int64))]


OUT = "doc_id long, piece_start long, piece_length long, bin_id string, bin_offset long, bin_capacity long, bin_used long"


def _pack_shard(rows: pa.Table, capacities: tuple[int, ...], bin_cost: float, out: pa.Schema) -> pa.Table:
    shard = rows.column("shard")[0].as_py()
    length = rows.column("length").to_numpy()
    order = pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]).to_numpy()
    empty = order[length[order] == 0]
    order = order[length[order] > 0]
    bins, offsets, sizes = pack(length[order], capacities, bin_cost)
    used = np.bincount(bins, length[order], len(sizes)).astype(np.int64)
    taken = rows.take(np.concatenate([order, empty]))
    none = len(empty)
    column = lambda values: pa.array(np.concatenate([values, np.zeros(none, np.int64)]), mask=np.arange(len(values) + none) >= len(values))
    names = pa.array([f"{shard}-{b}" for b in bins.tolist()] + [None] * none, pa.string())
    return pa.Table.from_arrays([taken.column("doc_id"), taken.column("start"), taken.column("length"), names, column(offsets), column(sizes[bins]), column(used[bins])], schema=out)


def word_count(text: str = "text") -> F.Column:
    """Words of the text and one end; 0 for a null or wordless text."""
    n = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN), F.lit(0)))
    return F.when(n > 0, n + 1).otherwise(0)


def pack_documents(docs: DataFrame, length: F.Column, capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: document, start and length of the piece, bin, offset in it, its capacity and what it holds."""
    most = max(capacities)
    sized = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = sized.select("doc_id", "digest", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(most).cast("long"))).alias("start"))
    pieces = pieces.select("doc_id", "digest", "start", F.least(F.col("n") - F.col("start"), F.lit(most)).alias("length"))
    total = docs.select(F.octet_length("text").alias("b")).agg(F.sum("b")).first()[0] or 0
    shards = max(1, -(-int(total) // (4 * shard_tokens)))  # a word has more than four bytes with its blank, more often than not
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "digest", "start"), F.lit(shards)).cast("int")).drop("digest")
    schema = OUT.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    out = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.groupBy("shard").applyInArrow(lambda t: _pack_shard(t, capacities, bin_cost, out), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_count())
