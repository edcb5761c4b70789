"""Overlaps of sets that share items, counted where each owner's rows lie.

Sets are rows (owner, item, n) of longs, ``n`` the size of the owner's set. Every row is sent once to its owner's partition, with the other
sets that have the item: ids and sizes as differences of seven-bit groups, some three bytes a pair. Pairs are
never shuffled as rows, and no task holds more than a batch and one owner's distinct partners. An item of
many owners has its partners in chunks, so no row is longer than one, and Spark may split its join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutua.storage import materialise, release_shuffles

#: Partners of an item in one row.
CHUNK = 256
#: Rows of a batch that leaves a task.
OUT_ROWS = 200_000
#: Entries that are counted at once.
ENTRIES = 4_000_000

Counted = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def sized(members: DataFrame, label: str) -> DataFrame:
    """(owner, item, n) of (owner, item), written once: ``n`` has every row of the owner, those without an item too."""
    rows = members.select("owner", "item", F.count(F.lit(1)).over(Window.partitionBy("owner")).alias("n"))
    rows = materialise(rows, label)
    release_shuffles(members.sparkSession)
    return rows


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed longs as groups of seven bits, small ones in few bytes, and the end of each."""
    bits = ((values << 1) ^ (values >> 63)).view(np.uint64)
    length = np.ones(len(bits), np.int64)
    for k in range(1, 10):
        longer = bits >= np.uint64(1 << 7 * k)
        if not longer.any():
            break
        length += longer
    ends = np.cumsum(length)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    left, at = bits, ends - length
    for k in range(int(length.max(initial=0))):
        some = length > k
        if not some.all():
            left, at, length = left[some], at[some], length[some]
        byte = left.astype(np.uint8) & np.uint8(127)
        byte[length > k + 1] |= np.uint8(128)
        out[at + k] = byte
        left = left >> np.uint64(7)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The longs that ``pack`` wrote."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    length = ends - starts + 1
    bits = np.zeros(len(ends), np.uint64)
    for k in range(int(length.max(initial=0))):
        some = length > k
        bits[some] |= (data[starts[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return (bits >> np.uint64(1)).view(np.int64) ^ -(bits & np.uint64(1)).view(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and each row's length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], later: bool) -> Iterator[pa.RecordBatch]:
    """Each row's partners and their sizes as one string of bytes; with ``later``, of the partners with larger ids only."""
    for batch in batches:
        owner = batch.column("owner").to_numpy()
        partner, length = _flat(batch.column("partners"))
        n, _ = _flat(batch.column("sizes"))
        row = np.repeat(np.arange(len(owner)), length)
        if later:
            kept = partner > owner[row]
            partner, n, row = partner[kept], n[kept], row[kept]
            length = np.bincount(row, minlength=len(owner))
        mixed = np.empty((len(partner), 2), np.int64)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for k, (values, start) in enumerate(((partner, owner[row[first]]), (n, 0))):
            mixed[1:, k] = values[1:] - values[:-1]
            mixed[first, k] = values[first] - start
        data, ends = pack(mixed.reshape(-1))
        ends = np.concatenate([[0], ends])[2 * np.concatenate([[0], np.cumsum(length)])]
        column = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        kept = pa.array(length > 0)
        out = [batch.column("owner"), batch.column("n"), pa.array(length.astype(np.int32)), column]
        yield pa.RecordBatch.from_arrays(out, names=["owner", "n", "length", "partners"]).filter(kept)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, its size, partner and its size of each entry of a batch's rows."""
    owner, n = batch.column("owner").to_numpy(), batch.column("n").to_numpy()
    length = batch.column("length").to_numpy().astype(np.int64)
    column = batch.column("partners")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    mixed = unpack(np.frombuffer(data, np.uint8)[at[0] : at[-1]]).reshape(-1, 2)
    # Sums over all rows, less what they were where the row began; partners begin at the row's owner.
    first = np.cumsum(length) - length
    total = np.cumsum(mixed, axis=0)
    before = total[first] - mixed[first]
    return np.repeat(owner, length), np.repeat(n, length), total[:, 0] + np.repeat(owner - before[:, 0], length), total[:, 1] - np.repeat(before[:, 1], length)


def _counted(owner: np.ndarray, n: np.ndarray, partner: np.ndarray, size: np.ndarray, times: np.ndarray | None = None) -> Counted:
    """Each owner's distinct partners and how often each comes. ``owner`` is in order."""
    begins = np.diff(owner, prepend=owner[:1]) != 0
    place = np.cumsum(begins)
    low = partner.min()
    wide = [int(x).bit_length() for x in (place[-1], int(partner.max()) - int(low), size.max())]
    if sum(wide) < 64 and times is None and size.min() >= 0:
        code = np.sort(place << wide[1] + wide[2] | partner - low << wide[2] | size)
        cut = np.flatnonzero(np.diff(code, prepend=-1))
        shared, code = np.diff(cut, append=len(code)), code[cut]
        at = np.searchsorted(place, code >> wide[1] + wide[2])
        return owner[at], n[at], (code >> wide[2] & (1 << wide[1]) - 1) + low, code & (1 << wide[2]) - 1, shared
    order = np.lexsort((partner, place))
    place, partner = place[order], partner[order]
    cut = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(partner, prepend=partner[:1]) != 0))
    shared = np.diff(cut, append=len(order)) if times is None else np.add.reduceat(times[order], cut)
    at = order[cut]
    return owner[at], n[at], partner[cut], size[at], shared


def _merged(parts: list[Counted]) -> Counted:
    if len(parts) == 1:
        return parts[0]
    owner, n, partner, size, times = (np.concatenate(x) for x in zip(*parts))
    return _counted(owner, n, partner, size, times)


def _by_owner(batches: Iterator[pa.RecordBatch], result: Callable[[Counted], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``result`` of whole owners. Rows are in order of owners; what an owner has so far waits for its next batch, as counts."""
    held: Counted | None = None
    for batch in batches:
        ends = np.cumsum(batch.column("length").to_numpy().astype(np.int64))
        cuts = np.unique(np.searchsorted(ends, np.arange(ENTRIES, ends[-1] if len(ends) else 0, ENTRIES), "right"))
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)]):
            if a == b:
                continue
            found = _counted(*_entries(batch.slice(a, b - a)))
            if held is not None:
                same = np.searchsorted(found[0], held[0][0], "right") if found[0][0] == held[0][0] else 0
                first = _merged([held, tuple(x[:same] for x in found)]) if same else held
                if same == len(found[0]):
                    held = first
                    continue
                yield from result(first)
                found = tuple(x[same:] for x in found)
            last = np.searchsorted(found[0], found[0][-1])
            if last:
                yield from result(tuple(x[:last] for x in found))
            held = tuple(x[last:].copy() for x in found)
    if held is not None:
        yield from result(held)


def _similarity(found: Counted) -> np.ndarray:
    _, n, _, size, shared = found
    return shared.astype(float) / (n + size - shared)


def _pairs(found: Counted) -> Iterator[pa.RecordBatch]:
    owner, _, partner, _, shared = found
    similarity = _similarity(found)
    for k in range(0, len(owner), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + OUT_ROWS]) for x in (owner, partner, shared, similarity)], names=["a", "b", "shared", "jaccard"])


def _best(found: Counted) -> Iterator[pa.RecordBatch]:
    """Each owner's most similar partner; of equally similar ones that with the smallest id."""
    owner, _, partner, size, shared = found
    place = np.cumsum(np.diff(owner, prepend=owner[:1]) != 0)
    order = np.lexsort((partner, -_similarity(found), place))
    at = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
    yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (owner, partner, shared, size)], names=["owner", "known", "shared", "known_size"])


def _partners(members: DataFrame, others: DataFrame, later: bool) -> DataFrame:
    """Rows of ``members`` in their owner's partition and order, with all partners that have the item, packed."""
    place = F.row_number().over(Window.partitionBy("item").orderBy("owner"))
    dealt = others.where("item is not null and owner is not null").select("item", "owner", "n", F.floor((place - 1) / CHUNK).alias("chunk"))
    lists = dealt.groupBy("item", "chunk").agg(F.sort_array(F.collect_list(F.struct("owner", "n"))).alias("rows"), F.max("owner").alias("last"))
    lists = lists.select(F.col("item").alias("their_item"), F.col("rows.owner").alias("partners"), F.col("rows.n").alias("sizes"), "last")
    meets = (F.col("item") == F.col("their_item")) & (F.col("last") > F.col("owner")) if later else F.col("item") == F.col("their_item")
    met = members.where("owner is not null").join(lists.hint("merge"), meets).select("owner", "n", "partners", "sizes")
    packed = met.mapInArrow(lambda b: _packed(b, later), "owner long, n long, length int, partners binary")
    return packed.repartition("owner").sortWithinPartitions("owner")


def jaccard_pairs(members: DataFrame) -> DataFrame:
    """What ``grouping.JACCARD`` gives of (owner, item) of longs."""
    rows = sized(members.select("owner", "item").distinct(), "sized")
    return _partners(rows, rows, True).mapInArrow(lambda b: _by_owner(b, _pairs), "a long, b long, shared long, jaccard double")


def purity_match(found: DataFrame, known: DataFrame) -> DataFrame:
    """What ``grouping.PURITY_MATCH`` gives of two tables (owner, item) of longs."""
    f, k = sized(found, "sized-found"), sized(known, "sized-known")
    best = _partners(f, k, False).mapInArrow(lambda b: _by_owner(b, _best), "owner long, known long, shared long, known_size long")
    sizes = f.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    shared = F.coalesce("shared", F.lit(0).cast("long"))
    return sizes.join(best.withColumnRenamed("owner", "matched"), F.col("owner") == F.col("matched"), "left").select(
        "owner",
        F.coalesce("known", F.lit(-1).cast("long")).alias("known"),
        F.coalesce(F.col("shared").cast("double") / F.col("known_size"), F.lit(0.0)).alias("recall"),
        ((F.col("n") - shared).cast("double") / F.col("n")).alias("extra"),
        (shared == F.col("n")).alias("clean"),
    )
