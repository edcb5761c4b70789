"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each shard (one Arrow batch of documents) is numbered with the benchmark's
vocabulary and gets a suffix array: the positions whose next words can begin a
match, sorted by the words that follow. Every suffix of every benchmark item is
binary-searched in it, suffixes with equal windows once; the range found lists all
verbatim occurrences. The shard's suffixes are ordered to the depth of one window, which is all
that this search compares; a position followed by a word outside the vocabulary within the
shortest window cannot match and is left out. The benchmark's own suffixes are ordered
to their ends: the longest match of a place is found by narrowing the range of suffixes
with its window word by word, so that items with a common beginning cost no more than one.
Locations of all maximal matches are listed only on request (``locate``): there are as many as
items and places that match.

The benchmark is the only thing sent to every task. Its size is checked against
``MAX_QUERY_WORDS``; a larger benchmark is searched in blocks of that size, each over all
documents, so no task holds more than a block and its largest item. No documents are
shuffled unless there are several blocks.

Defined cases: a null or wordless text has no words and is never contaminated;
a null or wordless item has no window; an item shorter than the window is one
window; equal items count separately, and repeated rows of an item_id count
once; an item without an id hits words and is not among the items found; repeated documents give repeated results; empty tables give empty or
clean results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.llm.text import alnum_words
from mutua.storage import materialise, table

QUERY = "op10_decontaminate"
WINDOW = 13
#: Words of benchmark text that one pass over the documents holds in each task (about 100 MB).
MAX_QUERY_WORDS = 1_000_000
#: Words of documents in one shard.
SHARD_WORDS = 250_000


class Suffixes:
    """The benchmark's suffixes, numbered by its own vocabulary. Word 0 is any other word or a border."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        by_words: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = tuple(number(w, len(self.vocabulary) + 1) for w in alnum_words(text))
            if ids:
                by_words.setdefault(ids, set()).update([item_id] if item_id is not None else [])
        self.item_ids = [sorted(x) for x in by_words.values()]  # of items with equal words
        self.ids = sorted(x for own in self.item_ids for x in own)
        place = {x: k for k, x in enumerate(self.ids)}
        self.id_places = np.array([place[x] for own in self.item_ids for x in own], np.int64)
        self.ids_from = np.concatenate([[0], np.cumsum([len(own) for own in self.item_ids])]).astype(np.int64)
        words, starts, owners, lengths = [], [], [], []
        at = 0
        for k, ids in enumerate(by_words):
            width = min(window, len(ids))
            own = range(at, at + len(ids) - width + 1)
            starts += own
            owners += [k] * len(own)
            lengths += [width] * len(own)
            words += [*ids, 0]
            at += len(ids) + 1
        self.words = np.array(words + [0] * window, np.int32)
        self.starts, self.owners, self.lengths = (np.array(x, np.int64) for x in (starts, owners, lengths))
        self.shortest = int(self.lengths.min()) if starts else 0
        self.item_begin = np.zeros(len(by_words), np.int64)
        self.item_begin[self.owners[::-1]] = self.starts[::-1]
        # Suffixes with equal windows: their number, and the suffixes of each.
        low = self._windows(self.starts, self.lengths)
        _, self.one, inverse = np.unique(low, return_index=True, return_inverse=True) if starts else (None, np.empty(0, np.int64), np.empty(0, np.int64))
        self.same = np.lexsort((self._ranks()[self.starts], inverse))
        self.same_from = np.searchsorted(inverse[self.same], np.arange(len(self.one) + 1))

    def _windows(self, starts: np.ndarray, lengths: np.ndarray, beyond: int = 0) -> np.ndarray:
        """Sortable bytes of each window; ``beyond`` is added to its last word."""
        w = self.window
        keys = np.zeros((len(starts), w), ">u4")
        for k in range(w):
            inside = lengths > k
            keys[inside, k] = self.words[starts[inside] + k]
        if beyond and len(starts):
            np.put_along_axis(keys, (lengths - 1)[:, None], np.take_along_axis(keys, (lengths - 1)[:, None], 1) + beyond, 1)
        return np.ascontiguousarray(keys).reshape(-1).view(f"S{4 * w}")

    def _ranks(self) -> np.ndarray:
        """The order of all suffixes to their items' ends, by doubling the words compared."""
        ranks, depth = self.words.astype(np.int64), 1
        longest = int(np.diff(np.flatnonzero(np.concatenate([[True], self.words == 0]))).max(initial=1))
        while depth < longest:
            after = np.concatenate([ranks[depth:], np.zeros(min(depth, len(ranks)), np.int64)])[: len(ranks)]
            ranks = np.unique(ranks * (ranks.max() + 1) + after, return_inverse=True)[1].astype(np.int64)
            depth *= 2
        return ranks

    def longest(self, words: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """For each place ``at`` where the window ``which`` occurs, how many words agree with some item from there."""
        low, high = self.same_from[which].copy(), self.same_from[which + 1].copy()
        depth = self.lengths[self.one][which].copy()
        live = np.arange(len(at))
        while len(live):
            ahead = at[live] + depth[live]
            live = live[ahead < len(words)]
            word = words[at[live] + depth[live]]
            live, word = live[word != 0], word[word != 0]
            begin, end = (self._first(low[live], high[live], depth[live], word + k) for k in (0, 1))
            found = begin < end
            live, begin, end = live[found], begin[found], end[found]
            low[live], high[live] = begin, end
            depth[live] += 1
        return depth

    def _first(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The first suffix of each range whose word at ``depth`` is ``word`` or more."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = np.zeros(len(low), bool)
            less[open_] = self.words[self.starts[self.same[middle[open_]]] + depth[open_]] < word[open_]
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def expand(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``which`` (numbers of windows), its place and each suffix that begins with it."""
        return _ranges(self.same_from[which], self.same_from[which + 1], self.same)

    def ids_of(self, windows: np.ndarray) -> list[str]:
        """Sorted ids of the items that have any of these windows."""
        _, suffix = self.expand(windows)
        owners = np.unique(self.owners[suffix])
        _, places = _ranges(self.ids_from[owners], self.ids_from[owners + 1], self.id_places)
        return [self.ids[k] for k in np.unique(places).tolist()]

    def search(self, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct window the range of the suffix array whose first words equal it."""
        starts, lengths = self.starts[self.one], self.lengths[self.one]
        return np.searchsorted(sorted_keys, self._windows(starts, lengths), "left"), np.searchsorted(sorted_keys, self._windows(starts, lengths, 1), "left")


def _ranges(low: np.ndarray, high: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each range, as often as it is long, and the values in it."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, values[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def suffix_array(words: np.ndarray, window: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that can begin a match, sorted by their next ``window`` words, and those words as sortable bytes."""
    n = len(words) - window
    known = np.concatenate([[0], np.cumsum(words != 0)])
    begins = np.flatnonzero(known[shortest : shortest + n] - known[:n] == shortest)
    keys = np.empty((len(begins), window), ">u4")
    for k in range(window):
        keys[:, k] = words[begins + k]
    flat = keys.reshape(-1).view(f"S{4 * window}") if len(begins) else np.empty(0, f"S{4 * window}")
    order = np.argsort(flat, kind="stable")
    return begins[order], flat[order]


def match_shard(words: np.ndarray, query: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences in a shard: the number of the window, and its position."""
    places, keys = suffix_array(words, query.window, query.shortest)
    return _ranges(*query.search(keys), places)


def longest_matches(words: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, query: Suffixes) -> np.ndarray:
    """The occurrences' verbatim lengths, extended beyond the window as far as item and document agree."""
    total = lengths.copy()
    live = np.arange(len(at))
    while len(live):
        a, b = at[live] + total[live], starts[live] + total[live]
        inside = (a < len(words)) & (b < len(query.words))
        live, a, b = live[inside], a[inside], b[inside]
        same = (words[a] == query.words[b]) & (words[a] != 0)
        live = live[same]
        total[live] += 1
    return total


def _shards(batch: pa.RecordBatch) -> Iterator[list[Any]]:
    """Rows of a batch with their words, cut so that a shard holds about SHARD_WORDS."""
    shard, n = [], 0
    for i, text in enumerate(batch.column(1).to_pylist()):
        words = alnum_words(text)
        shard.append((i, words))
        n += len(words) + 1
        if n >= SHARD_WORDS:
            yield shard
            shard, n = [], 0
    if shard:
        yield shard


_NO_ITEMS = hashlib.sha256(b"").hexdigest()
MATCH_TYPE = pa.struct([("item_id", pa.string()), ("word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())])
OUT = "n_words long, longest int, hits array<int>, items array<string>, n_items long, items_sha256 string, matches array<struct<item_id:string,word:int,item_word:int,length:int>>"


def _find(batches: Iterator[pa.RecordBatch], query: Suffixes, locate: bool, lists: bool = True) -> Iterator[pa.RecordBatch]:
    """``lists``: whether ids of items are sent, or only their number and digest."""
    number = query.vocabulary.get
    for batch in batches:
        for shard in _shards(batch):
            counts = np.array([len(w) for _, w in shard], np.int64)
            begins = np.concatenate([[0], np.cumsum(counts + 1)])
            words = np.zeros(begins[-1] + query.window, np.int32)
            for (_, own), b in zip(shard, begins.tolist()):
                words[b : b + len(own)] = [number(w, 0) for w in own]
            hits: list[list[int]] = [[] for _ in shard]
            items: list[list[str]] = [[] for _ in shard]
            digests = [(0, _NO_ITEMS)] * len(shard)
            longest = np.zeros(len(shard), np.int64)
            matches: list[list[dict]] = [[] for _ in shard]
            if len(query.starts):
                which, at = match_shard(words, query)
                lengths = query.lengths[query.one][which]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + lengths, -1)
                covered = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                doc = np.searchsorted(begins, covered, "right") - 1
                for d, p in zip(doc.tolist(), (covered - begins[doc]).tolist()):
                    hits[d].append(p)
                doc = np.searchsorted(begins, at, "right") - 1
                found = np.unique(np.stack([doc, which], 1), axis=0)
                cuts = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
                for d, windows in zip(found[cuts, 0].tolist(), np.split(found[:, 1], cuts[1:])):
                    own = query.ids_of(windows)
                    digests[d] = len(own), hashlib.sha256(",".join(own).encode("utf-8", "replace")).hexdigest()
                    if lists:
                        items[d] = own
                # A match from inside a run of hits is shorter than one from its beginning could be.
                doc, on = np.searchsorted(begins, at, "right") - 1, np.cumsum(edge)[:-1] > 0
                run_end = np.minimum.accumulate(np.where(on, len(words), np.arange(len(words)))[::-1])[::-1]
                opens = (at == 0) | ~on[at - 1]
                for part in (opens, ~opens):
                    part &= run_end[at] - at > longest[doc]
                    np.maximum.at(longest, doc[part], query.longest(words, at[part], which[part]))
                if locate:
                    row, suffix = query.expand(which)
                    at, doc, starts, owners = at[row], doc[row], query.starts[suffix], query.owners[suffix]
                    first = (at == 0) | (starts == query.item_begin[owners]) | (words[at - 1] != query.words[starts - 1]) | (words[at - 1] == 0)
                    at, doc, starts, owners = at[first], doc[first], starts[first], owners[first]
                    total = longest_matches(words, at, starts, lengths[row[first]], query)
                    for d, p, o, q, n in zip(doc.tolist(), (at - begins[doc]).tolist(), owners.tolist(), (starts - query.item_begin[owners]).tolist(), total.tolist()):
                        matches[d] += [{"item_id": x, "word": p, "item_word": q, "length": n} for x in query.item_ids[o] or [None]]
            rows = pa.array([i for i, _ in shard])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(counts), pa.array(longest.astype(np.int32)), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array([n for n, _ in digests], pa.int64()), pa.array([x for _, x in digests]), pa.array(matches, pa.list_(MATCH_TYPE))],
                names=["id", "n_words", "longest", "hits", "items", "n_items", "items_sha256", "matches"],
            )


def _blocks(benchmark: DataFrame, max_words: int) -> list[DataFrame]:
    """The benchmark in parts of at most about ``max_words`` words, by a hash of the item."""
    words = "size(split(coalesce(text, ''), '[^0-9A-Za-z\\\\x{80}-\\\\x{10ffff}]+'))"
    total = benchmark.agg(F.sum(F.expr(words))).first()[0] or 0
    n = max(1, -(-2 * int(total) // max_words)) if total > max_words else 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [benchmark]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, locate: bool = False, lists: bool = True, max_words: int = MAX_QUERY_WORDS) -> DataFrame:
    """Per document: ``id``, ``n_words``, ``hits`` (covered word positions), ``items`` (sorted ids of items found), ``longest`` (words of the longest verbatim match); with ``locate``, ``matches`` (all maximal ones); ``n_items`` and ``items_sha256``, all that is sent of the items without ``lists``."""
    kept = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, {OUT}"
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    parts = []
    for block in _blocks(items, max_words):
        query = Suffixes(sorted(((r.item_id, r.text) for r in block.collect()), key=lambda x: (x[0] is not None, x)), window)  # a block's size is bounded
        parts.append((query, block))
    if len(parts) == 1:
        query = parts[0][0]
        return kept.mapInArrow(lambda b: _find(b, query, locate, lists), schema)
    keyed = kept.withColumn("id", F.struct("id", F.xxhash64("text").alias("digest")))
    schema = f"id {keyed.schema['id'].dataType.simpleString()}, {OUT}"
    found = None
    for query, _ in parts:
        part = keyed.mapInArrow(lambda b, query=query: _find(b, query, locate), schema)
        found = part if found is None else found.unionByName(part)
    n = len(parts)
    merged = found.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.max("longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"),
        (F.count(F.lit(1)) / n).cast("int").alias("copies"),
    )
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("id.id", "n_words", "longest", "hits", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "matches")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> F.Column:
    """At least one word hit, and at least a twentieth of all words."""
    return F.expr(f"{n_hit} > 0 AND 20 * {n_hit} >= {n_words}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document the contract's columns, ``longest_match``, the words of the longest verbatim match."""
    return find_matches(docs, benchmark, window, lists=False).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        "n_items",
        "items_sha256",
        is_contaminated("size(hits)").alias("contaminated"),
        F.col("longest").cast("long").alias("longest_match"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated. Rows are known by id and text, so a null id is no exception."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_digest"))
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc_id"), "text")
    bad = contamination(keyed, benchmark, window).where("contaminated").select(F.col("doc_id.doc_id").alias("bad_id"), F.col("doc_id.digest").alias("bad_digest"))
    bad = materialise(bad.distinct(), "contaminated")  # its size then decides how it is joined
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_digest") == F.col("bad_digest")), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, w, least({WINDOW}, len(w)) AS m FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT i, item_id, m, k AS q, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, ms WHERE len(w) >= m)),
found AS (SELECT dw.r, dw.k, dw.m, iw.item_id, iw.i, iw.q FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT r, k, m FROM found)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY r),
runs AS (SELECT r, count(*) + max(m) - 1 AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY r, i, k - q ORDER BY k) AS run FROM found) GROUP BY r, i, k - q, run),
longest AS (SELECT r, max(n) AS n FROM runs GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN longest USING (r)
"""
