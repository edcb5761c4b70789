"""Frequent phrases by dynamic itemset counting, and the collocations among them.

The corpus is cut into ``SHARDS`` shards, scanned one after the other, again and again.
A scan counts all phrases that are active, of every length at once. Words are active from the
first scan; a longer phrase becomes active after the scan in which the later of its two
subphrases (without the last word, without the first) reached the threshold, and stays so for
one full cycle, in which it meets every shard once. The scans end a cycle after
the last phrase that reached the threshold, and after ``shards`` scans for each length at the latest: words have
then had their cycle, and each length begins its own when the length before has ended.

Words are 64-bit codes of language and word, phrases are known by two numbers made of
their words' codes: a key of 58 bits, whose low bits tell the scan in which it began, and a check of 32. Which keys
have reached the threshold, and after which scan, is in a table of ``2 ** SLOT_BITS`` bytes with two
slots a phrase: all that is sent to tasks, of fixed size. Where phrases share slots, one is active too
early or needlessly, which costs counting and changes no result: counts are by key and check.

Each task sums its own counts before they are shuffled. The counts of active phrases are a
table of their own; those that have completed their cycle leave it, and are kept if they
reached the threshold. In the end each frequent phrase is spelled: a pass over the shards, which hold the texts beside the codes, sends
the words of some ``SPELLED`` occurrences of each, however many there are (a hash of the place
decides), and passes go on for those that none was sent of, then with every occurrence. Scans are written
before the next begins, so a lost executor repeats a part of one scan.

Defined cases: a null text is empty; a null lang is ``und``; a piece without words has no
phrase; equal scores and counts are in order of the phrase's bytes; repeated rows count
each for itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.storage import discard, materialise, scratch, table

QUERY = "op13_collocations"
NO_LANG = "und"
MIN_COUNT = 100
LONGEST = 5
SHARDS = 3
TOP = 2000
#: A phrase goes if a longer candidate that contains it has at least this share of its occurrences.
ABSORBED_PERCENT = 100
SLOT_BITS = 25
#: Bytes of text that a task holds arrays for at a time, and distinct phrases that it sums before it sends them.
GROUP_BYTES, GROUP_KEYS = 3_000_000, 3_000_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
NEVER = 255
#: Low bits of a key that tell the scan in which it began; above them is a bit that no key lacks.
START_BITS = 5
_MARK, _LEFT = np.uint64(1 << START_BITS), np.uint64((1 << 64) - (1 << START_BITS))
#: Occurrences of each frequent phrase that are sent to spell it, on average.
SPELLED = 16

#: A-Z are lower-cased, all separators become this one, which no word has, and tabs blanks.
_BREAK, _BLANK = b".", b" "
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 9 + _BLANK)
#: The first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def word_places(data: bytes) -> tuple[np.ndarray, ...]:
    """In a plain text that ends with a break: the blanks and breaks, which of them end a word, and begins and sizes of those words."""
    plain = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero((plain == _BREAK[0]) | (plain == _BLANK[0]))
    sizes = np.diff(stops, prepend=-1) - 1
    ending = np.flatnonzero(sizes)
    return stops, ending, stops[ending] - sizes[ending], sizes[ending]


def word_codes(data: bytes, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit codes of the words at ``begins``, eight bytes at a time; never 0."""
    eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    codes = _hashed(eights[begins] & _FIRST[np.minimum(sizes, 8)] ^ sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(sizes > 8)
    for k in range(8, LONG_WORD, 8):
        at = at[sizes[at] > k]
        codes[at] = _hashed(codes[at] ^ eights[begins[at] + k] & _FIRST[np.minimum(sizes[at] - k, 8)])
    for k in at[sizes[at] > LONG_WORD].tolist():
        codes[k] = xxhash.xxh64_intdigest(data[begins[k] : begins[k] + sizes[k]])
    return np.maximum(codes, np.uint64(1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def coded(codes: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Codes of words of languages from those of words and of their languages."""
    return np.maximum(_mixed(codes ^ langs), np.uint64(1))


def word_keys(words: np.ndarray) -> np.ndarray:
    return words & _LEFT | _MARK


def longer_keys(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Keys of phrases of ``n`` words from the keys of their first ``n - 1`` words and the codes of their last."""
    return _mixed(first * np.uint64(0xC2B2AE3D27D4EB4F) + last * np.uint64(2 * n + 1)) & _LEFT | _MARK


def phrase_checks(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Checks of the phrases of ``n`` words at places: of a sum of codes, each times a power."""
    sums = words[at]
    for k in range(1, n):
        sums += words[at + k] * np.uint64(pow(0x9FB21C651E98DF25, k, 1 << 64))
    return (sums * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=1)
def _unpacked(data: bytes) -> Reached:
    """Once a worker, whatever the number of its tasks."""
    return Reached(np.frombuffer(zlib.decompress(data), np.uint8))


@dataclass(frozen=True)
class Reached:
    """The scan from which on longer phrases may use a phrase, by slot; ``NEVER`` until then."""

    slots: np.ndarray

    @staticmethod
    def empty(bits: int = SLOT_BITS) -> Reached:
        return Reached(np.full(1 << bits, NEVER, np.uint8))

    def packed(self) -> bytes:
        return zlib.compress(self.slots.tobytes(), 1)

    def known(self, keys: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys have at most ``last`` in both slots, and the larger of the two."""
        mask = np.uint64(len(self.slots) - 1)
        one = self.slots[keys >> np.uint64(START_BITS + 1) & mask]
        at = np.flatnonzero(one <= last)
        both = np.maximum(one[at], self.slots[keys[at] >> np.uint64(35) & mask])
        some = both <= last
        return (at, both) if some.all() else (at[some], both[some])

    def places(self, key: str = "key") -> F.Column:
        """The two slots of a key as Spark expressions."""
        mask = len(self.slots) - 1
        return F.array(F.shiftrightunsigned(key, START_BITS + 1).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 35).bitwiseAND(F.lit(mask)))

    def with_new(self, places: np.ndarray, scan: int) -> Reached:
        slots = self.slots.copy()
        fresh = places[slots[places] == NEVER]
        slots[fresh] = scan
        return Reached(slots)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts of documents, as many at a time as hold about ``GROUP_BYTES``."""
    langs, texts, n = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            langs.append(lang)
            texts.append(text)
            n += len(text)
            if n >= GROUP_BYTES:
                yield langs, texts
                langs, texts, n = [], [], 0
    if texts:
        yield langs, texts


def _encode(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Documents dealt to shards in turn; a row has the plain text of a language's documents in one shard and its words' codes, 0 for a break."""
    turn = 0
    for langs, texts in _texts(batches):
        data = (_BREAK.join(texts) + _BREAK).translate(_PLAIN)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        stops, ending, begins, sizes = word_places(data)
        numbers = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        salts = np.array([xxhash.xxh64_intdigest(lang.encode(), 1) for lang in numbers], np.uint64)
        of = np.array([numbers[lang] for lang in langs])[np.searchsorted(bounds, begins, "right")]
        both = np.zeros((len(stops), 2), np.uint64)  # what ends at a stop: a word, a piece, or both
        both[ending, 0] = coded(word_codes(data, begins, sizes), salts[of])
        there = np.stack([both[:, 0] != 0, np.frombuffer(data, np.uint8)[stops] == _BREAK[0]], axis=1)
        codes = both[there]
        ends = np.cumsum(there.sum(axis=1))[np.searchsorted(stops, bounds - 1)].tolist()
        parts: dict[tuple[str, int], list[tuple[np.ndarray, bytes]]] = {}
        for lang, size, bound, begin, end in zip(langs, map(len, texts), bounds.tolist(), [0, *ends], ends):
            parts.setdefault((lang, turn % shards), []).append((codes[begin:end], data[bound - size - 1 : bound]))
            turn += 1
        for (lang, shard), own in parts.items():
            words = np.concatenate([c for c, _ in own])
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang], pa.string()),
                    "words": pa.array([words.tobytes()], pa.binary()),
                    "n_words": pa.array([int(np.count_nonzero(words))], pa.int64()),
                    "text": pa.array([b"".join([t for _, t in own])], pa.binary()),
                    "shard": pa.array([shard], pa.int32()),
                }
            )


def _active(words: np.ndarray, reached: Reached, scan: int, shards: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys, with their starts, and checks of all occurrences of active phrases, by length."""
    at = np.flatnonzero(words)
    keys = word_keys(words[at])
    if scan < shards and len(at):
        yield keys, phrase_checks(words, at, 1)
    for n in range(2, longest + 1):
        known, since = reached.known(keys, scan)
        own = at[known]
        first = np.flatnonzero(own[1:] == own[:-1] + 1)  # without the last word, and next to it without the first
        if not len(first):
            return
        at, start = own[first], np.maximum(since[first], since[first + 1])
        keys = longer_keys(keys[known[first]], words[at + n - 1], n)
        on = np.flatnonzero(start > scan - shards) if scan >= shards else np.arange(len(at))
        if len(on):
            yield keys[on] | start[on], phrase_checks(words, at[on], n)


def _counted(keys: np.ndarray, checks: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and checks and the sum of their counts, each 1 unless given."""
    order = np.argsort(keys)
    keys, checks = keys[order], checks[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]))
    summed = np.diff(first, append=len(keys)) if counts is None else np.add.reduceat(counts[order], first)
    return keys[first], checks[first], summed


def _scan(batches: Iterator[pa.RecordBatch], packed: bytes, scan: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the active phrases of a shard, summed over the task."""
    reached = _unpacked(packed)
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0
    for batch in batches:
        for words in batch.column("words"):
            for keys, checks in _active(np.frombuffer(words.as_buffer(), np.uint64), reached, scan, shards, longest):
                held.append(_counted(keys, checks))
                n_held += len(held[-1][0])
            if n_held > GROUP_KEYS:
                held = [_counted(*(np.concatenate(x) for x in zip(*held)))]
                n_held = len(held[0][0])
                if n_held > GROUP_KEYS // 2:
                    yield _rows(*held[0])
                    held, n_held = [], 0
    if held:
        yield _rows(*_counted(*(np.concatenate(x) for x in zip(*held))))


def _rows(keys: np.ndarray, checks: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(checks.view(np.int32)), pa.array(counts.astype(np.int64))], names=["key", "check", "n"])


def _spell(batches: Iterator[pa.RecordBatch], packed: bytes, longest: int, spelled: int | None) -> Iterator[pa.RecordBatch]:
    """Phrases whose slots tell the size of their count; about ``spelled`` occurrences of each, or all of them."""
    sizes = _unpacked(packed)
    for batch in batches:
        for lang, row, text in zip(batch.column("lang").to_pylist(), batch.column("words"), batch.column("text").to_pylist()):
            words = np.frombuffer(row.as_buffer(), np.uint64)
            salt = np.uint64(xxhash.xxh64_intdigest(row.as_buffer()))
            every = at = np.flatnonzero(words)
            keys = word_keys(words[at])
            _, _, begins, lengths = word_places(text)
            for n in range(1, longest + 1):
                if n > 1:
                    first = np.flatnonzero(at[1:] == at[:-1] + 1)
                    at = at[first]
                    keys = longer_keys(keys[first], words[at + n - 1], n)
                some, size = sizes.known(keys, NEVER - 1)
                if spelled is not None:  # every frequent phrase is in the table, and so are its parts
                    at, keys = at[some], keys[some]
                    some = np.flatnonzero(_mixed(keys + at.astype(np.uint64) + salt) >> np.uint64(40) < np.uint64(spelled << 24) >> np.minimum(size, 63).astype(np.uint64))
                if len(some):
                    word = np.searchsorted(every, at[some])
                    ends = begins[word + n - 1] + lengths[word + n - 1]
                    phrases = [b" ".join(text[b:e].split()).decode("utf-8", "replace") for b, e in zip(begins[word].tolist(), ends.tolist())]
                    columns = [pa.array(keys[some].view(np.int64)), pa.array(phrase_checks(words, at[some], n).view(np.int32)), pa.array([lang] * len(some), pa.string()), pa.array(phrases, pa.string()), pa.array([n] * len(some), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "check", "lang", "phrase", "size"])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


@dataclass(frozen=True)
class Scans:
    """What dynamic counting leaves: the encoded shards, the frequent phrases by key and check (without starts), and the scans that it took."""

    shards: DataFrame
    frequent: DataFrame
    n_scans: int


_ENCODED = "lang string, words binary, n_words long, text binary, shard int"


def dynamic_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS, slot_bits: int = SLOT_BITS) -> Scans:
    if not 1 <= shards * longest < 1 << START_BITS:
        raise ValueError("shards times the longest phrase must be under 32")
    spark = docs.sparkSession
    folder, path = scratch(spark, "shards"), None
    _documents(docs).mapInArrow(lambda b: _encode(b, shards), _ENCODED).write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    encoded = spark.read.schema(_ENCODED).parquet(folder)
    reached, running, frequent, scan, end = Reached.empty(slot_bits), None, None, 0, shards
    start = F.col("key").bitwiseAND(F.lit((1 << START_BITS) - 1))
    while scan < end:
        sent = spark.sparkContext.broadcast(reached.packed())
        rows = encoded.where(F.col("shard") == scan % shards).select("words")
        counted = rows.mapInArrow(lambda b, scan=scan, sent=sent: _scan(b, sent.value, scan, shards, longest), "key long, check int, n long").withColumn("before", F.lit(0).cast("long"))
        if running is not None:
            counted = counted.unionByName(running.select("key", "check", "n", F.col("n").alias("before")))
        before, path = path, scratch(spark, "active-phrases")
        counted.groupBy("key", "check").agg(F.sum("n").alias("n"), F.sum("before").alias("before")).write.parquet(path)
        state = spark.read.schema("key long, check int, n long, before long").parquet(path)
        new = state.where((F.col("n") >= min_count) & (F.col("before") < min_count)).select(F.explode(reached.places()).alias("place")).distinct()
        places = new.toArrow().column("place").to_numpy()  # never more than there are slots
        running = state.where(start + shards - 1 > scan)
        complete = state.where((start + shards - 1 == scan) & (F.col("n") >= min_count)).select(F.col("key").bitwiseAND(F.lit(-(1 << START_BITS))).alias("key"), "check", "n")
        complete = materialise(complete, "complete-phrases")
        frequent = complete if frequent is None else frequent.unionByName(complete)
        sent.destroy()
        if before is not None:
            discard(spark, before)
        scan += 1
        if len(places):  # what they make active needs a full cycle
            reached, end = reached.with_new(places, scan), min(scan + shards, shards * longest)
    return Scans(encoded, materialise(frequent, "frequent-keys"), scan)


def _sizes(frequent: DataFrame, slot_bits: int) -> Reached:
    """For the slots of each phrase, the larger binary logarithm of a count."""
    empty = Reached.empty(slot_bits)
    by_place = frequent.select(F.explode(empty.places()).alias("place"), F.floor(F.log2("n")).cast("int").alias("size")).groupBy("place").agg(F.max("size").alias("size")).toArrow()
    slots = empty.slots
    slots[by_place.column("place").to_numpy()] = by_place.column("size").to_numpy()
    return Reached(slots)


def spell(scans: Scans, longest: int = LONGEST, slot_bits: int = SLOT_BITS, spelled: int = SPELLED) -> DataFrame:
    """(lang, phrase, size, n) of the frequent phrases."""
    missing, found, rate = scans.frequent, None, spelled
    while True:
        sent = scans.frequent.sparkSession.sparkContext.broadcast(_sizes(missing, slot_bits).packed())
        some = scans.shards.select("lang", "words", "text").mapInArrow(lambda b, sent=sent, rate=rate: _spell(b, sent.value, longest, rate), "key long, check int, lang string, phrase string, size int")
        some = materialise(some.join(missing, ["key", "check"]).dropDuplicates(["key", "check"]), "spelled")
        sent.destroy()
        found = some if found is None else found.unionByName(some)
        missing = materialise(missing.join(some.select("key", "check"), ["key", "check"], "left_anti"), "not-spelled")
        if rate is None or missing.isEmpty():
            break
        rate = None
    return found.select("lang", "phrase", "size", "n")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``phrase``, ``size``, ``n``) of all phrases of up to ``longest`` words with at least ``min_count`` occurrences; and (``lang``, ``total``) words of each language."""
    scans = dynamic_counts(docs, min_count, longest, shards, slot_bits)
    return spell(scans, longest, slot_bits), scans.shards.groupBy("lang").agg(F.sum("n_words").alias("total"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, slot_bits: int = SLOT_BITS, absorbed_percent: int = ABSORBED_PERCENT) -> DataFrame:
    """The first ``top`` phrases of each language by the score of their worst cut: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    frequent, totals = frequent_phrases(docs, min_count, longest, shards, slot_bits)
    longer = frequent.where("size > 1").withColumn("words", F.split("phrase", " "))
    part = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    # What contains a phrase with as many occurrences contains one that is longer by one word.
    containers = longer.where("size > 2").select("lang", F.explode(F.array(part(1, F.col("size") - 1), part(2, F.col("size") - 1))).alias("phrase"), "n")
    containers = containers.groupBy("lang", "phrase").agg(F.max("n").alias("container"))
    left = longer.join(containers, ["lang", "phrase"], "left").where(f"container IS NULL OR 100 * container < {absorbed_percent} * n")
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words", "size")
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    counts = frequent.select("lang", "phrase", "n")
    cuts = cuts.join(counts.selectExpr("lang", "phrase AS first", "n AS l"), ["lang", "first"]).join(counts.selectExpr("lang", "phrase AS rest", "n AS r"), ["lang", "rest"])
    wide = lambda c: f"CAST({c} AS DECIMAL(15, 0))"  # noqa: E731  products of 36 digits are exact
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr(f"CAST(({wide('a')} * {wide('total')} * CAST(1000 AS DECIMAL(4, 0))) div ({wide('l')} * {wide('r')}) AS BIGINT)"))
    worst = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    return _ranked(worst, top)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """Only each task's own first ``top`` of a language are shuffled to be ranked."""
    ranked = "SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM {scored}"
    return scored.sparkSession.sql(f"SELECT * FROM ({ranked}) AS ranked WHERE rank <= {top}", scored=scored)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS p, lang, w FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS a FROM (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS phrase FROM p, range(1, {LONGEST + 1}) AS s(size) WHERE len(w) >= size) GROUP BY lang, size, phrase HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
inside AS (SELECT lang, array_to_string(w[k:k + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, size, m, unnest(range(1, size - m + 2)) AS k FROM c, range(2, {LONGEST}) AS s(m) WHERE m < size) GROUP BY 1, 2),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, n.n, CAST((1000 * cuts.a::HUGEINT * n.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS BIGINT) AS score
  FROM cuts JOIN n USING (lang) JOIN f AS l ON l.lang = cuts.lang AND l.phrase = one JOIN f AS r ON r.lang = cuts.lang AND r.phrase = two),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT worst.* FROM worst LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < {ABSORBED_PERCENT} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {TOP}
"""
