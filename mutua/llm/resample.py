"""Importance resampling towards a target distribution of hashed word n-grams.

Each document is normalised to its words with one blank between them and scanned once:
the running CRC-32 after every word is stored, and the CRC of any n-gram follows from two
of them. As crc(AB) = shift(crc(A), |B|) xor crc(B), where shift multiplies by x^(8|B|)
over GF(2), the n-gram B between two prefixes has crc(B) = crc(AB) xor shift(crc(A), |B|).
The shift by 2^k bytes is a linear map, four lookups in tables of 256 words.

One pass counts buckets (a task sends at most a row a bucket), one weighs each document
with the gains, a table of ``BUCKETS`` numbers whatever the corpus. The draw is exact and
spread over tasks: rows are range-partitioned by score, numbered where they lie, and moved
by the sizes of the partitions before. Only numbers are moved, never texts.

Defined cases: a null text or one without words has no features and weight 0; a null
doc_id draws its noise as an empty id and comes after others of its score; repeated
rows are drawn each for itself; without target or source texts all counts are 0; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.llm.text import alnum_words
from mutua.storage import materialise, table

QUERY = "op11_resample"
BUCKETS = 10_000
LONGEST = 2
SEED = 7
MIN_WORDS = 20
DRAW_PERCENT = 25
#: Words that a task holds arrays for at a time.
GROUP_WORDS = 200_000
#: CRC-32 as zip and Ethernet use it, bits reversed.
_POLYNOMIAL = 0xEDB88320


def _one_bit(x: np.ndarray) -> np.ndarray:
    """The register after one more zero bit."""
    return np.where(x & 1, x >> 1 ^ np.uint32(_POLYNOMIAL), x >> 1).astype(np.uint32)


def _one_byte(x: np.ndarray) -> np.ndarray:
    for _ in range(8):
        x = _one_bit(x)
    return x


def _byte_maps(columns: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of single bits, as four tables of 256 images."""
    maps = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        maps[bit // 8] ^= np.where(np.arange(256) >> bit % 8 & 1, columns[bit], 0).astype(np.uint32)
    return maps


def _applied(maps: np.ndarray, x: np.ndarray) -> np.ndarray:
    return maps[0][x & 255] ^ maps[1][x >> 8 & 255] ^ maps[2][x >> 16 & 255] ^ maps[3][x >> 24]


def _shift_maps(powers: int = 31) -> list[np.ndarray]:
    """Multiplication by x^(8 * 2^k) for each k, each the square of the one before."""
    columns = _one_byte(np.uint32(1) << np.arange(32, dtype=np.uint32))
    maps = []
    for _ in range(powers):
        maps.append(_byte_maps(columns))
        columns = _applied(maps[-1], columns)
    return maps


_BYTE = _one_byte(np.arange(256, dtype=np.uint32))
_SHIFTS = _shift_maps()


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What the CRC of a prefix contributes to the CRC of a text that goes on for ``n_bytes``."""
    out = crc.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero(n_bytes >> k & 1)
        out[on] = _applied(_SHIFTS[k], out[on])
    return out


class Prefixes:
    """Running CRCs of texts given as words: before each word's first byte and after its last."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        step = lambda crc, word: zlib.crc32(word, zlib.crc32(b" ", crc))
        self.counts = np.fromiter(map(len, texts), np.int64, len(texts))
        n = int(self.counts.sum())
        self.after = np.fromiter((crc for words in texts if words for crc in accumulate(words[1:], step, initial=zlib.crc32(words[0]))), np.uint32, n)
        # Before a word is one blank more than after the last: one step of the byte-wise CRC.
        state = ~self.after[:-1]
        self.before = np.zeros(n, np.uint32)
        self.before[1:] = ~(_BYTE[(state ^ 32) & 255] ^ state >> 8)
        ends = np.cumsum(self.counts)
        self.before[(ends - self.counts)[self.counts > 0]] = 0
        self.left = np.repeat(ends, self.counts) - np.arange(n)  # words to the text's end
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.bytes_before = np.concatenate([[0], np.cumsum(np.fromiter((len(w) for words in texts for w in words), np.int64, n))])

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The text of each run of ``n`` words, and the run's CRC."""
        at = np.flatnonzero(self.left >= n)
        size = self.bytes_before[at + n] - self.bytes_before[at] + n - 1
        return self.text[at], self.after[at + n - 1] ^ shifted(self.before[at], size)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with the words of their texts, as many at a time as hold about ``GROUP_WORDS``."""
    for batch in batches:
        begin, texts, n = 0, [], 0
        for text in batch.column("text"):
            texts.append(alnum_words(text.as_py()))
            n += len(texts[-1])
            if n >= GROUP_WORDS:
                yield batch.slice(begin, len(texts)), texts
                begin, texts, n = begin + len(texts), [], 0
        if texts:
            yield batch.slice(begin, len(texts)), texts


def _count(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Features in each bucket, summed over the task."""
    counts = np.zeros(buckets, np.int64)
    for _, texts in _groups(batches):
        prefixes = Prefixes(texts)
        for n in range(1, longest + 1):
            counts += np.bincount(prefixes.ngrams(n)[1] % np.uint32(buckets), minlength=buckets)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["bucket", "n"])


def _weigh(batches: Iterator[pa.RecordBatch], gains: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in _groups(batches):
        prefixes = Prefixes(texts)
        total, features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for n in range(1, longest + 1):
            text, crc = prefixes.ngrams(n)
            features += np.bincount(text, minlength=len(texts))
            np.add.at(total, text, gains[crc % np.uint32(len(gains))])
        weight = total // np.maximum(features, 1)  # rounds down, also below zero
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(prefixes.counts), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket: a table whose size does not depend on them."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _count(b, buckets, longest), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target has a bucket, with one added to each."""
    n = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (mean gain, rounded down) of each document."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(lambda b: _weigh(b, gains, longest), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: str = "doc_id", seed: int = SEED) -> F.Column:
    """Thousandths of a Gumbel variate that depends on the id only, rounded down."""
    h = f"CAST(conv(substr(sha2(concat('{seed}:', coalesce(CAST({doc_id} AS STRING), '')), 256), 1, 8), 16, 10) AS BIGINT)"
    return F.expr(f"CAST(floor(-1000 * ln(-ln(({h} + 0.5D) / 4294967296D))) AS BIGINT)")


def draw(weighed: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Adds ``score`` and ``rank``: the best ``percent`` of the rows of at least ``min_words`` words by score, then by doc_id; others have no rank.

    Numbering needs no single task: rows lie in ranges of the order, a number of their own within each range.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(seed=seed)).withColumn("fit", F.col("n_words") >= min_words)
    scored = materialise(scored.withColumn("tie", F.monotonically_increasing_id()), "scored")
    n_fit = scored.where("fit").count()
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed.withColumns({"range": F.shiftright("place", 33), "place": F.expr("place & 8589934591")}), "placed")
    sizes = sorted(map(tuple, placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()))  # a row a partition
    before = list(accumulate((n for _, n in sizes), initial=0))
    starts = weighed.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sizes, before)], "range long, before long")
    rank = F.col("before") + F.col("place") + 1
    drawn = F.col("fit") & (rank <= n_fit * percent // 100)
    return placed.join(F.broadcast(starts), "range").select(*weighed.columns, "score", F.when(drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Each document's ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` towards the texts of ``target``."""
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    return draw(weigh(docs, gains, longest), percent, min_words, seed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_FEATURES = "SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
df AS (SELECT r, f, count(*) AS n FROM ({_FEATURES} d) GROUP BY r, f),
bf AS (SELECT f, count(*) AS n FROM ({_FEATURES} b) GROUP BY f),
crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END)) AS step),
h AS (SELECT f, CAST(xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(f) + 1), lambda k: CAST('0x' || substr(x, 2 * k - 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, step[(xor(c, y) & 255) + 1])), 4294967295) AS BIGINT) % {BUCKETS} AS bucket
      FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)), crc),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN h USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(n) AS n, sum(n * gain) AS total FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total::DOUBLE / n), 0) AS BIGINT) AS weight,
             CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= {MIN_WORDS}) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {MIN_WORDS} AND place <= {DRAW_PERCENT} * n // 100 THEN place END AS rank FROM z
"""
