"""Quality rules: exact base rules, and boosted trees over document statistics.

The trees learn "good and not toxic" from at most ``MAX_LABELLED`` rows of labelled
documents (those whose ids hash lowest, a bound on what the driver fits) and score
every document. The sample is written once. For the fit, each of its documents is
described with the lexicon of the other folds, so the trees do not see a document's own
label through the lexicon; every other document with the lexicon of all. The score may only fall as symbols, repeats, capitals, exclamation marks
and words of the learned lexicon grow: these columns carry monotonic constraints.
The lexicon holds words, and beginnings of words, that are frequent in toxic labelled
documents and rare in others.

Defined cases: a null text has no words and fails the base rule; a text without
words has all counts 0; labels of one id that disagree count as not good; labels of
unknown ids or null labels are not used; without usable labels only the base rule
decides; repeated rows give repeated results; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.llm import gbt
from mutua.llm.text import alnum_words
from mutua.storage import materialise, table

QUERY = "op7_quality"
ORACLE_SQL = None  # the verdict of trained trees has no SQL form; tests hold it against labels and brute force

MAX_LABELLED = 20_000
#: A lexicon word is in this share of toxic documents at least, and this many times likelier there.
LEXICON_SHARE, LEXICON_DOCS, LEXICON_RATIO = 0.015, 4, 20.0
#: Bytes of a word's beginnings that the lexicon may hold, so that inflected forms count.
BEGINNINGS = (4, 5)
#: Parts of the sample; a document is described for the fit with the lexicon of the other parts.
FOLDS = 5
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_BLANKS = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))

#: Columns of the statistics that the trees see, and how the score may move as each grows.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "capital_share": -1,
    "shouts_per_word": -1,
    "digit_share": 0,
    "distinct_share": 0,
    "lexicon_words": -1,
    "lexicon_share": -1,
}
MONOTONE = np.array(list(FEATURES.values()))


@dataclass(frozen=True)
class Stats:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: tuple[float, ...]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows have equal hashes
        return 0
    number: dict[bytes, int] = {}  # equal hashes need not be equal windows
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = codes[:n].copy()
    for k in range(1, window):
        code = np.unique(code * (codes.max() + 1) + codes[k : k + n], return_inverse=True)[1].astype(np.int64)
    again = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def pieces(words: set[bytes]) -> set[bytes]:
    """Words, and their beginnings marked by a star."""
    return words.union(w[:k] + b"*" for w in words for k in BEGINNINGS if len(w) >= k)


def lexicon_words(words: list[bytes], lexicon: frozenset[bytes]) -> int:
    """Distinct words that the lexicon has, whole or by their beginning."""
    distinct = set(words)
    if lexicon.isdisjoint(pieces(distinct)):
        return 0
    return sum(not lexicon.isdisjoint(pieces({w})) for w in distinct)


def describe(text: str | None, lexicon: frozenset[bytes] = frozenset()) -> Stats:
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    without = lambda chars: len(data) - len(data.translate(None, chars))
    word_chars = len(text) - without(_BLANKS)
    symbols = without(_SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    hits = lexicon_words(alnum_words(text), lexicon) if lexicon else 0
    per = 1 / max(n, 1)
    return Stats(
        n,
        word_chars,
        symbols,
        len(lines) - len(set(lines)),
        repeats,
        (
            float(np.log1p(n)),
            word_chars * per,
            symbols * per,
            (len(lines) - len(set(lines))) / max(len(lines), 1),
            repeats * per,
            without(_CAPITALS) / max(word_chars, 1),
            data.count(b"!") * per,
            without(_DIGITS) / max(word_chars, 1),
            len(set(words)) * per,
            float(hits),
            hits * per,
        ),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


@dataclass(frozen=True)
class QualityModel:
    trees: gbt.FlatTrees | None
    lexicon: frozenset[bytes]

    def good(self, x: np.ndarray) -> np.ndarray:
        return self.trees.score(x) >= 0 if self.trees is not None else np.ones(len(x), bool)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``text``, ``good``, ``toxic`` and ``fold`` of at most ``limit`` rows of labelled documents, those whose ids hash lowest."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    few = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    few = few.select(F.col("doc_id").alias("labelled_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = kept.join(F.broadcast(few), F.col("doc_id") == F.col("labelled_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(limit)
    return rows.select("text", "good", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of documents with each word, toxic and other, by fold, summed over the task."""
    counts: dict[tuple[int, bool], Counter] = {}
    for batch in batches:
        for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
            counts.setdefault((fold, toxic), Counter()).update(pieces(set(alnum_words(text))))
    for (fold, toxic), of in counts.items():
        n = list(of.values())
        none = [0] * len(n)
        yield pa.RecordBatch.from_pydict({"fold": pa.array([fold] * len(n), pa.int32()), "word": pa.array(list(of), pa.binary()), "n_toxic": pa.array(n if toxic else none, pa.int64()), "n_other": pa.array(none if toxic else n, pa.int64())})


def _lexicon(counted: DataFrame, n_toxic: int, n_other: int) -> frozenset[bytes]:
    """At most (distinct words and beginnings of a toxic document) / ``LEXICON_SHARE`` words."""
    if not n_toxic:
        return frozenset()
    summed = counted.groupBy("word").agg(F.sum("n_toxic").alias("t"), F.sum("n_other").alias("o"))
    ratio = (F.col("t") / n_toxic) / ((F.col("o") + 0.5) / (n_other + 1))
    rows = summed.where((F.col("t") >= max(LEXICON_DOCS, LEXICON_SHARE * n_toxic)) & (ratio >= LEXICON_RATIO)).select("word").collect()
    return frozenset(bytes(r.word) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> QualityModel:
    sample = materialise(labelled_sample(docs, labels, limit), "labelled-sample")
    totals = {r.fold: (r.t, r.o) for r in sample.groupBy("fold").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o")).collect()}  # a row a fold
    if not totals:
        return QualityModel(None, frozenset())
    counted = materialise(sample.mapInArrow(_count_words, "fold int, word binary, n_toxic long, n_other long"), "labelled-words")
    n_toxic, n_other = (sum(x[k] for x in totals.values()) for k in (0, 1))
    whole = _lexicon(counted, n_toxic, n_other)
    others = {f: _lexicon(counted.where(F.col("fold") != f), n_toxic - t, n_other - o) for f, (t, o) in totals.items()}
    described = sample.mapInArrow(lambda b: _sample_features(b, others), "x array<double>, good boolean").toPandas()  # at most ``limit`` rows
    x = np.array(described["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = described["good"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of rows
    return QualityModel(gbt.fit(x[order], y[order], MONOTONE), whole)


def _sample_features(batches: Iterator[pa.RecordBatch], lexicons: dict[int, frozenset[bytes]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [list(describe(t, lexicons[f]).features) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("good")], names=["x", "good"])


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _judge(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        stats = [describe(t, model.lexicon) for t in batch.column(batch.num_columns - 1).to_pylist()]
        failed = np.array([base_failed(s.n_words, s.n_repeat_words) for s in stats], bool)
        x = np.array([s.features for s in stats], float).reshape(-1, len(FEATURES))
        kept = ~failed & model.good(x)
        columns = [pa.array([getattr(s, k) for s in stats], pa.int64()) for k in names]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, pa.array(failed), pa.array(kept)], names=[*batch.schema.names[:-1], *names, "base_failed", "kept"])


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per document: ``doc_id``, base counts, ``base_failed`` and ``kept``."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(lambda b: _judge(b, model), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {OUT}")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [describe(t, model.lexicon) for t in batch.column(batch.num_columns - 1).to_pylist()]
            failed = np.array([base_failed(s.n_words, s.n_repeat_words) for s in stats], bool)
            kept = ~failed & model.good(np.array([s.features for s in stats], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(kept))

    return docs.select("*", F.col("text").cast("string").alias("__judged_text")).mapInArrow(mark, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
