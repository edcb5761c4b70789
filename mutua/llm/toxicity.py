"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their beginnings, hashed to ``BUCKETS``. The
logit of the score is linear in the terms present and in all pairs of them: the weight of a pair
is the product of two short factors, so that an insult with a mention of a group counts for
more, or less, than both alone. The sum over pairs needs one pass: it is half of the square of
the factors' sum less the sum of their squares.

The model is fitted on at most ``MAX_LABELLED`` rows of labelled documents outside the held-out
fold (those whose ids hash lowest, a bound on what the driver fits). Terms take part if
enough sampled documents have them and toxic ones among these are more, or fewer, than chance
allows; there are ``MAX_TERMS`` at most, the most telling first. They are counted where the sample
lies; only the sampled documents' chosen terms reach the driver. Scores cover all documents, whole texts.

Defined cases: a null text is empty and has the model's base rate as its score; labels of one id
that disagree count as toxic; null labels and labels of unknown ids are not used; a null doc_id
counts as the empty text in the folds; without usable labels every score is 0; repeated rows give repeated
results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.llm.text import alnum_words
from mutua.storage import materialise, table

QUERY = "op12_toxicity"
ORACLE_SQL = None  # a fitted model has no SQL form; tests hold the scores against labels and a plain sum over pairs

MAX_LABELLED = 20_000
BUCKETS = 1 << 20
#: Bytes of a word's beginnings that are terms, so that inflected forms count.
BEGINNINGS = (3, 4, 5, 6)
#: A term is in this many sampled documents at least, and its toxic ones are this many deviations off.
LEAST_DOCS, LEAST_Z = 3, 4.0
MAX_TERMS = 1 << 13
FACTORS, SPREAD = 8, 0.05
EPOCHS, BATCH, RATE, DECAY, SEED = 20, 256, 0.05, 2e-3, 1
FOLDS, HELD_OUT = 5, 0
#: Words that a task remembers the terms of.
REMEMBERED = 300_000


def word_buckets(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its beginnings, which are marked by a star."""
    return [xxhash.xxh32_intdigest(x) % buckets for x in (word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) >= k))]


@dataclass(frozen=True)
class Machine:
    """``number`` gives each bucket's term, or -1; a term has a weight and ``FACTORS`` factors."""

    number: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, begins: np.ndarray, found: np.ndarray) -> np.ndarray:
        """For texts whose terms are ``found`` from their ``begins`` on, the last of which is the end."""
        n = len(begins) - 1
        text = np.repeat(np.arange(n), np.diff(begins))
        v = self.factors[found]
        sums = _by_text(text, v, n)
        return self.bias + np.bincount(text, self.weights[found], n) + ((sums**2).sum(1) - np.bincount(text, (v**2).sum(1), n)) / 2

    def scores(self, begins: np.ndarray, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(begins, found), -500, 500)))


def _by_text(text: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(text, v[:, k], n) for k in range(v.shape[1])], 1)


class _Terms(dict):
    """Chosen terms of words, remembered."""

    def __init__(self, number: np.ndarray) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.number[word_buckets(word, len(self.number))]
        self[word] = out = tuple(found[found >= 0].tolist())
        return out

    def of(self, text: str | None) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, set(alnum_words(text)))))


def train(begins: np.ndarray, found: np.ndarray, toxic: np.ndarray, number: np.ndarray) -> Machine:
    """Logistic loss by adaptive gradient steps on batches, with weight decay on what a batch has."""
    n, n_terms = len(toxic), int(number.max(initial=-1)) + 1
    rng = np.random.default_rng(SEED)
    rate = (toxic.sum() + 0.5) / (n + 1)
    bias, weights, factors = float(np.log(rate / (1 - rate))), np.zeros(n_terms), rng.normal(0, SPREAD, (n_terms, FACTORS))
    past_bias, past_weights, past_factors = 1e-8, np.full(n_terms, 1e-8), np.full((n_terms, FACTORS), 1e-8)
    decay = DECAY * BATCH / n
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k : k + BATCH]
            sizes = begins[rows + 1] - begins[rows]
            ends = np.cumsum(sizes)
            text = np.repeat(np.arange(len(rows)), sizes)
            at = found[np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(begins[rows], sizes)]
            scores = Machine(number, bias, weights, factors).scores(np.concatenate([[0], ends]), at)
            slope = (scores - toxic[rows]) / len(rows)
            v = factors[at]
            used, place = np.unique(at, return_inverse=True)
            by_weight = np.bincount(place, slope[text], len(used)) + decay * weights[used]
            by_factor = _by_text(place, (_by_text(text, v, len(rows))[text] - v) * slope[text][:, None], len(used)) + decay * factors[used]
            past_bias += slope.sum() ** 2
            past_weights[used] += by_weight**2
            past_factors[used] += by_factor**2
            bias -= RATE * slope.sum() / past_bias**0.5
            weights[used] -= RATE * by_weight / np.sqrt(past_weights[used])
            factors[used] -= RATE * by_factor / np.sqrt(past_factors[used])
    return Machine(number, bias, weights, factors)


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``place`` (a hash of the id), ``text`` and ``toxic`` of the at most ``limit`` labelled documents outside the held-out fold whose ids hash lowest; one row an id."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = marks.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("labelled_id"), F.col("toxic").cast("double").alias("toxic"))
    rows = kept.join(F.broadcast(few), F.col("doc_id") == F.col("labelled_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.select(F.xxhash64("doc_id").alias("place"), F.col("doc_id").cast("string").alias("id"), "text", "toxic")


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents with each bucket, toxic and all, summed over the task."""
    n_toxic, n_all = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    every = _Terms(np.arange(buckets))
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic")):
            own = every.of(text.as_py())
            n_all[own] += 1
            n_toxic[own] += int(toxic.as_py())
    found = np.flatnonzero(n_all)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n_toxic[found]), pa.array(n_all[found])], names=["bucket", "n_toxic", "n_all"])


def chosen_terms(sample: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The number of each bucket's term, -1 for those that tell nothing."""
    totals = sample.agg(F.avg("toxic").alias("rate"), F.count(F.lit(1)).alias("n")).first()
    number = np.full(buckets, -1, np.int32)
    if totals.n and 0 < totals.rate < 1:
        counted = sample.select("text", "toxic").mapInArrow(lambda b: _count(b, buckets), "bucket long, n_toxic long, n_all long")
        summed = counted.groupBy("bucket").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_all").alias("n_all"))
        z = F.abs(F.col("n_toxic") - F.col("n_all") * totals.rate) / F.sqrt(F.col("n_all") * (totals.rate * (1 - totals.rate)))
        telling = summed.where((F.col("n_all") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "bucket").limit(MAX_TERMS).select("bucket")
        for k, row in enumerate(telling.collect()):
            number[row.bucket] = k
    return number


def _found(batches: Iterator[pa.RecordBatch], number: np.ndarray) -> Iterator[pa.RecordBatch]:
    chosen = _Terms(number)
    for batch in batches:
        own = [chosen.of(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("id"), batch.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["place", "id", "toxic", "terms"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Machine | None:
    """None without usable labels."""
    sample = materialise(labelled_sample(docs, labels, limit), "labelled")
    number = chosen_terms(sample)
    rows = sample.mapInArrow(lambda b: _found(b, number), "place long, id string, toxic double, terms array<int>").orderBy("place", "id").toArrow()
    if not rows.num_rows:
        return None
    own = rows.column("terms").to_pylist()
    begins = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return train(begins, np.fromiter((t for x in own for t in x), np.int64, begins[-1]), rows.column("toxic").to_numpy(), number)


def _score(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    chosen = _Terms(machine.number)
    for batch in batches:
        own = [chosen.of(text.as_py()) for text in batch.column("text")]
        begins = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        found = np.fromiter((t for x in own for t in x), np.int64, begins[-1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.scores(begins, found))], names=["doc_id", "score"])


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if machine is None:
        return kept.select("doc_id", F.lit(0.0).alias("score"))
    return kept.mapInArrow(lambda b: _score(b, machine), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    return score(docs, fit(docs, labels, limit)).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
