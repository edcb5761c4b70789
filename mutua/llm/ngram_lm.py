"""Language-model scores from a weighted backoff automaton over corpus n-grams.

Counting is one exchange. Documents are dealt by a hash into blocks of about
``BLOCK_CHARS`` characters. A block sends each bucket (a range of n-gram keys) the
distinct n-grams of its documents with its own training counts; a bucket adds the
counts of all blocks and answers each block, in the order asked, with the corpus
counts. A block repeats a frequent n-gram once, so no bucket is hot, and both blocks
and buckets have bounded sizes whatever the corpus holds. A message without n-grams is
not sent, so there are never more messages than distinct n-grams of blocks. Words are
known by 64-bit hashes; longer n-grams by as many bits as keep the share of them that
meet another one under ``1 / 2**SPARE_BITS`` for any size of the corpus.

Scoring builds the automaton of the block's n-grams: each context is a state, each
n-gram an arc with its smoothed log-probability, and each state has a failure arc to
its longest proper suffix with the mass left to shorter contexts. Documents are
traversed once from left to right, each with its state; all documents of a block go in
step. A long one goes in lanes of ``LANE`` tokens: the state at a lane's begin follows
from the few tokens before it, so lanes change no score.

Smoothing: p(w|h) = k(h) c(hw)/c(h) + (1-k(h)) p(w|h'), with k(h) = WEIGHT c(h)/(c(h)+PRIOR),
down to (c(w)+0.5)/(N+0.5(V+1)); every context's probabilities sum to one, one unknown
word included. A text is scored as its words and one end; the end of the text before
stands for its beginning.

Defined cases: a null text is empty and scores its end alone; a null id is not held
out; repeated rows count and score as often as they occur; without training rows every
token is unknown; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mutua.llm.text import blank_words
from mutua.storage import table

QUERY = "op4_ngram_lm"
ORACLE_SQL = None  # the automaton's score has no SQL form; tests sum the recursion by brute force
ORDER = 3
WEIGHT, PRIOR = 0.7, 1.0
ADDED = 0.5
BLOCK_CHARS = 4 << 20
#: Bits of an n-gram's key beyond those that number the corpus's n-grams.
SPARE_BITS = 13
LANE = 512
#: Blocks for each bucket; a bucket holds the n-grams of so many blocks.
BLOCKS_PER_BUCKET = 1
_CACHE_WORDS = 100_000


class _Hashes(dict):
    """Hashes of words; forgets all when it holds ``_CACHE_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


END = xxhash.xxh64_intdigest(b"")  # no word is empty


def extend_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram followed by a word."""
    x = key * np.uint64(0x9E3779B97F4A7C15) + (word ^ np.uint64(0xD6E8FEB86659FD93))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@dataclass
class Level:
    """Distinct n-grams of one length in a block, by key: first position, and where each position's n-gram is."""

    keys: np.ndarray
    first: np.ndarray
    at: np.ndarray  # by position; -1 where no n-gram of this length ends
    trained: np.ndarray  # the block's own training count


@dataclass
class Block:
    begins: np.ndarray  # position of each document's leading end
    lengths: np.ndarray  # its tokens after that
    levels: list[Level]
    bits: int  # of the keys of n-grams of two words or more


def key_bits(chars: int) -> int:
    """Bits for the n-grams of a corpus of so many characters, which has a token for each two of them at most."""
    return min(64, max(1, chars // 2).bit_length() + SPARE_BITS)


def read_block(texts: list[str | None], held: list[bool], order: int, bits: int = 64) -> Block:
    hashes = _Hashes()
    parts, lengths = [], []
    for text in texts:
        words = blank_words(text)
        own = np.empty(len(words) + 2, np.uint64)
        own[0] = own[-1] = END
        own[1:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        parts.append(own)
        lengths.append(len(words) + 1)
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    n = np.array(lengths, np.int64)
    begins = np.cumsum(n + 1) - (n + 1)
    after = np.arange(len(words)) - np.repeat(begins, n + 1)
    trains = np.repeat(~np.array(held, bool), n + 1)
    levels, key = [], words
    for k in range(1, order + 1):
        if k > 1:
            key = np.concatenate([words[:1], extend_key(key[:-1], words[1:])])
        ends = np.flatnonzero(after >= k - 1)
        shown = key[ends] if k == 1 else key[ends] >> np.uint64(64 - bits)
        keys, first, inverse = np.unique(shown, return_index=True, return_inverse=True)
        at = np.full(len(words), -1, np.int64)
        at[ends] = inverse
        counted = trains[ends] & (after[ends] > 0)
        levels.append(Level(keys, ends[first], at, np.bincount(inverse[counted], minlength=len(keys))))
    return Block(begins, n, levels, bits)


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, so that the shuffle's codec meets runs of zeros."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def _edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's range of the sorted keys begins, and the end."""
    bounds = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


ASKED = "bucket int, block int, level int, grams binary, counts binary"
ANSWERED = "block int, bucket int, level int, counts binary"


def _ask(docs: pa.Table, order: int, buckets: int, bits: int) -> pa.Table:
    block = read_block(docs.column("text").to_pylist(), docs.column("held_out").to_pylist(), order, bits)
    number = docs.column("block")[0].as_py()
    rows: dict[str, list] = {"bucket": [], "block": [], "level": [], "grams": [], "counts": []}
    for k, level in enumerate(block.levels):
        edges = _edges(level.keys, buckets, bits if k else 64)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            rows["bucket"].append(b)
            rows["block"].append(number)
            rows["level"].append(k)
            rows["grams"].append(_planes(np.diff(level.keys[part], prepend=np.uint64(0))))
            rows["counts"].append(_planes(level.trained[part]))
    return pa.table(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("level", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())]))


def _summed(part: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Corpus counts of the distinct n-grams of one level; which of them each asked one is; and the number that each message asks."""
    keys = [np.cumsum(_values(x), dtype=np.uint64) for x in part.column("grams").to_pylist()]
    counts = np.concatenate([_values(x) for x in part.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return np.bincount(inverse, counts).astype(np.uint64), inverse, [len(x) for x in keys]  # sums below 2**53 are exact


def _answer(asked: pa.Table) -> pa.Table:
    rows: dict[str, list] = {"block": [], "bucket": [], "level": [], "counts": []}
    levels = asked.column("level").to_numpy()
    bucket = asked.column("bucket")[0].as_py()
    for k in np.unique(levels).tolist():
        part = asked.take(np.flatnonzero(levels == k))
        totals, inverse, lengths = _summed(part)
        edges = np.cumsum([0, *lengths]).tolist()
        for block, a, b in zip(part.column("block").to_pylist(), edges, edges[1:]):
            rows["block"].append(block)
            rows["bucket"].append(bucket)
            rows["level"].append(k)
            rows["counts"].append(_planes(totals[inverse[a:b]]))
    return pa.table(rows, pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("level", pa.int32()), ("counts", pa.binary())]))


def _count_words(asked: pa.Table) -> pa.Table:
    """Distinct and all training tokens of one bucket."""
    part = asked.filter(pc.equal(asked.column("level"), 0))
    totals = _summed(part)[0] if part.num_rows else np.zeros(0, np.uint64)
    return pa.table({"n_kinds": pa.array([int((totals > 0).sum())], pa.int64()), "n_all": pa.array([int(totals.sum())], pa.int64())})


class Automaton:
    """States are contexts: 0 is the empty one, then those of each level in turn."""

    def __init__(self, block: Block, counts: list[np.ndarray], n_all: int, n_kinds: int) -> None:
        order = len(block.levels)
        words = block.levels[0]
        self.n_words = max(1, len(words.keys))
        offsets = np.cumsum([1] + [len(x.keys) for x in block.levels[: order - 1]])
        size = int(offsets[-1]) if order > 1 else 1
        self.fails_to = np.zeros(size, np.int64)
        self.fail_weight = np.zeros(size)
        prob = (counts[0] + ADDED) / (n_all + ADDED * (n_kinds + 1))
        self.base = np.log10(prob)
        self.base_next = offsets[0] + np.arange(len(words.keys)) if order > 1 else np.zeros(len(words.keys), np.int64)
        codes, weights, targets = [], [], []
        for k in range(1, order):
            level, below = block.levels[k], block.levels[k - 1]
            states = offsets[k - 1] + np.arange(len(below.keys))
            keep = WEIGHT * counts[k - 1] / (counts[k - 1] + PRIOR)
            self.fail_weight[states] = np.log10(1 - keep)
            if k > 1:
                shorter = block.levels[k - 2].at[below.first]
                self.fails_to[states] = offsets[k - 2] + shorter
            context, last, suffix = below.at[level.first - 1], words.at[level.first], below.at[level.first]
            seen = counts[k] > 0
            share = keep[context] * counts[k] / np.maximum(counts[k - 1][context], 1)
            prob = share + (1 - keep[context]) * prob[suffix]
            codes.append((states[0] + context[seen]) * self.n_words + last[seen] if len(states) else context)
            weights.append(np.log10(prob[seen]))
            targets.append((offsets[k] + np.arange(len(level.keys)))[seen] if k < order - 1 else (offsets[k - 1] + suffix)[seen])
        code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        by_code = np.argsort(code)
        self.code = np.append(code[by_code], np.iinfo(np.int64).max)
        self.weight = np.concatenate([*weights, np.zeros(0)])[by_code]
        self.target = np.concatenate([*targets, np.zeros(0, np.int64)])[by_code]

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of one word from each state, and the next states."""
        score, after = np.zeros(len(states)), np.empty(len(states), np.int64)
        live, now = np.arange(len(states)), states
        while len(live):
            word = words[live]
            code = now * self.n_words + word
            arc = np.searchsorted(self.code, code)
            found = self.code[arc] == code
            at_root = now == 0
            hit = live[found]
            score[hit] += self.weight[arc[found]]
            after[hit] = self.target[arc[found]]
            end = at_root & ~found
            score[live[end]] += self.base[word[end]]
            after[live[end]] = self.base_next[word[end]]
            rest = ~found & ~at_root
            live, now = live[rest], now[rest]
            score[live] += self.fail_weight[now]
            now = self.fails_to[now]
        return score, after

    def traverse(self, block: Block) -> np.ndarray:
        """The log-probability of each document."""
        words, order = block.levels[0].at, len(block.levels)
        lanes = -(-block.lengths // LANE)
        doc = np.repeat(np.arange(len(lanes)), lanes)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        length = np.minimum(LANE, block.lengths[doc] - start)
        by_length = np.argsort(-length, kind="stable")
        doc, start, length = doc[by_length], start[by_length], length[by_length]
        before = block.begins[doc] + start  # the token before each lane
        states = np.zeros(len(doc), np.int64)
        for back in range(order - 2, -1, -1):
            inside = np.flatnonzero(start >= back)
            states[inside] = self.step(states[inside], words[before[inside] - back])[1]
        alive = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
        total = np.zeros(len(doc))
        for k, n in enumerate(alive.tolist(), 1):
            score, states = self.step(states[:n], words[before[:n] + k])
            total[:n] += score
        return np.bincount(doc, total, len(lanes))


def _score(docs: pa.Table, answers: pa.Table, order: int, buckets: int, bits: int, out: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return out.empty_table()
    held = docs.column("held_out").to_pylist()
    block = read_block(docs.column("text").to_pylist(), held, order, bits)
    by = {(b, k): i for i, (b, k) in enumerate(zip(answers.column("bucket").to_pylist(), answers.column("level").to_pylist()))}
    counts = []
    for k, level in enumerate(block.levels):
        edges = _edges(level.keys, buckets, bits if k else 64)
        told = [_values(answers.column("counts")[by[b, k]].as_py()) for b in np.flatnonzero(np.diff(edges)).tolist()]
        counts.append(np.concatenate([np.empty(0, np.uint64), *told]).astype(np.int64))
    whole = by[-1, -1]
    n_kinds, n_all = answers.column("n_kinds")[whole].as_py(), answers.column("n_all")[whole].as_py()
    automaton = Automaton(block, counts, n_all, n_kinds)
    score = automaton.traverse(block)
    words = block.levels[0].at
    inside = np.ones(len(words), bool)
    inside[block.begins] = False
    edges = block.begins - np.arange(len(block.begins))  # the leading ends are left out
    base = np.add.reduceat(automaton.base[words[inside]], edges)
    known = np.add.reduceat((counts[0][words[inside]] > 0).astype(np.int64), edges)
    return pa.Table.from_arrays([docs.column("doc_id"), pa.array(held, pa.bool_()), pa.array(block.lengths), pa.array(known), pa.array(np.full(len(edges), n_all)), pa.array(base), pa.array(score)], schema=out)


def held_out_fifth(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def score_texts(docs: DataFrame, held_out: F.Column, order: int = ORDER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Learn from rows where ``held_out`` is false, score all: one row per row of ``docs``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    buckets = max(1, -(-blocks // BLOCKS_PER_BUCKET))
    bits = key_bits(int(chars))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(lambda t: _ask(t, order, buckets, bits), ASKED)
    by_bucket = asked.groupBy("bucket")
    whole = by_bucket.applyInArrow(_count_words, "n_kinds long, n_all long").agg(F.sum("n_kinds").alias("n_kinds"), F.sum("n_all").alias("n_all"))  # one row
    last = F.lit(blocks - 1)
    to_each = whole.select("*", F.explode(F.sequence(F.lit(0), F.floor(last / 4096).cast("int"))).alias("k"))
    to_each = to_each.select("n_kinds", "n_all", F.explode(F.sequence(F.col("k") * 4096, F.least(F.col("k") * 4096 + 4095, last))).alias("block"))
    answered = by_bucket.applyInArrow(_answer, ANSWERED).withColumns({"n_kinds": F.lit(None).cast("long"), "n_all": F.lit(None).cast("long")})
    answered = answered.unionByName(to_each.select(F.col("block").cast("int").alias("block"), F.lit(-1).alias("bucket"), F.lit(-1).alias("level"), F.lit(None).cast("binary").alias("counts"), "n_kinds", "n_all"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(lambda d, a: _score(d, a, order, buckets, bits, out), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out_fifth())
