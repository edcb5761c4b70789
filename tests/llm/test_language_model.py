"""The automaton against the recursion summed by brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from mutua.llm import ngram_lm


def plain_scores(rows, order):
    """rows: (id, text, held out)."""
    seqs = [[None, *((t or "").encode().lower().split()), None] for _, t, _ in rows]
    counts = [Counter() for _ in range(order + 1)]
    for s, (_, _, held) in zip(seqs, rows):
        if not held:
            for k in range(1, order + 1):
                for i in range(max(k - 1, 1), len(s)):
                    counts[k][tuple(s[i - k + 1 : i + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])

    def p(context, w):
        if not context:
            return (counts[1][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        c = counts[len(context)][context]
        keep = ngram_lm.WEIGHT * c / (c + ngram_lm.PRIOR)
        return (keep * counts[len(context) + 1][(*context, w)] / c if c else 0) + (1 - keep) * p(context[1:], w)

    out = {}
    for (i, _, _), s in zip(rows, seqs):
        score = sum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
        base = sum(math.log10(p((), w)) for w in s[1:])
        known = sum(counts[1][(w,)] > 0 for w in s[1:])
        out[i] = (len(s) - 1, known, n, base, score)
    return out, p, counts


def _rows(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "é", "on", "mat"] + [f"r{k}" for k in range(40)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words[: rng.choice([7, 47])]) for _ in range(rng.choice([0, 1, 5, 40])))
        rows.append((k, text if k % 11 else None, zlib.crc32(str(k).encode()) % 5 == 1))
    return rows


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    rows = _rows(150, order)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, block string").repartition(3)
    want, _, _ = plain_scores(rows, order)
    got = ngram_lm.score_texts(docs, ngram_lm.held_out_fifth(), order, block_chars=700).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens, known, n, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.held_out == rows[r.doc_id][2]
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_lanes_change_no_score(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 3, 7, 50, 200)]
    for order in (1, 2, 3, 4):
        block = ngram_lm.read_block(texts, [k % 3 == 1 for k in range(len(texts))], order)
        automaton = ngram_lm.Automaton(block, [x.trained for x in block.levels], int(block.levels[0].trained.sum()), len(block.levels[0].keys))
        want = automaton.traverse(block)
        for lane in (1, 2, 3, 10):
            monkeypatch.setattr(ngram_lm, "LANE", lane)
            assert np.allclose(automaton.traverse(block), want, rtol=1e-12)
        monkeypatch.undo()


def test_key_bits():
    assert ngram_lm.key_bits(0) == 1 + ngram_lm.SPARE_BITS and ngram_lm.key_bits(1 << 62) == 64
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 1000, dtype=np.uint64))
    edges = ngram_lm._edges(keys, 7, 40)
    assert edges[0] == 0 and edges[-1] == 1000 and all(len(set((int(k) * 7) >> 40 for k in keys[a:b])) == 1 for a, b in zip(edges, edges[1:]))


def test_probabilities_sum_to_one():
    rows = _rows(60, 9)
    _, p, counts = plain_scores(rows, 3)
    words = [w for (w,) in counts[1]]
    for context in [(), (b"the",), (b"cat", b"sat"), (b"never",), (None, b"the")]:
        assert abs(sum(p(context, w) for w in words) + p(context, b"unknown") - 1) < 1e-9


def test_empty_and_untrained(spark):
    assert ngram_lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), ngram_lm.held_out_fifth()).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in ngram_lm.score_texts(docs, F.lit(True)).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score == got[1].base_score == 0.0


def test_corpus_text_beats_base(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = ngram_lm.score_texts(docs, ngram_lm.held_out_fifth()).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_byte_planes_round_trip():
    values = np.array([0, 1, 255, 2**40, 2**64 - 1], np.uint64)
    assert (ngram_lm._values(ngram_lm._planes(values)) == values).all()
    assert len(ngram_lm._values(ngram_lm._planes(values[:0]))) == 0
