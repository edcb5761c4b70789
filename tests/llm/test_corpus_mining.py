"""Resampling, toxicity and collocations against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mutua.llm import collocations, resample, toxicity

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SAYINGS = ["The quick brown fox", "naïve Façade", "ünïcode 漢字 mix", "a", "it-is  so", "x" * 300, "tab\there", "line\nbreak, twice", "İstanbul É e"]


def texts_of(n, seed):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(SAYINGS) for _ in range(rng.choice([0, 1, 3, 12, 40]))) for _ in range(n)]
    return out + [None, "", " .,;\n", out[0], out[0]]


def frame(spark, texts, ids=None, **more):
    rows = [(k if ids is None else ids[k], t, "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, rank int").repartition(3)


# ---- resampling


def runs(text):
    words = ALNUM.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    rows = []
    for doc_id, text in docs:
        words, features = runs(text)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: 25 * len(fit) // 100]
    return rows, [(r[0], k) for k, r in enumerate(drawn, 1)]


def test_prefix_crcs_are_those_of_the_substrings():
    words = [w.encode() for w in runs(" ".join(SAYINGS * 3))[0]]
    prefixes = resample.Prefixes([words, [], [b"one"], words[:5]])
    for n in (1, 2, 3, 7):
        text, crc = prefixes.ngrams(n)
        want = [(k, zlib.crc32(b" ".join(own[i : i + n]))) for k, own in enumerate([words, [], [b"one"], words[:5]]) for i in range(len(own) - n + 1)]
        assert list(zip(text.tolist(), crc.tolist())) == want


def test_resample(spark):
    texts = texts_of(60, 1)
    ids = [None if k == 7 else 5 if k in (3, 4) else k for k in range(len(texts))]
    docs, target = list(zip(ids, texts)), [SAYINGS[0] + " " + SAYINGS[2], None]
    got = resample.resample(frame(spark, texts, ids), frame(spark, target)).collect()
    rows, drawn = plain_resample(docs, target)
    assert sorted(repr([r.doc_id, r.n_features, r.weight, r.score]) for r in got) == sorted(repr(r[:4]) for r in rows)
    assert [(r.doc_id, r["rank"]) for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn


def test_resample_defined_cases(spark):
    none = frame(spark, ["x"]).limit(0)
    assert resample.resample(none, frame(spark, ["x y"])).collect() == []
    got = resample.resample(frame(spark, ["a b"] * 3, [1, 1, 1]), none, min_words=1, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3] and len({(r.weight, r.score) for r in got}) == 1
    long = resample.weigh(frame(spark, ["word " * 300_000]), np.zeros(10_000, np.int64)).first()
    assert (long.n_words, long.n_features) == (300_000, 599_999)


# ---- toxicity


def test_logits_are_plain_sums_over_pairs():
    rng = np.random.default_rng(0)
    machine = toxicity.Machine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    own = [[1, 5, 7], [], [0], list(range(30))]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    want = [0.3 + sum(machine.weights[t] for t in x) + sum(machine.factors[a] @ machine.factors[b] for k, a in enumerate(x) for b in x[:k]) for x in own]
    assert machine.logits(begins, np.array([t for x in own for t in x], np.int64)) == pytest.approx(want)


def test_pairs_count_for_more_than_their_parts():
    """Neither of two terms alone tells anything: only both or none is toxic."""
    rng = np.random.default_rng(1)
    own = [[t for t in range(4) if rng.random() < 0.5] for _ in range(3000)]
    toxic = np.array([float((0 in x) == (1 in x)) for x in own])
    begins = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    machine = toxicity.train(begins, np.array([t for x in own for t in x], np.int64), toxic, np.arange(4, dtype=np.int32))
    found = lambda *x: machine.scores(np.array([0, len(x)]), np.array(x, np.int64))[0]
    assert found(0, 1) > 0.9 and found() > 0.5 and max(found(0), found(1)) < 0.4


def toxic_corpus(n=900, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "do", "ke", "lu") for b in ("ri", "so", "ta") for c in ("n", "m", "ler", "tion")]
    docs, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 3) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["Grobast", "grobasten", "vilter", "grobash"]))
        docs.append(" ".join(text))
        labels.append((k, 1, int(bad)))
    return docs, labels


def test_toxicity(spark):
    texts, labels = toxic_corpus()
    docs = frame(spark, texts + [None, ""])
    marks = spark.createDataFrame(labels + [(5, 1, None), (99_999, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(texts) + 2
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(t, got[k].predicted) for k, _, t in labels if got[k].held_out]
    assert sum(t for t, _ in held) > 10
    assert sum(t == p for t, p in held) >= 0.97 * len(held) and sum(p for t, p in held if t) >= 0.9 * sum(t for t, _ in held)
    assert got[len(texts)].score == got[len(texts) + 1].score < 0.5
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7), marks).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_held_out_labels_are_not_used(spark):
    texts, labels = toxic_corpus(300, 3)
    marks = lambda flip: spark.createDataFrame([(k, 1, 1 - t if flip and zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, _, t in labels], "doc_id long, quality int, toxic int")
    scores = [{r.doc_id: r.score for r in toxicity.toxicity(frame(spark, texts), marks(flip)).collect()} for flip in (False, True)]
    assert scores[0] == scores[1]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark, ["a", None]), none).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, ["a"]).limit(0), none).collect() == []


# ---- collocations


def plain_collocations(docs, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        if any(other == lang and len(w) > len(words) and 100 * b >= 100 * a and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1)) for (other, w), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def phrase_docs(n=150, seed=4):
    rng = random.Random(seed)
    parts = ["New York City", "in the end", "of the", "to be or not to be", "on, off", "a", "café au lait", "the", "x\ty", "end. The", "non\xa0breaking", "en en en", "en de"]
    docs = [(rng.choice(["en", "de", "es", None, "und"]), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    return docs + [("en", None), ("fr", ""), ("de", " \n.;"), docs[0], docs[0]]


@pytest.mark.parametrize(("shards", "slot_bits", "top"), [(4, 16, 2000), (3, 3, 7)])
def test_collocations(spark, shards, slot_bits, top):
    """Also with a table so small that all phrases share slots: everything is counted, nothing changes."""
    docs = phrase_docs()
    got = collocations.collocations(spark.createDataFrame([(lang, t, 1, 2) for lang, t in docs], "lang string, text string, n int, key int").repartition(4), min_count=12, top=top, shards=shards, slot_bits=slot_bits)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(docs, 12, 5, top)


def test_collocations_late_in_the_scans(spark):
    """Phrases that reach the threshold only with their last occurrence, in the last shard."""
    docs = [("en", f"alpha beta gamma delta word{k}") for k in range(12)] + [("en", "filler " * k) for k in range(9)]
    got = collocations.collocations(spark.createDataFrame(docs, "lang string, text string").coalesce(1), min_count=12, shards=4, slot_bits=12)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(docs, 12, 5, 2000)


def test_collocations_end_when_the_longest_have_had_their_cycle(spark):
    """Each length reaches the threshold in the last scan of its cycle; nothing is left to count after the fifth."""
    docs = [("en", "alpha beta gamma delta epsilon")] * 12
    scans = collocations.dynamic_counts(spark.createDataFrame(docs, "lang string, text string").coalesce(1), 12, slot_bits=12)
    assert scans.n_scans == 3 * 5
    assert sorted(r.n for r in scans.frequent.collect()) == [12] * 15


def test_words_are_coded_from_the_bytes_of_all_texts():
    """Words of all lengths, also around eight and 64 bytes, are those of plain splitting, and have a code each in a language."""
    rng = random.Random(9)
    some = ["a", "A\0", "a\0", "seven77", "eight888", "eight888x", "é" * 8, "x" * 63, "x" * 64, "x" * 65, "x" * 300, "漢字", "\x1f", "non\xa0breaking", "it's"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "\t", "  ", ".", ", ", "\n", "?! "]) for _ in range(rng.choice([0, 1, 50]))) for _ in range(60)] + ["", " .", "end"]
    langs = [rng.choice(["en", "de"]) for _ in texts]
    rows = [r.to_pylist()[0] for r in collocations._encode(iter([pa.RecordBatch.from_pydict({"lang": langs, "text": texts})]), 3)]
    want, names, codes = {}, {}, set()
    for k, (lang, text) in enumerate(zip(langs, texts)):
        own = re.sub(r"[.,;:!?\n\x0b\x0c\r]", " . ", text.translate(LOWER))
        want.setdefault((lang, k % 3), []).extend([w.encode() for w in re.split(r"[ \t]+", own) if w] + [b"."])
    for r in rows:
        got = np.frombuffer(r["words"], np.uint64).tolist()
        _, _, begins, sizes = collocations.word_places(r["text"])
        words = iter([r["text"][b : b + n] for b, n in zip(begins, sizes)])
        spelled = [next(words) if code else b"." for code in got]
        assert spelled == want.pop((r["lang"], r["shard"])) and r["n_words"] == len(sizes)
        for code, word in zip(got, spelled):
            assert names.setdefault((r["lang"] if code else "", word), code) == code
        codes |= set(got)
    assert not want and len(codes) == len(names)


def test_collocations_spelled_by_a_second_pass(spark):
    docs = spark.createDataFrame([("en", "one two three")] * 40, "lang string, text string")
    scans = collocations.dynamic_counts(docs, 20, slot_bits=12)
    got = {(r.phrase, r.size, r.n) for r in collocations.spell(scans, slot_bits=12, spelled=0).collect()}
    assert got == {("one", 1, 40), ("two", 1, 40), ("three", 1, 40), ("one two", 2, 40), ("two three", 2, 40), ("one two three", 3, 40)}


def test_collocations_defined_cases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    with pytest.raises(ValueError):
        collocations.dynamic_counts(empty, shards=7)
    long = spark.createDataFrame([("en", "ab cd " * 100_000)], "lang string, text string")
    assert [(r.phrase, r.a, r.n) for r in collocations.collocations(long, slot_bits=12).where("rank = 1").collect()] != []
