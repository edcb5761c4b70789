"""Secret scans with Spark expressions only.

Base kinds are exact patterns: assign (a key name, a separator and a value), access
(a cloud access key id) and hex (a long lower-case hexadecimal run). The method adds
kind entropy: candidate strings whose Shannon entropy, over some window of
``WINDOW`` characters, reaches the threshold of their character class. The window
slides by one; its counts change by the character that enters and the one that
leaves, and so the sum of c*log2(c) is updated by two terms instead of summed anew.

Candidates are looked for where no base span is, and suppressed by an allow list
(identifiers of fixed form, words without digits, paths).

Positions come from splitting the text by the same pattern that lists the matches:
gaps and matches alternate, so running lengths are offsets in code points. Running
totals are folded in blocks of about the square root of their number, so that no
array grows by one element at a time over all of them.

Defined cases: a null text is empty; equal starts are ordered by kind as listed;
repeated rows give repeated results; an empty table gives an empty table; other
columns are ignored. Time is linear in the text, and in the number of matches but for
copies inside the blocks (matches to the power 1.5); no pattern repeats a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.storage import table

QUERY = "op9_secrets"
ORACLE_SQL = None  # the spans of the method itself have no SQL form

KINDS = ("assign", "access", "hex", "entropy")
_KEYS = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
PATTERNS = {
    "assign": _KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "entropy": "[A-Za-z0-9+/_=-]{20,}",
}
#: What a match must also be, by kind: the value's length, the run's length.
_VALUE = "^" + _KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""
WINDOW = 20
#: Bits per character that a full window must reach, by character class of the candidate.
THRESHOLDS = {"hex": 3.2, "base36": 3.5, "base64": 3.7}
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # universally unique ids
    r"^[^0-9]*$",  # words, also hyphenated or joined
    r"^[0-9+=/_-]*$",  # numbers, dates, rulers
    r"(?i)(?:example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh)",
)
#: A path has these characters, a name before a slash, and no empty or long name.
PATH_CHARS, PATH_STEP, NOT_IN_PATH = "^[a-z0-9_/-]*$", "[a-z0-9_-]/", "//|[a-z0-9_-]{16}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value the fold of those before it, in blocks."""

    def fold(xs: Column, begin: Column) -> Column:
        empty = F.struct(begin.alias("now"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(xs, empty, lambda acc, x: F.struct(op(acc["now"], x).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")), lambda acc: acc["out"])

    def in_blocks(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        begins = F.sequence(F.lit(1), F.size(xs), width)
        blocks = F.transform(begins, lambda k: F.slice(xs, k, width))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(F.transform(bs, lambda b: F.aggregate(b, zero, op)), zero), fold)))

    return F.when(F.size(values) > 0, _let(values, in_blocks)).otherwise(F.slice(F.array(zero), 1, 0))


def _pieces(text: Column, pattern: str) -> Column:
    """(gap, match) in order; the last has no match."""
    return F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("match"))


def _located(text: Column, pattern: str) -> Column:
    """(start, match) of every match, in order."""
    match_chars = lambda x: F.coalesce(F.length(x["match"]), F.lit(0))

    def starts(pieces: Column) -> Column:
        before = running(F.transform(pieces, lambda x: F.length(x["gap"]) + match_chars(x)), F.lit(0), lambda a, b: a + b)
        placed = F.zip_with(pieces, before, lambda x, n: F.struct((n + F.length(x["gap"])).alias("start"), x["match"].alias("match")))
        return F.filter(placed, lambda m: m["match"].isNotNull())

    empty = F.array().cast("array<struct<start:int,match:string>>")
    return F.when(text.rlike(pattern), _let(_pieces(text, pattern), starts)).otherwise(empty)


def _blanked(text: Column, pattern: str, counts: Callable[[Column], Column]) -> Column:
    """``text`` with the matches that count as blanks of the same length."""
    shown = lambda m: F.when(counts(m), F.repeat(F.lit(" "), F.length(m))).otherwise(F.coalesce(m, F.lit("")))
    return F.when(text.rlike(pattern), F.array_join(F.transform(_pieces(text, pattern), lambda x: F.concat(x["gap"], shown(x["match"]))), "")).otherwise(text)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + F.length(m["match"])).alias("end")))


def peak_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of any ``window`` consecutive characters; 0 for shorter strings."""
    clogc = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    put = lambda counts, k, c: F.concat(F.slice(counts, 1, k - 1), F.array(c), F.slice(counts, k + 1, F.size(counts) - k))

    def step(codes: Column, acc: Column, i: Column) -> Column:
        """``codes`` number the characters from 1; the count of k is the k-th."""
        enters, leaves = F.get(codes, i), F.get(codes, i - window)
        grown, left = F.get(acc["counts"], enters - 1), F.get(acc["counts"], leaves - 1)
        entered = put(acc["counts"], enters, grown + 1)
        moved = F.when(leaves.isNull(), entered).otherwise(_let(entered, lambda e: put(e, leaves, left - 1)))
        total = acc["total"] + F.get(clogc, grown + 1) - F.get(clogc, grown) + F.when(leaves.isNotNull(), F.get(clogc, left - 1) - F.get(clogc, left)).otherwise(0.0)
        same = enters.eqNullSafe(leaves)
        new = F.struct(F.when(same, acc["counts"]).otherwise(moved).alias("counts"), F.when(same, acc["total"]).otherwise(total).alias("total"))
        return _let(new, lambda s: F.struct(s["counts"].alias("counts"), s["total"].alias("total"), F.when(i >= window - 1, F.greatest(acc["peak"], F.lit(math.log2(window)) - s["total"] / window)).otherwise(acc["peak"]).alias("peak")))

    def slid(chars: Column) -> Column:
        zero = lambda kinds: F.struct(F.transform(kinds, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("peak"))
        fold = lambda kinds, codes: F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero(kinds), lambda acc, i: step(codes, acc, i), lambda acc: acc["peak"])
        return _let(F.array_distinct(chars), lambda kinds: _let(F.transform(chars, lambda c: F.array_position(kinds, c).cast("int")), lambda codes: fold(kinds, codes)))

    return F.when(F.length(text) >= window, _let(F.split(text, ""), slid)).otherwise(F.lit(0.0))


def _threshold(text: Column) -> Column:
    return (
        F.when(text.rlike("^[0-9a-fA-F]+$"), F.lit(THRESHOLDS["hex"]))
        .when(text.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), F.lit(THRESHOLDS["base36"]))
        .otherwise(F.lit(THRESHOLDS["base64"]))
    )


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per input row: ``row`` (all its columns), ``text`` (null as empty) and ``spans`` (start, rank of the kind, end), ordered."""
    text = F.col("text")
    kept = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = {"assign": lambda m: m.rlike(_VALUE), "access": lambda m: F.length(m) >= 20, "hex": lambda m: m.isNotNull()}
    blank = lambda kind, counts: lambda t: _blanked(t, PATTERNS[kind], counts)
    rest = text
    for kind, counts in counted.items():
        rest = _let(rest, blank(kind, counts))
    base_of = lambda k, counts: _spans(F.filter(_located(text, PATTERNS[k]), lambda m: counts(m["match"])), k)
    matched = kept.select("row", "text", F.concat(*[base_of(k, counts) for k, counts in counted.items()]).alias("base"), rest.alias("rest"))

    def suspicious(m: Column) -> Column:
        path = m["match"].rlike(PATH_CHARS) & m["match"].rlike(PATH_STEP) & ~m["match"].rlike(NOT_IN_PATH)
        allowed = reduce(Column.__or__, [m["match"].rlike(p) for p in ALLOWED], path)
        return ~allowed & (peak_entropy(m["match"]) >= _threshold(m["match"]))

    added = _spans(F.filter(_located(F.col("rest"), PATTERNS["entropy"]), suspicious), "entropy")
    return matched.select("row", "text", F.array_sort(F.concat("base", added)).alias("spans"))


MASK = "[SECRET]"


def mask_spans(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with each span replaced by ``mask``; spans that overlap go as one."""
    join = lambda chars, a, n: F.array_join(F.slice(chars, a + 1, n), "")

    def masked(chars: Column, xs: Column) -> Column:
        done = running(F.transform(xs, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        parts = F.zip_with(xs, done, lambda x, d: F.when(x["start"] >= d, F.concat(join(chars, d, x["start"] - d), F.lit(mask))).otherwise(F.lit("")))
        last = F.array_max(F.transform(xs, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), join(chars, last, F.size(chars) - last))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.split(text, ""), lambda chars: _let(spans, lambda xs: masked(chars, xs))))


def mask_secrets(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets in their texts masked, and ``n_chars_col`` counted again where a text changed."""
    found = find_secrets(docs, text_col)
    changed = F.size("spans") > 0
    masked = found.select("row", changed.alias("changed"), F.when(changed, mask_spans(F.col("text"), F.col("spans"))).alias("masked"))
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns[text_col] = F.when(F.col("changed"), F.col("masked")).otherwise(columns[text_col])
    if n_chars_col in columns:
        columns[n_chars_col] = F.when(F.col("changed"), F.length("masked").cast(docs.schema[n_chars_col].dataType)).otherwise(columns[n_chars_col])
    return masked.select(*[x.alias(c) for c, x in columns.items()])


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.filter("spans", lambda s: s["rank"] == k)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(of(KINDS.index(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
