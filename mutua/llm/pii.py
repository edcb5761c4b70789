"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Six kinds. Four are *base* kinds, found exactly by pattern and validator:
email, ip, card (Luhn), phone. Two are added by the method: iban (of its country's
length, mod-97) and ssn; they are kept only when their score with context words reaches
the threshold. A base span is never dropped by its score. Context words are whole words;
those that raise a score may stand before or after the span, those that lower it before.

Defined cases: a null text is empty and has no spans; offsets are code points,
end exclusive; repeated rows give repeated results; an empty table gives an empty
table; other columns of the input are ignored. Time is linear in the text: each
character run is tried once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.storage import table

QUERY = "op5_pii"
ORACLE_SQL = None  # the spans of the method itself have no SQL form

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
#: A kind's score before context, the words near a span that raise it, and those that lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9, "ssn": 0.3}
RAISING = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social security", "social"),
}
LOWERING = ("version", "example", "isbn", "order", "part no", "serial")
#: Characters of an account number, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
CONTEXT_CHARS = 48
CONTEXT_STEP = 0.3
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is tried from its first digit only: what follows it is the same from every later digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NO_DIGITS = re.compile(r"[^0-9]+")


def _any_word(words: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])")


_RAISING = {kind: _any_word(words) for kind, words in RAISING.items()}
_LOWERING = _any_word(LOWERING)


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of ISO 7064 on an account code without blanks."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _score(text: str, kind: str, start: int, end: int) -> float:
    before = text[max(0, start - CONTEXT_CHARS) : start].lower()
    score = SCORES[kind]
    if _RAISING[kind].search(before) or _RAISING[kind].search(text[end : end + CONTEXT_CHARS // 2].lower()):
        score += CONTEXT_STEP
    if _LOWERING.search(before):
        score -= CONTEXT_STEP
    return round(min(1.0, max(0.0, score)), 2)


def scan(text: str) -> list[tuple[int, int, int, float]]:
    """Spans of one text as (start, kind index, end, score), in order."""
    found: list[tuple[int, int, int]] = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    done = 0
    for m in _IBAN_HEAD.finditer(text):
        if m.start() >= done and (n := IBAN_LENGTHS.get(m[1])) and (rest := _IBAN_REST[n].match(text, m.end())) and mod97((m[0] + rest[0]).replace(" ", "")):
            done = rest.end()
            found.append((m.start(), 4, done))
    for m in _SSN.finditer(text):
        found.append((m.start(), 5, m.end()))
    spans = [(s, k, e, _score(text, KINDS[k], s, e)) for s, k, e in sorted(found)]
    return [x for x in spans if KINDS[x[1]] in BASE_KINDS or x[3] >= THRESHOLD]


SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in scan(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN_TYPE))], names=["id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id`` and ``spans`` (kind, start, end, score), ordered by start, then kind."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(_scan_batches, f"id {id_type}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def redact(text: str) -> str:
    """``text`` with each span replaced by its kind; overlapping spans go as one, named by the first."""
    out, done = [], 0
    for start, kind, end, _ in scan(text):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind]}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = "filter(spans, x -> x.kind in ('email', 'ip', 'card', 'phone'))"
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.expr(_joined(base)), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
        F.expr("array_join(transform(spans, x -> concat_ws(':', x.kind, x.start, x.score)), ',')").alias("scores"),
    )
