"""Operators written as SQL over named inputs.

An ``Op`` is SQL text with ``{name}`` for each input table. It runs on DataFrames
through ``spark.sql``, so Catalyst plans it together with whatever feeds it, and it
renders as DuckDB text for checks. The few functions that the two engines spell
differently are written as upper-case macros, listed in ``MACROS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Render = Callable[..., str]

#: Macro: (Spark form, DuckDB form).
MACROS: dict[str, tuple[Render, Render]] = {
    "PCT": (lambda x, p: f"percentile({x}, {p})", lambda x, p: f"quantile_cont({x}, {p})"),
    "SEQ": (lambda a, b: f"explode(sequence({a}, {b}))", lambda a, b: f"unnest(generate_series({a}, {b}))"),
    "XOR": (lambda a, b: f"(({a}) ^ ({b}))", lambda a, b: f"xor({a}, {b})"),
    "DIV": (lambda a, b: f"(({a}) div ({b}))", lambda a, b: f"(({a}) // ({b}))"),
    "HOURNO": (lambda x: f"(datediff({x}, date'2024-01-01') * 24 + hour({x}))", lambda x: f"(date_diff('day', DATE '2024-01-01', CAST({x} AS DATE)) * 24 + hour({x}))"),
    "DAYNO": (lambda x, d: f"datediff({x}, date'{d}')", lambda x, d: f"date_diff('day', DATE '{d}', CAST({x} AS DATE))"),
    "SETOF": (lambda x: f"array_sort(collect_set({x}))", lambda x: f"list_sort(list(DISTINCT {x}))"),
    "COMMON": (lambda a, b: f"size(array_intersect({a}, {b}))", lambda a, b: f"len(list_intersect({a}, {b}))"),
    "SIZE": (lambda a: f"size({a})", lambda a: f"len({a})"),
    "JSONINT": (lambda x, k: f"CAST(get_json_object({x}, '$.' || {k}) AS BIGINT)", lambda x, k: f"CAST(json_extract_string({x}, '$.' || {k}) AS BIGINT)"),
    "JOINED": (lambda a, s: f"array_join({a}, {s})", lambda a, s: f"array_to_string({a}, {s})"),
    "ELEMENT": (lambda a, k: f"element_at({a}, {k})", lambda a, k: f"{a}[{k}]"),
    "HASHNO": (lambda x: f"CAST(conv(substr(md5({x}), 1, 12), 16, 10) AS BIGINT)", lambda x: f"CAST(('0x' || substr(md5({x}), 1, 12)) AS BIGINT)"),
    "SHA256": (lambda x: f"sha2({x}, 256)", lambda x: f"sha256({x})"),
    "WITHOUT": (lambda a, x: f"array_remove({a}, {x})", lambda a, x: f"list_filter({a}, lambda w: w <> {x})"),
    "CORR": (lambda a, b: f"(regr_sxy({a}, {b}) / nullif(sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})), 0))", lambda a, b: f"(regr_sxy({a}, {b}) / nullif(sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})), 0))"),  # null without spread, where corr fails or gives not-a-number
    "DBL": (lambda x: f"CAST({x} AS DOUBLE)", lambda x: f"CAST({x} AS DOUBLE)"),  # plain numbers are decimals in both engines
    "MATCHES": (lambda a, p: f"({a} rlike {p})", lambda a, p: f"regexp_matches({a}, {p})"),
}
_MACRO = re.compile(r"\b(" + "|".join(MACROS) + r")\(")


def quoted(text: str) -> str:
    """``text`` as a literal of both engines."""
    return "'" + text.replace("'", "''") + "'"


def _expand(text: str, engine: int) -> str:
    while m := _MACRO.search(text):
        depth, args, start, quoted = 1, [], m.end(), False
        for k in range(m.end(), len(text)):
            ch = text[k]
            if ch == "'":
                quoted = not quoted
            elif quoted:
                continue
            elif ch in "([":
                depth += 1
            elif ch in ")]":
                depth -= 1
            if depth == 0 or (depth == 1 and ch == ","):
                args.append(text[start:k].strip())
                start = k + 1
                if depth == 0:
                    break
        text = text[: m.start()] + MACROS[m[1]][engine](*args) + text[k + 1 :]
    return text


@dataclass(frozen=True)
class Op:
    """SQL text over named inputs."""

    text: str

    def __call__(self, **inputs: DataFrame) -> DataFrame:
        session = next(iter(inputs.values())).sparkSession
        return session.sql(_expand(self.text, 0), **inputs)

    def duckdb(self, **inputs: str) -> str:
        """The same as DuckDB text; ``inputs`` are queries for the named tables."""
        names = {k: f"in_{k}" for k in inputs}
        views = ", ".join(f"{names[k]} AS ({q})" for k, q in inputs.items())
        return f"WITH {views} SELECT * FROM ({_expand(self.text, 1).format(**names)}) AS result"
