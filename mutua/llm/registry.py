"""Named queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mutua.llm import chat, collocations, decontaminate, html_extract, ngram_lm, packing, pii, quality, resample, secrets, simhash, toxicity, warc

_MODULES = (packing, warc, simhash, ngram_lm, pii, chat, quality, html_extract, secrets, decontaminate, resample, toxicity, collocations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL}
