"""Word splitting shared by the operators of this subpackage."""

from __future__ import annotations

#: ASCII characters that are not letters or digits become blanks; bytes of other characters stay.
_ALNUM_ONLY = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: The same word rule for Spark's and DuckDB's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def blank_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().translate(_ALNUM_ONLY).split()
