"""String functions used by the cleaning and reply-parsing operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() treats as whitespace,
# written as one regex character class that both Java regex and RE2 accept.
PY_WHITESPACE = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Characters turned into a plain space before runs of spaces
# collapse (no-break space and newline).
SPACE_LIKE = r"[\x{A0}\n]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()`` (SQL ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(col), f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")


def clean_whitespace(col) -> Column:
    """No-break space and newline become a space, runs of spaces collapse to
    one, then the value is stripped."""
    c = F.regexp_replace(_c(col), SPACE_LIKE, " ")
    c = F.regexp_replace(c, " {2,}", " ")
    return py_strip(c)


def source_label(col, mode: str = "suffix") -> Column:
    """Label of a source file.

    ``suffix``: drop a trailing ``.pdf``.
    ``charset`` (parity): strip any of the characters ``. p d f`` from both
    ends, which is what stripping with a character set does
    (``fdp-letter.pdf`` gives ``-letter``).
    """
    if mode == "charset":
        return F.expr(f"trim(BOTH '.pdf' FROM {_sql(col)})")
    if mode == "suffix":
        return F.regexp_replace(_c(col), r"\.pdf$", "")
    raise ValueError(f"unknown mode {mode!r}")


def _sql(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("charset mode takes a column name")


def file_stem(col) -> Column:
    """Text before the first dot."""
    return F.substring_index(_c(col), ".", 1)


# Fixed value: the subject marker after which letter text starts.
DEFAULT_MARKER = r"(?i)OBJET\s?:"


def text_after_marker(col, pattern: str = DEFAULT_MARKER) -> tuple[Column, Column]:
    """(text after the first match of ``pattern``, stripped; whether it
    matched). Without a match the text is kept as is."""
    c = _c(col)
    body = pattern[4:] if pattern.startswith("(?i)") else pattern
    flags = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    matched = c.rlike(flags + body)
    after = py_strip(F.regexp_extract(c, flags + body + "(.*)", 1))
    return F.when(matched, after).otherwise(c), F.coalesce(matched, F.lit(False))


def word_count(col) -> Column:
    """Number of whitespace-separated words."""
    t = py_strip(_c(col))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{PY_WHITESPACE}+")))
