"""Text column expressions (B1-B6). JVM-side regex and higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three sentence split patterns, applied in this order, each followed
# by strip + drop of empty pieces.
SENTENCE_PATTERNS = (
    r"(?U)(?<=[.!?])\s+(?=[A-Z])",  # after . ! ?, before white space and a capital
    r"(?U)(?<=[.!?])\s*\n\s*",      # after . ! ?, around a new line
    r"(?U)\n\s*\n",                 # blank line
)
# Python's str.splitlines() boundaries.
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: Unicode white space at both ends (``trim`` only drops blanks)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def collapse_ws(c) -> Column:
    return F.regexp_replace(_col(c), r"(?U)\s+", " ")


def _split_strip(arr: Column, pattern: str) -> Column:
    pieces = F.flatten(F.transform(arr, lambda s: F.split(s, pattern, -1)))
    return F.filter(F.transform(pieces, strip), lambda s: s != F.lit(""))


def split_segments(text) -> Column:
    """B1: ``array<string>`` of segments, in order."""
    arr = F.array(_col(text))
    for p in SENTENCE_PATTERNS:
        arr = _split_strip(arr, p)
    return arr


def merge_text(arr) -> Column:
    """B2: join by one space, collapse white space, strip."""
    return strip(collapse_ws(F.array_join(_col(arr), " ")))


def content_key(c) -> Column:
    """md5 of the UTF-8 text, hex."""
    return F.md5(_col(c))


def question_line(c, prefix_chars: int = 200) -> Column:
    """Rest of the first line starting with ``q:`` (any case); else the first 200 characters."""
    c = _col(c)
    lines = F.split(c, LINE_BREAKS, -1)
    hit = F.try_element_at(F.filter(lines, lambda l: F.lower(strip(l)).startswith("q:")), F.lit(1))
    q = strip(F.substring(strip(hit), 3, 1 << 30))
    return F.coalesce(F.nullif(q, F.lit("")), F.substring(c, 1, prefix_chars))


def contains_ci(content, query) -> Column:
    """Case-insensitive substring predicate."""
    return F.lower(_col(content)).contains(F.lower(_col(query)))


def clip_text(c, n: int, suffix: str | None = None) -> Column:
    """Prefix of ``n`` characters, optionally followed by a suffix."""
    cut = F.substring(_col(c), 1, n)
    return F.concat(cut, F.lit(suffix)) if suffix else cut


def word_count(c) -> Column:
    """``len(text.split())``."""
    c = _col(c)
    s = strip(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+", -1)))


def line_count(c) -> Column:
    """``len(text.splitlines())``: a trailing line break does not open a new line."""
    c = _col(c)
    n = F.size(F.split(c, LINE_BREAKS, -1))
    ends = F.regexp_like(c, F.lit("(" + LINE_BREAKS + ")$"))
    return F.when(c == "", F.lit(0)).otherwise(n - F.when(ends, 1).otherwise(0))
