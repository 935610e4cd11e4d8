"""Column expressions for text: Python-compatible strip/split, caps, tokens.

All of these are native Catalyst expressions (regexp_replace, substring,
regexp_extract_all), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.schema import PY_WS_CLASS

_WS_RUN = PY_WS_CLASS + "+"
_EDGES = f"^{_WS_RUN}|{_WS_RUN}$"

# FIXED VALUES: token pattern for the TF-IDF vectors (letters and digits).
TOKEN_PATTERN = "[\\p{L}\\p{N}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove Python white space at both ends."""
    return F.regexp_replace(_c(c), _EDGES, "")


def collapse_ws(c: Column | str) -> Column:
    """``" ".join(s.split())``: one space between words, none at the ends."""
    return py_strip(F.regexp_replace(_c(c), _WS_RUN, " "))


def cap(c: Column | str, n: int) -> Column:
    """``s[:n]`` in code points."""
    return F.substring(_c(c), 1, n)


def null_if_empty(c: Column | str) -> Column:
    return F.nullif(_c(c), F.lit(""))


def join_nonempty(*cols: Column) -> Column:
    """``" ".join(p for p in parts if p)`` (null and "" both skipped)."""
    return F.concat_ws(" ", *[null_if_empty(c) for c in cols])


def first_line(c: Column | str) -> Column:
    return F.split_part(_c(c), F.lit("\n"), F.lit(1))


def tokens(c: Column | str, max_chars: int | None = None) -> Column:
    """Lower-cased letter/digit runs of the whole text, or of its first ``max_chars`` characters."""
    text = _c(c) if max_chars is None else cap(c, max_chars)
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def idiv(a: Column, b: Column) -> Column:
    """Exact integer division of non-negative longs (SQL ``a div b``)."""
    a = a.cast("long")
    b = b.cast("long")
    return ((a - F.pmod(a, b)) / b).cast("long")


def ratio_milli(num: Column, den: Column) -> Column:
    """round(num/den, 3) in thousandths, integer half-up: (2000*num + den) div (2*den)."""
    return idiv(num.cast("long") * 2000 + den.cast("long"), den.cast("long") * 2)


def mean_hundredths_milli(sum_h: Column, n: Column) -> Column:
    """round(mean(hundredths)/100, 3) in thousandths: (20*sum_h + n) div (2*n)."""
    return idiv(sum_h.cast("long") * 20 + n.cast("long"), n.cast("long") * 2)
