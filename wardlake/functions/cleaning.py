"""Column expressions for ages, dates, text cleaning and input checks.

All are built-in Spark expressions (no Python UDF), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ X1, X2
def age_years(birth, as_of) -> Column:
    """Whole calendar years between birth and ``as_of`` (sign dropped, as a
    date difference does); NULL without a birth date.  29 Feb -> 28 Feb of
    the next year is 0 years."""
    as_of_col = F.lit(as_of).cast("date") if isinstance(as_of, str) else _c(as_of)
    b = _c(birth).cast("timestamp_ntz")
    return F.abs(F.timestamp_diff("YEAR", b, as_of_col.cast("timestamp_ntz"))).cast("int")


def day_text(c) -> Column:
    """Date or timestamp as ``yyyy-MM-dd`` text."""
    return F.date_format(_c(c), "yyyy-MM-dd")


# ------------------------------------------------------------------ X3, X4, X5
def parse_timestamp(c, default) -> Column:
    """Lenient timestamp parse (``2025-05-01T08:30``, ``2025-05-01 08:30:00``,
    a bare date); a missing or unreadable value becomes ``default``."""
    text = F.trim(_c(c).cast("string"))
    # straight to wall-clock time: no session zone can shift it, and an offset
    # written in the text is passed over
    parsed = text.try_cast("timestamp_ntz")
    dflt = F.lit(default).cast("timestamp_ntz") if isinstance(default, str) else _c(default)
    return F.coalesce(parsed, dflt)


# ------------------------------------------------------------------ X6, X7
# A comment, or a tag whose quoted attribute values may hold ``>``; possessive throughout, so the
# scan never goes back and runs in constant stack, whatever is left open at the end of a long text.
MARKUP = (r"""(?s)<!--(?:-?>|.*?(?:-->|\z))|<(?!\s|\z)(?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)""")


def strip_tags(c) -> Column:
    """Remove markup in one pass from the left: comments, then tags with their
    quoted attribute values.  A comment, a quote or a tag that is never closed
    goes to the end of the text; a comment mark inside a quoted value and a
    quote inside a comment mean nothing.  A ``<`` before white space or at the
    end is no tag and stays (``temp < 38``)."""
    return F.regexp_replace(_c(c), MARKUP, "")


def escape_html(c) -> Column:
    """Escape ``& " ' < >`` (ampersand first, so escapes are not doubled)."""
    out = _c(c)
    for raw, esc in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#039;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def clean_text(c) -> Column:
    """Tag removal then escaping: the cleaning applied to free text fields."""
    return escape_html(strip_tags(c))


# ------------------------------------------------------------------ X8, X9, X10, X13
NUMBER_PREFIX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def number_prefix(c) -> Column:
    """The leading decimal number of a text (``"170cm"`` -> 170), as an exact
    decimal; NULL when the text does not start with a number."""
    m = F.regexp_extract(F.trim(_c(c).cast("string")), NUMBER_PREFIX, 0)
    return F.when(m != "", m.try_cast("decimal(38,10)"))


def height_m(c, strict: bool = False) -> Column:
    """Height given in centimetres -> metres with 2 decimals, half away from
    zero.  A value that is missing or not positive becomes 0.00, or NULL
    when ``strict``; a value the column cannot hold becomes NULL."""
    cm = number_prefix(c)
    metres = F.round(cm / F.lit(100), 2).try_cast("decimal(4,2)")  # NULL above 99.99 m
    fallback = F.lit(None).cast("decimal(4,2)") if strict else F.lit("0.00").cast("decimal(4,2)")
    return F.when(cm > 0, metres).otherwise(fallback)


def to_decimal(c, precision: int, scale: int) -> Column:
    """Round to the column's scale; NULL when the value does not fit."""
    return _c(c).cast("string").try_cast(f"decimal({precision},{scale})")


def to_int(c) -> Column:
    return F.trim(_c(c).cast("string")).try_cast("int")


def to_long(c) -> Column:
    return F.trim(_c(c).cast("string")).try_cast("bigint")


# ------------------------------------------------------------------ F9 .. F14
DATE_SHAPE = r"^\d{4}-\d\d-\d\d$"  # the calendar check refuses wrong months and days


def valid_date_text(c) -> Column:
    """``YYYY-MM-DD`` shape and a real calendar day (31 February fails)."""
    t = _c(c).cast("string")
    return F.coalesce(t.rlike(DATE_SHAPE) & F.try_to_date(t, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_empty(c) -> Column:
    """Missing in the lenient sense: NULL, '' or '0' (so also the number 0)."""
    t = F.trim(_c(c).cast("string"))
    return F.coalesce(t.isin("", "0"), F.lit(True))


def positive_int(c) -> Column:
    """True for a text or number that is an integer > 0."""
    v = to_long(c)
    return F.coalesce(v > 0, F.lit(False))


def truthy(c) -> Column:
    """Boolean parse of text: 1/true/on/yes are true, everything else false."""
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin("1", "true", "on", "yes"), F.lit(False))


def empty_to_null(c) -> Column:
    return F.when(~is_empty(c), _c(c))


def first_missing(fields: list[str]) -> Column:
    """Name of the first field that is NULL, else NULL."""
    return F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])


def like_ci(c, term) -> Column:
    """``LIKE '%term%'`` ignoring case; ``%`` and ``_`` in the term act as
    wildcards, a backslash is taken literally."""
    t = F.lit(term) if isinstance(term, str) else _c(term)
    pattern = F.concat(F.lit("%"), F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.like(F.collate(_c(c), "UTF8_LCASE"), F.collate(pattern, "UTF8_LCASE"))


# ------------------------------------------------------------------ text folding for search
def _accent_map() -> tuple[str, str]:
    """Lower-case letters of any script that decompose into a base letter and
    marks, with their base letters; then the combining marks themselves,
    which have no counterpart and so are dropped.  Built from the Unicode
    data; the few letters without a decomposition are fixed values."""
    src, dst, marks = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
        elif ch.isalpha() and ch == ch.lower():
            parts = unicodedata.normalize("NFD", ch)
            if len(parts) > 1 and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
                src.append(ch)
                dst.append(parts[0])
    # Letters with a stroke or dot that do not decompose.
    for ch, base in (("đ", "d"), ("ħ", "h"), ("ı", "i"), ("ŀ", "l"), ("ł", "l"), ("ø", "o"), ("ŧ", "t")):
        src.append(ch)
        dst.append(base)
    return "".join(src) + "".join(marks), "".join(dst)


ACCENTED, ACCENT_BASE = _accent_map()


def fold(c) -> Column:
    """Lower case, accents and combining marks of any script removed: the form
    single and batch search compare in (a plain codegen'd comparison, no
    per-row collation)."""
    return F.translate(F.lower(_c(c)), ACCENTED, ACCENT_BASE)


def contains_folded(c, term) -> Column:
    t = F.lit(term) if isinstance(term, str) else _c(term)
    return F.contains(fold(c), fold(t))


def grams(c, size: int | Column) -> Column:
    """Distinct ``size``-character substrings of a (folded) text; empty when shorter."""
    s = _c(c)
    last = F.char_length(s) - (size - 1)
    pieces = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(s, i, size))
    return F.when(last >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def literal_runs(c, wildcards: bool) -> Column:
    """The pieces of a search term that every match holds as they are: the
    whole term, or with ``wildcards`` what lies between ``%`` and ``_``."""
    pieces = F.split(_c(c), "[%_]") if wildcards else F.array(_c(c))
    return F.filter(pieces, lambda p: p != "")


def run_grams(runs: Column, size: int) -> Column:
    """The index entries that a match must have, from its literal runs: runs of
    at most ``size`` characters themselves, of longer ones all pieces of that size."""
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(F.char_length(r) < size, F.array(r)).otherwise(grams(r, size)))))
