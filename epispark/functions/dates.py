"""Multi-format date parsing as one Column expression.

Formats are tried in a fixed order and the first success wins:

1. a native date/timestamp value, or ISO-like text ``Y-M-D`` (one of the
   separators ``-``, ``/``, space or backslash, used twice; any year width;
   an optional time part), white space around it ignored;
2. ``YYYY-MM-DD``;
3. ``YYYYMMDD`` when the year is 1900–2099;
4. ``DDMMYYYY``;
5. ``YYYYMM`` (day 1) when the year is 1900–2099;
6. ``YYYY`` (1 January) when 1900–2099;
7. ``DD/MM/YYYY``;
8. ``DD-MM-YYYY``.

Spark's own string->date cast is far more lenient than the behaviour we
reproduce (``'202001'`` becomes year 202001, ``'2020'`` and ``'today'``
parse), so the native branch is guarded by a regex and parsed with an
explicit pattern; the digit-only layouts are shape-checked by a regex and
built from their integer parts with ``try_make_timestamp_ntz`` (NULL for an
impossible day such as 31 February). ``\\z`` anchors the end because
Java's ``$`` also matches before a trailing newline. Numeric columns go
through their text form. Out of scope: ``epoch``/``infinity`` keywords, BC
dates and year 0 (the same day exists, spelled differently).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType

from .text import Source, clean_text, col_of

# Native spelling: year (any width), month, day with one separator used
# twice, then optionally a time (hour <= 24, minute and second < 60, an
# optional fraction) followed by a zone or by free text after a space.
_ISO_LIKE = (r"^\d+([-/ \\])\d{1,2}\1\d{1,2}"
             r"(?:(?:T| +)0?(?:[01]?\d|2[0-4]):[0-5]?\d(?::[0-5]?\d(?:\.\d*)?)?"
             r"(?:Z|[+-]\d{2}(?::?\d{2})?| .*)?)?\z")
_ISO_DATE_PART = r"^(\d+[-/ \\]\d{1,2}[-/ \\]\d{1,2})"
# A native cast skips all ASCII white space around the value.
_WHITESPACE = " \t\n\r\u000b\u000c"
_YEAR_GATE = ("1900", "2099")


def _from_parts(y: Column, m: Column, d: Column) -> Column:
    """DATE from digit-only text parts; an impossible date is NULL. Cheaper
    than a pattern parse and identical for digit-only input."""
    ts = F.try_make_timestamp_ntz(y.try_cast("int"), m.try_cast("int"), d.try_cast("int"),
                                  F.lit(0), F.lit(0), F.lit(0))
    return F.to_date(ts)


def _native(c: Column, dtype: DataType | None, txt: Column) -> Column | None:
    if isinstance(dtype, DateType):
        return c
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.to_date(c)
    if dtype is None or isinstance(dtype, StringType):
        raw = F.btrim(c.cast("string"), F.lit(_WHITESPACE))
        # one extraction; the 'y' pattern takes any year width
        day = F.translate(F.regexp_extract(raw, _ISO_DATE_PART, 1), "/ \\", "---")
        return F.when(raw.rlike(_ISO_LIKE), F.try_to_date(day, "y-M-d"))
    return None  # numbers: a cast to DATE is not a parse, go through text


def parse_date(c: Source, dtype: DataType | None = None) -> Column:
    """Parse a raw column into DATE; ``dtype`` is the column's Spark type.

    The ``YYYY-MM-DD`` branch of the rule list is folded into the native
    branch, which accepts every such string with the same result.
    """
    raw = col_of(c)
    txt = clean_text(c)
    part = lambda start, length: F.substring(txt, start, length)
    gate = part(1, 4).between(*_YEAR_GATE)
    size = F.length(txt)
    # The text spellings exclude each other and the native one, so a value
    # meets the pattern of its own length only.
    eight = F.coalesce(F.when(gate, _from_parts(part(1, 4), part(5, 2), part(7, 2))),
                       _from_parts(part(5, 4), part(3, 2), part(1, 2)))
    out = (F.when((size == 8) & txt.rlike(r"^\d{8}\z"), eight)
           .when((size == 10) & txt.rlike(r"^\d{2}([-/])\d{2}\1\d{4}\z"), _from_parts(part(7, 4), part(4, 2), part(1, 2)))
           .when((size == 4) & txt.rlike(r"^\d{4}\z"), F.when(gate, _from_parts(part(1, 4), F.lit("1"), F.lit("1"))))
           .when((size == 6) & txt.rlike(r"^\d{6}\z"), F.when(gate, _from_parts(part(1, 4), part(5, 2), F.lit("1")))))
    native = _native(raw, dtype, txt)
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return native
    return out if native is None else out.otherwise(native)
