"""Period, band and rounding helpers (E13–E18, percent rounding)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRUNC = {"year": "year", "month": "month", "week": "week"}


def period_start(date: Column, freq: str) -> Column:
    """Start of the year / month / ISO (Monday) week as TIMESTAMP_NTZ.

    ``trunc`` works on DATE and needs no time zone; the cast gives a
    wall-clock midnight independent of the session zone.
    """
    if freq not in _TRUNC:
        raise ValueError(f"freq must be one of {sorted(_TRUNC)}: {freq!r}")
    return F.trunc(date, _TRUNC[freq]).cast("timestamp_ntz")


def year_of(date: Column) -> Column:
    return F.year(date).cast("long")


def month_of(date: Column) -> Column:
    return F.month(date).cast("long")


def band_start(age: Column, width: int = 5) -> Column:
    """``floor(age / width) * width`` as DOUBLE."""
    return (F.floor(age / F.lit(float(width))) * width).cast("double")


def band_label(start: Column, width: int = 5) -> Column:
    """``a–b`` label with an en dash, ``b = a + width - 1``."""
    a = start.cast("long")
    return F.concat(a.cast("string"), F.lit("–"), (a + (width - 1)).cast("string"))


def round_half_even(x: Column, digits: int = 2) -> Column:
    """``rint(x * 10^d) / 10^d`` — the rounding used for percentages."""
    scale = float(10 ** digits)
    return F.rint(x * scale) / scale


def round_half_away(x: Column, digits: int = 2) -> Column:
    """SQL ``ROUND(x, d)`` for doubles: scale, round half away from zero,
    unscale. ``F.round`` rounds the decimal text instead (1.005 -> 1.01)."""
    scale = float(10 ** digits)
    y = x * scale
    whole = F.when(y >= 0, F.floor(y)).otherwise(F.ceil(y)).cast("double")
    rounded = F.when(F.abs(y - whole) == 0.5, whole + F.signum(y)).otherwise(F.rint(y))
    return rounded / scale


def percent(part: Column, total: Column) -> Column:
    """``round(part / total * 100, 2)``; 0.0 when the total is 0 or NULL."""
    share = part.cast("double") / total.cast("double") * 100.0
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(round_half_even(share))
