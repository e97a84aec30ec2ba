"""Age recodes (E3–E6): coded ages, age + unit column, direct ages.

All three produce DOUBLE years and never raise: text is gated by a regex
before any cast.
"""

from __future__ import annotations

from types import MappingProxyType
from typing import Mapping, Optional

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import AGE_MODE_AUTO, AGE_MODE_CODED, AGE_MODE_DIRECT, AGE_MODE_UNIT, CODED_AGE_NAMES
from .text import Source, clean_text, comma_decimal, normalize_name

HOURS_PER_YEAR = 365.25 * 24
DAYS_PER_YEAR = 365.25
MONTHS_PER_YEAR = 12.0


def _scale(value: Column, unit: Column, hours: tuple, days: str, months: str, years: tuple,
           otherwise: Column | None) -> Column:
    expr = (F.when(unit.isin(*hours), value / F.lit(HOURS_PER_YEAR))
            .when(unit == days, value / F.lit(DAYS_PER_YEAR))
            .when(unit == months, value / F.lit(MONTHS_PER_YEAR))
            .when(unit.isin(*years), value))
    return expr.otherwise(otherwise) if otherwise is not None else expr


def age_coded(c: Source) -> Column:
    """Unit-coded age: 3–4 digits, first digit is the unit (0/1 hours,
    2 days, 3 months, 4/5 years); otherwise 1–3 digits 0–120 are years."""
    txt = clean_text(c)
    unit = F.substring(txt, 1, 1)
    rest = F.substring(txt, 2, 3).try_cast("double")
    plain = txt.try_cast("double")
    return (
        F.when(txt.rlike(r"^\d{3,4}\z") & unit.isin("0", "1", "2", "3", "4", "5"),
               _scale(rest, unit, ("0", "1"), "2", "3", ("4", "5"), None))
        .when(txt.rlike(r"^\d{1,3}\z") & plain.between(0, 120), plain)
    )


def age_with_unit(age: Source, unit: Source) -> Column:
    """Age number (decimal comma allowed) scaled by a separate unit column;
    an unknown or missing unit means years."""
    value = comma_decimal(clean_text(age))
    unit_txt = clean_text(unit)
    return F.when(value.isNotNull(), _scale(value, unit_txt, ("0", "1"), "2", "3", ("4", "5"), value))


def age_direct(c: Source) -> Column:
    """Age already in years, decimal comma allowed."""
    return comma_decimal(clean_text(c))


def build_age(col: Optional[str], mode: str, unit_col: Optional[str] = None,
              sources: Mapping[str, Source] = MappingProxyType({})) -> Optional[Column]:
    """Dispatch on the age mode (E6). Returns None without an age column.
    ``sources`` may give columns whose text is cleaned already."""
    if not col:
        return None
    age = sources.get(col, col)
    if unit_col and mode in (AGE_MODE_AUTO, AGE_MODE_UNIT):
        return age_with_unit(age, sources.get(unit_col, unit_col))
    if mode == AGE_MODE_DIRECT:
        return age_direct(age)
    if mode == AGE_MODE_CODED:
        return age_coded(age)
    if normalize_name(col) in CODED_AGE_NAMES:
        return F.coalesce(age_coded(age), age_direct(age))
    return age_direct(age)
