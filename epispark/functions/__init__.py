"""Column expressions for the recodes (all built-in Spark functions, no UDFs)."""

from .ages import age_coded, age_direct, age_with_unit, build_age
from .codes import code_group, code_origin, code_type, extract_code, extract_code_multi
from .dates import parse_date
from .periods import band_label, band_start, month_of, percent, period_start, round_half_away, round_half_even, year_of
from .sex import recode_sex
from .text import clean_text, normalize_name, safe_alias

__all__ = [
    "age_coded", "age_direct", "age_with_unit", "build_age", "code_group", "code_origin", "code_type",
    "extract_code", "extract_code_multi", "parse_date", "band_label", "band_start", "month_of", "percent",
    "period_start", "round_half_away", "round_half_even", "year_of", "recode_sex", "clean_text",
    "normalize_name", "safe_alias",
]
