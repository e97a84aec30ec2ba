"""epispark — surveillance-register analytics on Spark DataFrames.

Typical use::

    raw = read_base(spark, "s3://bucket/sinan/*.parquet")
    reg = open_register(raw, "SINAN")
    tables = one_pass_report(reg)            # every report table from one scan
"""

from .operators.codes import code_origin_counts, compare_types, top_codes, top_type, type_codes, type_distribution
from .operators.demography import age_distribution, age_pyramid
from .operators.quality import (
    dataset_metrics,
    enriched_rows,
    filter_options,
    missingness,
    top_category,
    year_bounds,
    year_bounds_values,
)
from .operators.series import compare_series, heatmap_pivot, index_base100, month_heatmap, time_series, time_series_by
from .operators.topk import top_values
from .plans.cube import digest
from .plans.onepass import comparison_from_reports, lattice_report, one_pass_report
from .plans.recode import DEFAULT_FILTERS, Filters, apply_filters, recode
from .plans.report import Register, comparison, open_register, standard_report
from .plans.roles import Roles, choose_candidate, choose_candidates, detect_roles, resolve_roles
from .profiles import CIHA, PROFILES, SIM, SINAN, SourceProfile
from .sources.consolidation import consolidate_files, open_cube, update_cube
from .sources.export import consolidate_by_year, export_csv, territory_cut
from .sources.parquet import preview_rows, read_base, schema_describe
from .sources.reference import code_rules, field_guide
from .streaming import read_series, start_time_series_stream

__all__ = [n for n in dir() if not n.startswith("_")]
