from cohortloom.functions.classify import (
    bucket_collapse,
    bucket_unknown,
    day_bins,
    freetext_columns,
    freetext_yes_no,
    multi_select_columns,
    multi_select_flags,
    numeric_bands,
    one_hot_columns,
    one_hot_flags,
    screen_flag,
    tiered_risk,
    yes_no_columns,
    yes_no_missing,
)
from cohortloom.functions.scalars import (
    answered,
    coalesce_levels,
    contains0,
    days_between,
    flag,
    isin0,
    months30,
    recode_value,
    relabel,
    rowwise_extremes,
)

__all__ = [
    "answered", "bucket_collapse", "bucket_unknown", "coalesce_levels", "contains0", "day_bins",
    "days_between", "flag", "freetext_columns", "freetext_yes_no", "isin0", "months30",
    "multi_select_columns", "multi_select_flags", "numeric_bands", "one_hot_columns", "one_hot_flags",
    "recode_value", "relabel", "rowwise_extremes", "screen_flag", "tiered_risk", "yes_no_columns",
    "yes_no_missing",
]
