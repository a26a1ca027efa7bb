from cohortloom.operators.groups import (
    attach_group,
    baseline_diff,
    composite_group_flag,
    first_per_group_priority,
    group_any_flag,
    group_cond_count,
    group_size,
    lag_days,
    lag_score,
    latest_per_group,
    max_value_min_date,
    min_date_ties,
    priority_sort,
    regroup_sizes,
    running_days,
    session_number,
    strict_group_max,
    trajectory_multi,
    trajectory_score,
)
from cohortloom.operators.joins import (
    call_text_join,
    dim_join_exclude,
    inner_join,
    left_join_fill,
    note_detail_join,
    null_safe_join,
)
from cohortloom.operators.rows import (
    conj_filter,
    derive_chain,
    drop_test_names,
    exclude_list,
    exclude_list_status,
    na_subset,
    project,
    rename_labels,
)
from cohortloom.operators.significance import chi_square, fisher_exact
from cohortloom.operators.stats import (
    completeness_score,
    count_table,
    crosstab,
    crosstab_subset,
    describe_numeric,
    distinct_keys,
    freq,
    freq_multi,
    multi_flag_means,
    na_subset_freq,
    nps_flags,
    nps_score,
    numeric_totals,
    profile_table,
)
from cohortloom.operators.spline import spline_trend
from cohortloom.operators.trend import local_trend, nearest_point, pct_change_points, weekly_mean

__all__ = [
    "attach_group", "baseline_diff", "call_text_join", "chi_square", "completeness_score",
    "composite_group_flag", "conj_filter", "count_table", "crosstab", "crosstab_subset",
    "derive_chain", "describe_numeric", "dim_join_exclude", "distinct_keys", "drop_test_names",
    "exclude_list", "exclude_list_status", "first_per_group_priority", "fisher_exact", "freq",
    "freq_multi", "group_any_flag", "group_cond_count", "group_size", "inner_join", "lag_days",
    "lag_score", "latest_per_group", "left_join_fill", "local_trend", "max_value_min_date",
    "min_date_ties", "multi_flag_means", "na_subset", "na_subset_freq", "nearest_point",
    "note_detail_join", "nps_flags", "nps_score", "null_safe_join", "numeric_totals",
    "pct_change_points", "priority_sort", "profile_table", "project", "regroup_sizes",
    "rename_labels", "running_days", "session_number", "spline_trend", "strict_group_max", "trajectory_multi",
    "trajectory_score", "weekly_mean",
]
