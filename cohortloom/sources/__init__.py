from cohortloom.sources.tables import (
    key_semi_join,
    null_or_ne,
    read_entity,
    scan_project,
    survey_scan,
    time_window,
    type_filter,
    write_csv,
)

__all__ = [
    "key_semi_join", "null_or_ne", "read_entity", "scan_project", "survey_scan",
    "time_window", "type_filter", "write_csv",
]
