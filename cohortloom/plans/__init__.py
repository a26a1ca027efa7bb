from cohortloom.plans.cohorts import (
    characteristics,
    cohort_established,
    cohort_forms,
    cohort_requests,
    cohort_treatment,
    people_view,
    request_cases,
    request_notes,
    request_people,
)
from cohortloom.plans.indicators import (
    cohort_scoring,
    connected_notes,
    form_frame,
    indicator_01,
    indicator_02,
    indicator_03,
    indicator_04,
    indicator_05,
    indicator_06,
    indicator_07,
    indicator_08,
    indicator_09,
    indicator_11,
    indicator_12,
    indicator_assembly,
    note_frame,
    score_totals,
    scored_people,
)

__all__ = [
    "characteristics", "cohort_established", "cohort_forms", "cohort_requests", "cohort_scoring", "cohort_treatment",
    "connected_notes", "form_frame", "indicator_01", "indicator_02", "indicator_03", "indicator_04",
    "indicator_05", "indicator_06", "indicator_07", "indicator_08", "indicator_09", "indicator_11",
    "indicator_12", "indicator_assembly", "note_frame", "people_view", "request_cases", "request_notes",
    "request_people", "score_totals", "scored_people",
]
