"""Cohort jobs: help requests, established clients, treatment cases.

Case notes and forms, the large tables, are reduced to one row per case by a
single map-side-combined aggregate before they meet anything else.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import params as P
from cohortloom.functions import (
    answered,
    bucket_collapse,
    bucket_unknown,
    coalesce_levels,
    contains0,
    flag,
    freetext_columns,
    isin0,
    multi_select_columns,
    numeric_bands,
    one_hot_columns,
    recode_value,
    relabel,
    screen_flag,
    tiered_risk,
    yes_no_columns,
)
from cohortloom.functions.scalars import position
from cohortloom.operators import (
    composite_group_flag,
    conj_filter,
    drop_test_names,
    exclude_list,
    exclude_list_status,
    first_per_group_priority,
    inner_join,
    latest_per_group,
    left_join_fill,
)
from cohortloom.sources import key_semi_join, null_or_ne, time_window, type_filter


def characteristics(df: DataFrame) -> DataFrame:
    """Screening, demographic, service, employment, health and help-topic columns of a case-account row."""
    c = F.col
    wish, thoughts = c("wished_you_were_dead_past_month"), c("thoughts_of_killing_yourself_past_month")
    prepared = c("done_started_prepared_to_end_your_life")
    df = df.withColumns(
        {
            "screened": screen_flag([wish, thoughts, prepared]),
            "screen_risk": tiered_risk(
                all_no=[wish, thoughts, prepared],
                high=[
                    c("done_started_prepared_last_3_months"),
                    c("details_of_how_intend_to_carry_out"),
                    c("thoughts_intention_of_acting_on_them"),
                ],
                moderate=[prepared, c("thinking_about_how_you_might_do_this")],
                low=[wish, thoughts],
            ),
            "ethnicity_group": bucket_unknown(
                c("ethnicity"), refused=P.ETHNICITY_REFUSED, unknown=P.UNKNOWN
            ),
            "race_group": bucket_collapse(
                c("race"), P.RACE_MAP, "Other or Mixed Race", P.UNKNOWN, refused=["Prefer not to say"]
            ),
            "age_group": numeric_bands(c("health_cloud_ga_age"), P.AGE_BANDS, P.UNKNOWN),
            "gender": bucket_unknown(c("health_cloud_ga_gender"), known=P.GENDERS, unknown=P.UNKNOWN),
        }
    )
    hot = {
        "screen_risk": {0: "risk_min", 1: "risk_low", 2: "risk_mod", 3: "risk_high"},
        "ethnicity_group": {
            "Hispanic or Latino": "ethnicity_hl", "Not Hispanic or Latino": "ethnicity_not_hl",
            P.UNKNOWN: "ethnicity_missing",
        },
        "race_group": {
            "Black or African American": "race_black", "White or Caucasian": "race_white",
            "Other or Mixed Race": "race_other_mixed", P.UNKNOWN: "race_missing",
        },
        "age_group": {
            "18 to 34 Years": "age_18_34", "35 to 54 Years": "age_35_54", "55 to 74 Years": "age_55_74",
            "75+ Years": "age_75_plus", P.UNKNOWN: "age_missing",
        },
        "gender": {
            "Man": "gender_man", "Woman": "gender_woman", "Other": "gender_other", P.UNKNOWN: "gender_missing",
        },
    }
    service, help_wanted = c("service_status"), c("what_can_help_you_with")
    ever, now = c("any_thoughts_of_killing_yourself"), c("thoughts_of_killing_yourself_right_now")
    flags = {
        **freetext_columns(c("int_ckl_physical_heath_issues"), "physicalissues_"),
        **freetext_columns(c("int_ckl_mental_health_issues"), "mentalissues_"),
        "service_active": flag(service == "Active Duty"),
        "service_reserve_guard": flag(contains0(service, "Reserve") | contains0(service, "National Guard")),
        "service_retired": flag(contains0(service, "Retired")),
        "service_discharged": flag(
            service.isin("Discharged (any status)", "Active Duty;Discharged (any status)")
        ),
        "service_missing": flag(service.isNull()),
        **multi_select_columns(
            c("int_ckl_employment_status"), {token: f"employment_{n}" for n, token in P.EMPLOYMENT.items()},
            missing="employment_missing",
        ),
        **multi_select_columns(
            help_wanted, {token: f"help_{n}" for n, token in P.HELP_TOPICS.items()}, missing="help_missing"
        ),
        **yes_no_columns(ever, "anythoughts_"),
        **yes_no_columns(now, "currentthoughts_", implied_no=ever),
    }
    for col, names in hot.items():
        flags.update(one_hot_columns(c(col), names))
    for stem, col in P.YES_NO_COLUMNS.items():
        flags.update(yes_no_columns(c(col), f"{stem}_"))
    df = df.withColumns(flags)
    return df.withColumn("help_number", reduce(add, [c(f) for f in HELP_FLAGS]))


HELP_FLAGS = [f"help_{n}" for n in P.HELP_TOPICS]


def any_risk(level: Column) -> Column:
    """1 if the note carries a risk level, else 0."""
    return flag(isin0(level, P.RISK_LABELS))


def _notes_per_case(notes: DataFrame, p: P.CohortParams) -> DataFrame:
    """Contact flags and the first note (with a risk level if any) of each case."""
    c = F.col
    connected = c("connection_outcome") == p.connected
    staff = (c("case_note_type") != "Call Center") & (c("case_note_type") != "Supervisor") & connected
    notes = notes.withColumn("_any_risk", any_risk(c("overall_risk_level")))
    first = F.min_by(
        F.struct("overall_risk_level", "call_center_type", "case_note_type", "interaction_date_time"),
        position(notes, [("_any_risk", "desc"), "created_date", "id"]),
    )
    per_case = notes.groupBy(c("case").alias("case_id")).agg(
        F.count(F.lit(1)).alias("n_notes"),
        F.max(flag(staff)).alias("connected_to_client"),
        F.sum(flag(staff)).alias("n_connections"),
        F.max(flag((c("case_note_type") == "Call Center") & connected)).alias("call_center_connection"),
        F.max(flag((c("case_note_type") == "Scheduler") & connected)).alias("scheduler_connection"),
        F.max(flag((c("session_type") == "Intake") & connected)).alias("intake_session"),
        F.max(flag(c("overall_risk_level").isNotNull())).alias("risk_assigned"),
        first.alias("_first"),
    )
    per_case = composite_group_flag(
        per_case, "intake_and_risk",
        [
            (c("intake_session") == 1) & (c("risk_assigned") == 1),
            (c("connected_to_client") == 1) & (c("risk_assigned") == 1),
            (c("intake_session") == 1) & (c("n_connections") > 3),
        ],
    )
    return per_case.withColumns(
        {
            "initial_risk": relabel(c("_first.overall_risk_level"), P.RISK_LABELS),
            "call_center_type": c("_first.call_center_type"),
            "case_note_type": c("_first.case_note_type"),
            "interaction_date_time": c("_first.interaction_date_time"),
        }
    ).drop("_first")


def _account_side(accounts: DataFrame, p: P.CohortParams) -> DataFrame:
    """Real accounts; whether an account is a test is the same for all its cases."""
    accounts = accounts.withColumnsRenamed({"id": "account_id", "created_date": "account_created_date"})
    return drop_test_names(accounts, "name", p.test_tokens, "test_account")


def _requested(cases: DataFrame, p: P.CohortParams) -> DataFrame:
    """Cases of the window that ask for help for oneself and are not ruled out."""
    c = F.col
    cases = time_window(cases, "created_date", p.start, p.end).withColumnRenamed("id", "case_id")
    cases = conj_filter(cases, c("account_id").isNotNull(), c("i_am") == P.SELF_REQUEST)
    return exclude_list(cases, "status_change_reason", (*P.THIRD_PARTY_REASONS, *P.INELIGIBLE_REASONS))


def _contacts(notes: DataFrame, p: P.CohortParams) -> DataFrame:
    """Notes of the window that belong to a case and are no duplicate calls."""
    notes = time_window(notes, "interaction_date_time", p.start, p.end)
    return notes.filter(null_or_ne(F.col("call_center_type"), P.DUPLICATE_CALL) & F.col("case").isNotNull())


def _with_contacts(cases: DataFrame, notes: DataFrame, p: P.CohortParams) -> DataFrame:
    """Requested cases with their contact flags; cases without notes have none. One row per case on both sides."""
    fill = {"connected_to_client": 0, "call_center_connection": 0, "scheduler_connection": 0}
    return left_join_fill(_requested(cases, p), _notes_per_case(_contacts(notes, p), p), "case_id", fill)


def _derived(requests: DataFrame) -> DataFrame:
    c = F.col
    phone = c("origin") == "Phone"
    inbound = c("origin").isNull() & (c("call_center_type") == P.INBOUND_CALL)
    return requests.withColumns(
        {
            "origin": recode_value(c("origin"), [(phone | inbound, "Call Center")]),
            "month_created": F.month("created_date"),
        }
    )


def _one_per_person(requests: DataFrame) -> DataFrame:
    return first_per_group_priority(requests, ["account_id"], [("intake_and_risk", "desc"), "created_date", "case_id"])


def cohort_requests(cases: DataFrame, accounts: DataFrame, notes: DataFrame, p: P.CohortParams) -> DataFrame:
    """New help requests in the window, one row per person.

    The person's earliest case with intake and risk assigned is kept, or else
    the earliest case. Account rules hold for all of a person's cases or none,
    so the pick comes first and the account join meets one row per person.
    """
    picked = _one_per_person(_with_contacts(cases, notes, p))
    return characteristics(_derived(inner_join(picked, _account_side(accounts, p), "account_id")))


def request_cases(cases: DataFrame, accounts: DataFrame, notes: DataFrame, p: P.CohortParams) -> DataFrame:
    """New help requests in the window, one row per case, before one case per person is picked.

    Write it once: ``reports.request_case_report`` and ``request_people`` both read it.
    """
    return _derived(inner_join(_with_contacts(cases, notes, p), _account_side(accounts, p), "account_id"))


def request_people(per_case: DataFrame) -> DataFrame:
    """``cohort_requests`` from the written frame of ``request_cases``."""
    return characteristics(_one_per_person(per_case))


def request_notes(cases: DataFrame, accounts: DataFrame, notes: DataFrame, p: P.CohortParams) -> DataFrame:
    """Notes of the requested cases of real accounts."""
    kept = inner_join(_requested(cases, p), _account_side(accounts, p), "account_id")
    return key_semi_join(_contacts(notes, p), "case", kept, "case_id")


def cohort_established(requests: DataFrame, reasons=P.NOT_ESTABLISHED_REASONS) -> DataFrame:
    """Requests with intake and risk assigned whose closing reason is not excluded."""
    return exclude_list(requests.filter(F.col("intake_and_risk") == 1), "status_change_reason", reasons)


def _contingency_per_case(forms: DataFrame) -> DataFrame:
    """Latest enacted contingency plan of each case and their number."""
    plans = forms.filter((F.col("name") == P.FORM_CONTINGENCY) & F.col("cp_plan_enacted_date").isNotNull())
    return plans.groupBy(F.col("care_plan").alias("case_id")).agg(
        F.lit(1).alias("contingency_plan"),
        F.count(F.lit(1)).alias("n_contingency_plans"),
        F.min_by("cp_plan_enacted_date", position(plans, [("created_date", "desc"), "id"])).alias(
            "cp_plan_enacted_date"
        ),
    )


def cohort_forms(forms: DataFrame, cases: DataFrame, p: P.CohortParams) -> DataFrame:
    """Forms of the window that belong to a case of the cohort; what the form reports start from."""
    return key_semi_join(time_window(forms, "created_date", p.start, p.end), "care_plan", cases.select(F.col("case_id").alias("care_plan")))


def cohort_treatment(
    notes: DataFrame, cases: DataFrame, accounts: DataFrame, forms: DataFrame, p: P.CohortParams
) -> DataFrame:
    """Cases with a connected, first-party contact in the window, with treatment and plan flags."""
    c = F.col
    notes = type_filter(time_window(notes, "interaction_date_time", p.start, p.end), "case_note_type", p.note_types)
    connected = c("connection_outcome") == p.connected
    third = flag(c("interaction_with_whom") == p.third_party_contact)
    notes = notes.filter(c("case").isNotNull()).withColumns(
        {"_any_risk": any_risk(c("overall_risk_level")), "_direct": flag(connected & (third == 0))}
    )
    order = position(notes, [("_any_risk", "desc"), "created_date", "id"])
    per_case = (
        notes.groupBy(c("case").alias("case_id"))
        .agg(
            F.max(flag(connected & c("session_type").isin("CAMS", "BCBT-SP"))).alias("cams_bcbt"),
            F.max(flag(connected & (c("session_type") == "CAMS"))).alias("cams"),
            F.max(flag(connected & (c("session_type") == "BCBT-SP"))).alias("bcbt"),
            F.max("_direct").alias("_direct"),
            F.min_by(F.struct("overall_risk_level"), F.when(c("_direct") == 1, order)).alias("_first"),
        )
        .filter(c("_direct") == 1)
        .withColumn("note_risk", relabel(c("_first.overall_risk_level"), P.RISK_LABELS))
        .drop("_direct", "_first")
    )
    cases = cases.withColumnsRenamed({"id": "case_id", "created_date": "case_created_date"})
    cases = cases.filter(null_or_ne(c("i_am"), P.THIRD_PARTY_REQUEST) & c("account_id").isNotNull())
    cases = exclude_list_status(cases, "status_change_reason", p.treatment_excluded, "status", p.active_status)
    tx = inner_join(cases, per_case, "case_id")
    tx = inner_join(tx, _account_side(accounts, p), "account_id")
    parts = answered([c(x) for x in P.PLAN_PARTS])
    risk = relabel(c("most_recent_overall_risk_level"), P.RISK_LABELS)
    tx = tx.withColumns(
        {
            "crp_n": parts,
            "crp": flag(parts >= 4),
            "risk_level": risk,
            "initial_risk": coalesce_levels(c("note_risk"), risk),
        }
    )

    forms = time_window(forms, "created_date", p.start, p.end)
    tx = left_join_fill(
        tx, _contingency_per_case(forms), "case_id", {"contingency_plan": 0, "n_contingency_plans": 0},
    )
    tx = tx.withColumn("crp_or_contingency", flag((c("crp") == 1) | (c("contingency_plan") == 1)))
    tx = characteristics(tx)
    tx = tx.withColumns(
        {
            "legacy_initial_risk": _legacy(c("health_cloud_ga_last_active_case_ir")),
            "legacy_current_risk": _legacy(c("health_cloud_ga_lst_act_case_current_risk_lvll")),
        }
    )
    tx = tx.withColumn("legacy_risk", coalesce_levels(c("legacy_initial_risk"), c("legacy_current_risk")))
    return tx.withColumn("initial_risk2", coalesce_levels(c("initial_risk"), c("legacy_risk")))


def _legacy(c: Column) -> Column:
    """Risk label of the first level whose name occurs in the text."""
    out = None
    for token, label in P.RISK_LABELS.items():
        cond = contains0(c, token)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def people_view(cases: DataFrame, created: str = "case_created_date") -> DataFrame:
    """Latest case of each person."""
    return latest_per_group(cases, ["account_id"], created, "case_id")
