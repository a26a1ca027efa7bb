"""Report jobs over the cohorts. Each returns one frame from one job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom import params as P
from cohortloom.functions import multi_select_flags, relabel
from cohortloom.operators import (
    call_text_join,
    chi_square,
    crosstab,
    dim_join_exclude,
    fisher_exact,
    freq_multi,
    latest_per_group,
    local_trend,
    multi_flag_means,
    note_detail_join,
    nps_flags,
    pct_change_points,
    rename_labels,
    trajectory_multi,
    trajectory_score,
    weekly_mean,
)
from cohortloom.plans.cohorts import HELP_FLAGS
from cohortloom.sources import time_window, type_filter

GROUPS = ["gender", "age_group", "race_group", "ethnicity_group"]
REQUEST_COLUMNS = [
    "month_created", "connected_to_client", "screened", "screen_risk", "origin", "status_change_reason",
    "n_notes", *GROUPS, "assigned_sex_at_birth", "service_status", "homeless",
    "int_ckl_domestic_violence", "int_ckl_employment_status", "int_ckl_health_insurance",
    "int_ckl_chronic_pain", "int_ckl_physical_heath_issues", "int_ckl_physical_health_treatment",
    "int_ckl_mental_health_issues", "int_ckl_mental_health_treatment", "int_ckl_substance_abuse",
    "int_ckl_peer_support", "int_ckl_receiving_care_at_vha", "utm_campaign", "utm_content", "utm_term",
]
TREATMENT_FLAGS = ["crp_or_contingency", "crp", "contingency_plan", "cams_bcbt", "cams", "bcbt"]
TREATED_COLUMNS = [
    *GROUPS, "service_active", "service_reserve_guard", "service_retired", "service_discharged",
    "service_missing", "healthinsurance_no", "employment_disabled", "employment_looking", "homeless_yes",
    "dv_yes", "chronicpain_yes", "physicalissues_yes", "physicaltx_yes", "mentalissues_yes",
    "mentaltx_yes", "substanceabuse_yes", "vhacare_yes", "peersupport_yes",
]


def characteristics_report(cohort: DataFrame, cols: Iterable[str] = tuple(REQUEST_COLUMNS)) -> DataFrame:
    """Frequency tables of all characteristics of a request or established-client cohort."""
    return freq_multi(cohort, cols)


def request_case_report(per_case: DataFrame) -> DataFrame:
    """Frequency tables of closing reason, origin, contacts and connections over cases."""
    return freq_multi(per_case, ["status_change_reason", "origin", "n_notes", "connected_to_client", "call_center_connection", "scheduler_connection"])


def request_note_report(notes: DataFrame) -> DataFrame:
    """Frequency tables of the contacts of requested cases."""
    return freq_multi(notes, ["call_center_type", "connection_outcome", "case_note_type", "session_type"])


def connected_by_month(requests: DataFrame, months: Iterable[int]) -> DataFrame:
    """Connection frequencies of the cases created in the given calendar months."""
    return freq_multi(requests.filter(F.col("month_created").isin(list(months))), ["connected_to_client"])


def help_topic_shares(cohort: DataFrame) -> DataFrame:
    """Share of people who asked for each topic, and the mean number of topics."""
    return multi_flag_means(cohort, [*HELP_FLAGS, "help_number"], na="propagate")


def closure_reasons(
    cases: DataFrame, stratifier: str = "initial_risk", treated_only: bool = False, closed: str = "Closed"
) -> DataFrame:
    """Closing reasons of closed cases per risk level: counts and shares, a missing condition kept as missing.

    A case whose risk is unknown makes the condition of every level unknown
    unless it is certainly not closed (or not treated), so it is counted under
    each level, without a reason.
    """
    cond = F.col("status") == closed
    if treated_only:
        cond = cond & (F.col("cams_bcbt") == 1)
    levels = F.array(*[F.lit(v) for v in P.RISK_LABELS.values()])
    per_level = cases.withColumn("_cond", cond).filter(F.col("_cond") | F.col("_cond").isNull())
    unknown = F.col(stratifier).isNull() | F.col("_cond").isNull()
    per_level = per_level.withColumn(
        "level", F.explode(F.when(F.col(stratifier).isNull(), levels).otherwise(F.array(stratifier)))
    ).withColumn("reason", F.when(~unknown, F.col("status_change_reason")))
    counts = per_level.groupBy("level", "reason").agg(F.count(F.lit(1)).alias("n"))
    in_level = Window.partitionBy("level")  # over collapsed counts
    valid = F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))).over(in_level)
    return counts.select(
        "level", "reason", "n",
        F.when(F.col("reason").isNotNull(), F.try_divide(F.col("n") * 100.0, valid)).alias("pct_valid"),
        (F.col("n") * 100.0 / F.sum("n").over(in_level)).alias("pct_total"),
    )


def _long(df: DataFrame, ids: list[str], cols: list[str], name: str) -> DataFrame:
    plain = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    return plain.unpivot(ids, cols, name, "level")


def treatment_rates(
    people: DataFrame, stratifier: str = "initial_risk", flags: Iterable[str] = tuple(TREATMENT_FLAGS)
) -> DataFrame:
    """Cross-tabs of risk by every plan and treatment flag in one job."""
    return crosstab(_long(people, [stratifier], list(flags), "flag"), stratifier, "level", by=["flag"])


def equity_tests(people: DataFrame, treated: str = "cams_bcbt", groups: Iterable[str] = tuple(GROUPS)) -> DataFrame:
    """Chi-square and exact tests of treatment by every grouping, with and without the unknown level."""
    long = _long(people, [treated], list(groups), "attribute")
    both = long.withColumn(
        "levels", F.explode(F.when(F.col("level") == P.UNKNOWN, F.array(F.lit("all"))).otherwise(
            F.array(F.lit("all"), F.lit("known"))))
    )
    keys = ["attribute", "levels"]
    exact = fisher_exact(both, "level", treated, by=keys).withColumnsRenamed({"p": "p_exact"}).drop("n")
    return chi_square(both, "level", treated, by=keys).join(exact, keys, "left")


def treated_characteristics(people: DataFrame, treated: str = "cams_bcbt") -> DataFrame:
    """Characteristics among all, treated and untreated people: counts and shares."""
    long = _long(people, [treated], TREATED_COLUMNS, "variable")
    counts = long.groupBy("variable", treated, "level").agg(F.count(F.lit(1)).alias("n"))
    grouped = counts.groupingSets(
        [[F.col("variable"), F.col("level")], [F.col("variable"), F.col(treated), F.col("level")]],
        "variable", treated, "level",
    ).agg(F.sum("n").alias("n"), F.grouping(treated).alias("_all"))
    cohort = F.when(F.col("_all") == 1, "all").when(F.col(treated) == 1, "treated").otherwise("untreated")
    grouped = grouped.withColumn("cohort", cohort)
    valid = F.sum(F.when(F.col("level").isNotNull(), F.col("n"))).over(Window.partitionBy("variable", "cohort"))
    return grouped.select(
        "variable", "cohort", "level", "n",
        F.when(F.col("level").isNotNull(), F.col("n") * 100.0 / valid).alias("pct_valid"),
    )


def with_owner(people: DataFrame, owners: DataFrame, excluded: str) -> DataFrame:
    """People with their case owner's name; one owner's cases drop out."""
    owners = owners.withColumnsRenamed({"id": "owner_id", "name": "owner_name", "username": "owner_username"})
    return dim_join_exclude(people, owners, "owner_id", "owner_name", excluded)


def no_risk_cases(owned: DataFrame) -> DataFrame:
    """Cases without any risk level, for follow-up by their owner."""
    return owned.filter(F.col("initial_risk").isNull()).select("case_number", "owner_name")


def session_trajectories(forms: DataFrame) -> DataFrame:
    """Session ratings over time of cases with a baseline session."""
    return trajectory_multi(
        forms, "care_plan", "created_date", list(P.SESSION_RATINGS), P.FORM_SESSIONS,
        [P.FORM_SESSION_BASELINE], pct=["cams_rate_overall_suicide_risk"],
    )


def wellbeing_trajectories(forms: DataFrame) -> DataFrame:
    """Well-being sum scores over time of cases with a baseline questionnaire."""
    return trajectory_score(
        forms, "care_plan", "created_date", list(P.WELLBEING_ITEMS), [P.FORM_BASELINE, P.FORM_FOLLOWUP],
        [P.FORM_BASELINE],
    )


def cognition_trajectories(forms: DataFrame) -> DataFrame:
    """Suicide-cognition sum scores over time of cases with a baseline form."""
    return trajectory_score(
        forms, "care_plan", "created_date", list(P.COGNITION_ITEMS),
        [P.FORM_BASELINE, P.FORM_FOLLOWUP, P.FORM_COGNITION, P.FORM_INTAKE_LITE],
        [P.FORM_BASELINE, P.FORM_INTAKE_LITE],
    )


def trend_report(
    rows: DataFrame, week: str, measures: Iterable[str], targets: Iterable[float] = (4, 8), scale: float | None = None
) -> DataFrame:
    """Per measure: smoothed value at the start and at the target weeks, with the change in percent."""
    curve = local_trend(_measures(rows, week, measures), week, "value", by=["measure"])
    return pct_change_points(curve, week, "value", 0, list(targets), by=["measure"], scale=scale)


def weekly_report(rows: DataFrame, week: str, measures: Iterable[str]) -> DataFrame:
    """Mean of each measure by week, with the number of rows."""
    return weekly_mean(rows, week, measures)


def _measures(rows: DataFrame, week: str, measures: Iterable[str]) -> DataFrame:
    measures = list(measures)
    plain = rows.select(week, *[F.col(m).cast("double").alias(m) for m in measures])
    return plain.unpivot([week], measures, "measure", "value")


def talked_before(forms: DataFrame) -> DataFrame:
    """Baseline questionnaires with a flag for each kind of person talked to before."""
    base = forms.filter(F.col("name") == P.FORM_BASELINE).withColumnsRenamed(
        {"care_plan": "case_id", "created_date": "form_date", "name": "form_name"}
    )
    out = multi_select_flags(
        base, "coq_b_talked_about_suicide_who", {t: f"talked_{n}" for n, t in P.TALKED_TO.items()}
    )
    return out.select(
        "case_id", "form_date", "form_name", "coq_b_talked_about_suicide", "coq_b_talked_about_suicide_who",
        *[f"talked_{n}" for n in P.TALKED_TO], "coq_b_talked_about_suicide_other",
        "coq_fleeting_thoughts", "coq_current_thoughts",
    )


def never_talked(talked: DataFrame, people: DataFrame) -> DataFrame:
    """Frequencies of risk and closing reason among those who had never talked about it."""
    never = talked.filter(F.col("coq_b_talked_about_suicide") == "No").select("case_id", "form_date")
    joined = never.join(people.select("case_id", "initial_risk2", "status_change_reason"), "case_id", "left")
    return freq_multi(joined, ["initial_risk2", "status_change_reason"])


def feedback_scores(forms: DataFrame, **options) -> DataFrame:
    """Answers of all feedback surveys; promoters and detractors by each case's latest survey."""
    surveys = type_filter(forms, "name", [P.FORM_FEEDBACK])
    latest = latest_per_group(surveys, ["care_plan"], "created_date", "id")
    flags = freq_multi(nps_flags(latest, "fss_nps_question", **options), ["promoter", "detractor"])
    return freq_multi(surveys, ["fss_nps_question"]).unionByName(flags)


STORY_LABELS = {
    "consent_to_share": "Consent to share stories",
    "fss_nps_question": "NPS rating",
    "coq_f_prevent_attempt": "Did we prevent an attempt?",
    "coq_f_prevent_attempt_details": "Prevented attempt - details",
    "fss_share_with_others_txt": "What would you share with others?",
    "fss_learned_from_txt": "What did you learn from us that you plan to use day-to-day?",
    "fss_improvement_txt": "What could we have done differently?",
}


def stories(forms: DataFrame) -> DataFrame:
    """Free-text feedback with consent and promoter flags under display names."""
    rows = type_filter(forms, "name", [P.FORM_FEEDBACK, P.FORM_FOLLOWUP])
    consent = (F.col("coq_f_consent_for_attempt_details") == "Yes") | (F.col("fss_consent_to_share") == "Yes")
    rows = nps_flags(rows.withColumn("consent_to_share", F.when(consent, "Yes").otherwise("No")), "fss_nps_question")
    picked = rows.select(
        "consent_to_share", "fss_nps_question", "promoter", "detractor", "coq_f_prevent_attempt",
        "coq_f_prevent_attempt_details", "fss_share_with_others_txt", "fss_learned_from_txt", "fss_improvement_txt",
    )
    return rename_labels(picked, STORY_LABELS)


RISK_NOTE_COLUMNS = [
    "case_number", "case_id", "account_id", "call_id_1", "call_id_2", "call_id_3", "note_risk_level",
    "acute_risk_level", "chronic_risk_level", "risk_level_change_reason", "history_of_chronic_ideation",
    "history_of_self_directed_violence", "history_of_attempts", "chronic_major_mental_diagnosis",
    "chronic_major_personality_diagnosis", "history_of_substance_misuse_abuse",
    "chronic_major_medical_diagnosis", "chronic_pain", "limited_coping_skills_chronic",
    "unstable_psychosocial_status", "limited_reasons_for_living", "history_of_risky_actions",
    "history_of_impulsivity", "current_suicidal_ideation_even_passive", "inability_to_stay_safe",
    "intent_or_wish_to_die", "set_method_of_choice_or_plan", "recent_attempt", "more_than_one_attempt",
    "ongoing_preparatory_behavior", "will_not_use_crp", "limited_coping_skills_acute", "access_to_means",
    "acute_major_illness", "intensified_personality_disorder", "acute_psychosocial_stressors",
]


def risk_notes(cases: DataFrame, notes: DataFrame, p: P.CohortParams) -> DataFrame:
    """Notes with a risk level of the treatment cohort, with their risk factors and call ids."""
    notes = type_filter(time_window(notes, "interaction_date_time", p.start, p.end), "case_note_type", p.note_types)
    notes = notes.withColumn("note_risk_level", relabel(F.col("overall_risk_level"), P.RISK_LABELS))
    notes = notes.withColumnsRenamed(
        {
            "case": "case_id", "lookup_primary_phone_call": "call_id_1",
            "lookup_secondary_phone_call": "call_id_2", "lookup_tertiary_phone_call": "call_id_3",
        }
    )
    cohort = cases.select("case_number", "case_id", "account_id")
    return note_detail_join(cohort, notes, "case_id", RISK_NOTE_COLUMNS, "note_risk_level")


def risk_note_transcripts(notes: DataFrame, calls: DataFrame) -> DataFrame:
    """Risk notes with the transcript of their primary call."""
    return call_text_join(notes, calls, "call_id_1")
