"""Whole report jobs on the CRM-shaped views, each with SQL written out independently of the library.

Form reports take only forms of the treatment cohort and the window (``plans.cohort_forms``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortloom import params as P
from cohortloom import plans
from cohortloom.plans import reports
from cohortloom.plans.indicators import scored_people
from cohortloom.sources import survey_scan, time_window, write_csv
from workload.cohorts import (
    ASSEMBLY, CARE, HIGH, INTENDED, LEVELS, MODERATE, REQUEST_CTES, REQUEST_NAMES, REQUESTS, SCORE_NAMES, SCORING_CTES, SINGLE, TRAITS,
    TREATMENT_CTES, requests, scoring, treatment, window,
)
from workload.groups import base, trajectory_sql
from workload.mapping import RISK_FACTORS, cte, view
from workload.registry import query, rounded, table
from workload.stats import PCT, freq_sql

AGE = f"""CASE WHEN try_cast(substr(health_cloud_ga_age, 1, 2) AS DOUBLE) BETWEEN 18 AND 34 THEN '18 to 34 Years'
  WHEN try_cast(substr(health_cloud_ga_age, 1, 2) AS DOUBLE) BETWEEN 35 AND 54 THEN '35 to 54 Years'
  WHEN try_cast(substr(health_cloud_ga_age, 1, 2) AS DOUBLE) BETWEEN 55 AND 74 THEN '55 to 74 Years'
  WHEN try_cast(substr(health_cloud_ga_age, 1, 2) AS DOUBLE) >= 75 THEN '75+ Years' ELSE '{P.UNKNOWN}' END"""

# --- people who asked for help ---------------------------------------------------------------

ASKED = REQUEST_CTES + f""", rq AS (SELECT *, origin_ AS origin_shown, CAST(month(case_created) AS INT) AS month_created, {AGE} AS age_group, {TRAITS}
    FROM picked WHERE rn = 1)"""
SHOWN = {c: {"origin": "origin_shown"}.get(c, c) for c in reports.REQUEST_COLUMNS}


@query("report_characteristics", ASKED + f" SELECT * FROM ({freq_sql('rq', SHOWN, True)})")
def _(s, d):
    return rounded(reports.characteristics_report(requests(s, d)), *PCT)


@query(
    "report_characteristics_established",
    ASKED + f""", es AS (SELECT * FROM rq WHERE intake_and_risk = 1 AND (status_change_reason IS NULL OR status_change_reason NOT IN
      ({", ".join("'" + r.replace("'", "''") + "'" for r in P.NOT_ESTABLISHED_REASONS)})))
    SELECT * FROM ({freq_sql('es', SHOWN, True)})""",
)
def _(s, d):
    return rounded(reports.characteristics_report(plans.cohort_established(requests(s, d))), *PCT)


@query(
    "report_connected_by_month",
    ASKED + f", dec AS (SELECT * FROM rq WHERE month_created IN (12, 1, 2)) SELECT * FROM ({freq_sql('dec', {'connected_to_client': 'connected_to_client'}, True)})",
)
def _(s, d):
    return rounded(reports.connected_by_month(requests(s, d), [12, 1, 2]), *PCT)


PER_CASE = ["account_id", "case_id", "origin", "status_change_reason", "n_notes", "connected_to_client", "call_center_connection",
            "scheduler_connection", "intake_and_risk", "initial_risk", "month_created"]
CASE_COLUMNS = ["status_change_reason", "origin", "n_notes", "connected_to_client", "call_center_connection", "scheduler_connection"]


def request_cases(s, d):
    return plans.request_cases(view(s, d, "cases"), view(s, d, "accounts"), view(s, d, "notes"), REQUESTS)


@query(
    "cohort_request_cases",
    REQUEST_CTES + """ SELECT account_id, case_id, origin_ AS origin, status_change_reason, n_notes, connected_to_client, call_center_connection,
      scheduler_connection, intake_and_risk, initial_risk, CAST(month(case_created) AS INT) AS month_created FROM joined""",
)
def _(s, d):
    return request_cases(s, d).select(*PER_CASE)


@query("cohort_request_people", REQUEST_CTES + " SELECT * FROM requests")
def _(s, d):
    return plans.request_people(request_cases(s, d)).select(*REQUEST_NAMES)


@query("report_request_cases", REQUEST_CTES + f" SELECT * FROM ({freq_sql('joined', {c: {'origin': 'origin_'}.get(c, c) for c in CASE_COLUMNS}, True)})")
def _(s, d):
    return rounded(reports.request_case_report(request_cases(s, d)), *PCT)


@query(
    "report_request_notes",
    REQUEST_CTES + f""", asked AS (SELECT * FROM nn WHERE "case" IN (SELECT case_id FROM base))
    SELECT * FROM ({freq_sql('asked', {c: c for c in ("call_center_type", "connection_outcome", "case_note_type", "session_type")}, True)})""",
)
def _(s, d):
    notes = plans.request_notes(view(s, d, "cases"), view(s, d, "accounts"), view(s, d, "notes"), REQUESTS)
    return rounded(reports.request_note_report(notes), *PCT)


# --- people in care ----------------------------------------------------------------------------

PEOPLE = TREATMENT_CTES + """, people AS (SELECT * FROM (SELECT t.*, k.owner_id, k.case_number, row_number() OVER (PARTITION BY t.account_id
    ORDER BY k.created_date DESC, t.case_id) AS rn FROM treatment t JOIN (SELECT id, created_date, owner_id, case_number FROM cases) k ON k.id = t.case_id)
    WHERE rn = 1)"""
YES = {
    "homeless_yes": "homeless", "dv_yes": "int_ckl_domestic_violence", "chronicpain_yes": "int_ckl_chronic_pain",
    "physicaltx_yes": "int_ckl_physical_health_treatment", "mentaltx_yes": "int_ckl_mental_health_treatment",
    "substanceabuse_yes": "int_ckl_substance_abuse", "vhacare_yes": "int_ckl_receiving_care_at_vha", "peersupport_yes": "int_ckl_peer_support",
}
TREATED = {
    "gender": "gender", "age_group": AGE, "race_group": "race_group", "ethnicity_group": "ethnicity_group",
    "service_active": "service_active", "service_reserve_guard": "service_reserve_guard",
    "service_retired": "CASE WHEN contains(service_status, 'Retired') THEN 1 ELSE 0 END",
    "service_discharged": "CASE WHEN service_status = 'Discharged (any status)' THEN 1 ELSE 0 END",
    "service_missing": "CASE WHEN service_status IS NULL THEN 1 ELSE 0 END",
    "healthinsurance_no": "CASE WHEN int_ckl_health_insurance = 'No' THEN 1 ELSE 0 END",
    "employment_disabled": "CASE WHEN contains(int_ckl_employment_status, 'Disabled') THEN 1 ELSE 0 END",
    "employment_looking": "CASE WHEN contains(int_ckl_employment_status, 'Looking for work') THEN 1 ELSE 0 END",
    "physicalissues_yes": "CASE WHEN int_ckl_physical_heath_issues IS NULL OR int_ckl_physical_heath_issues = '' OR upper(int_ckl_physical_heath_issues)"
    " LIKE '%NONE%' OR upper(int_ckl_physical_heath_issues) IN ('NO', 'NO MENTIONED') THEN 0 ELSE 1 END",
    "mentalissues_yes": "mentalissues_yes",
    **{name: f"CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END" for name, c in YES.items()},
}


@query(
    "report_treated_characteristics",
    PEOPLE + f""", wide AS (SELECT p.*, a.health_cloud_ga_age, a.service_status, a.homeless, a.int_ckl_domestic_violence, a.int_ckl_employment_status,
        a.int_ckl_health_insurance, c.* EXCLUDE (id, account_id, status, status_change_reason, owner_id, case_number)
      FROM people p JOIN accounts a ON a.id = p.account_id JOIN cases c ON c.id = p.case_id),
    l AS ({" UNION ALL ".join(f"SELECT '{n}' AS variable, cams_bcbt, CAST({e} AS VARCHAR) AS level FROM wide" for n, e in TREATED.items())}),
    g AS (SELECT variable, 'all' AS cohort, level, count(*) AS n FROM l GROUP BY ALL UNION ALL
      SELECT variable, CASE WHEN cams_bcbt = 1 THEN 'treated' ELSE 'untreated' END, level, count(*) FROM l GROUP BY ALL)
    SELECT *, round(CASE WHEN level IS NOT NULL THEN n * 100.0::DOUBLE / sum(n) FILTER (level IS NOT NULL) OVER (PARTITION BY variable, cohort) END, 6)
      AS pct_valid FROM g""",
)
def _(s, d):
    return rounded(reports.treated_characteristics(plans.people_view(treatment(s, d))), "pct_valid")


@query(
    "report_no_risk_cases",
    PEOPLE.replace("WITH ", "WITH " + cte("owners") + ",\n", 1)
    + " SELECT p.case_number, o.name AS owner_name FROM people p JOIN owners o ON o.id = p.owner_id WHERE o.name <> 'FRANCE' AND p.initial_risk IS NULL",
)
def _(s, d):
    return reports.no_risk_cases(reports.with_owner(plans.people_view(treatment(s, d)), view(s, d, "owners"), "FRANCE"))


# --- forms of the cohort -----------------------------------------------------------------------

SHEETS = PEOPLE.replace("WITH ", "WITH " + cte("sheets") + ",\n", 1) + f""",
    cf AS (SELECT * FROM sheets WHERE {window('created_date', CARE)} AND care_plan IN (SELECT case_id FROM treatment))"""


def cohort_sheets(s, d):
    return plans.cohort_forms(view(s, d, "sheets"), treatment(s, d), CARE)


def among(names) -> str:
    return "name IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def with_cohort(rows: str, extra: str) -> str:
    """``trajectory_sql`` after the cohort's tables, under the forms' own names."""
    text = trajectory_sql(rows, extra).replace("user_id", "care_plan").replace("AS event_id", "AS id").replace(", ts, name AS event_type", ", ts AS created_date, name")
    return SHEETS + "," + text.split("WITH", 1)[1]


PICKED = "care_plan AS k, created_date AS ts, id, name"
RATED = list(P.SESSION_RATINGS)
WORST = "cams_rate_overall_suicide_risk"


@query(
    "report_session_trajectories",
    with_cohort(
        f"SELECT {PICKED}, {', '.join(RATED)} FROM cf WHERE {among(P.FORM_SESSIONS)} AND care_plan IN (SELECT care_plan FROM cf WHERE {among([P.FORM_SESSION_BASELINE])})",
        ", ".join([*RATED, *[f"{c} - {base(c)} AS {c}_bdiff" for c in RATED]]) + f", round(({WORST} - {base(WORST)}) / nullif({base(WORST)}, 0)::DOUBLE, 6) AS {WORST}_pctdiff",
    ),
)
def _(s, d):
    return rounded(reports.session_trajectories(cohort_sheets(s, d)), f"{WORST}_pctdiff")


def scored(items, types, baselines) -> str:
    total = " + ".join(items)
    return with_cohort(
        f"SELECT {PICKED}, {total} AS score FROM cf WHERE {among(types)} AND {total} IS NOT NULL AND care_plan IN (SELECT care_plan FROM cf WHERE {among(baselines)})",
        f"score, {len(items)} AS n_answered, score - lag(score) OVER (PARTITION BY k ORDER BY ts, id) AS score_change, score - {base('score')} AS score_bdiff",
    )


@query("report_wellbeing_trajectories", scored(P.WELLBEING_ITEMS, [P.FORM_BASELINE, P.FORM_FOLLOWUP], [P.FORM_BASELINE]))
def _(s, d):
    return reports.wellbeing_trajectories(cohort_sheets(s, d))


@query(
    "report_cognition_trajectories",
    scored(P.COGNITION_ITEMS, [P.FORM_BASELINE, P.FORM_FOLLOWUP, P.FORM_COGNITION, P.FORM_INTAKE_LITE], [P.FORM_BASELINE, P.FORM_INTAKE_LITE]),
)
def _(s, d):
    return reports.cognition_trajectories(cohort_sheets(s, d))


@query(
    "report_never_talked",
    SHEETS + f""", never AS (SELECT p.initial_risk2, p.status_change_reason FROM cf LEFT JOIN people p ON p.case_id = cf.care_plan
      WHERE cf.name = '{P.FORM_BASELINE}' AND coq_b_talked_about_suicide = 'No')
    SELECT * FROM ({freq_sql('never', {'initial_risk2': 'initial_risk2', 'status_change_reason': 'status_change_reason'}, True)})""",
)
def _(s, d):
    talked = reports.talked_before(cohort_sheets(s, d))
    return rounded(reports.never_talked(talked, plans.people_view(treatment(s, d))), *PCT)


@query(
    "report_talked_before",
    SHEETS + f""" SELECT care_plan AS case_id, created_date AS form_date, name AS form_name, coq_b_talked_about_suicide, coq_b_talked_about_suicide_who,
      {', '.join(f"CASE WHEN contains(coalesce(coq_b_talked_about_suicide_who, ''), '{t.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END AS talked_{n}" for n, t in P.TALKED_TO.items())},
      coq_b_talked_about_suicide_other, coq_fleeting_thoughts, coq_current_thoughts FROM cf WHERE name = '{P.FORM_BASELINE}'""",
)
def _(s, d):
    return reports.talked_before(cohort_sheets(s, d))


TEXTS = ["coq_f_prevent_attempt", "coq_f_prevent_attempt_details", "fss_share_with_others_txt", "fss_learned_from_txt", "fss_improvement_txt"]


@query(
    "report_stories",
    SHEETS + f""" SELECT CASE WHEN coq_f_consent_for_attempt_details = 'Yes' OR fss_consent_to_share = 'Yes' THEN 'Yes' ELSE 'No' END AS consent,
      fss_nps_question AS rating, CASE WHEN fss_nps_question IN (9, 10) THEN 1 WHEN fss_nps_question IS NOT NULL THEN 0 END AS promoter,
      CASE WHEN fss_nps_question BETWEEN 1 AND 6 THEN 1 WHEN fss_nps_question IS NOT NULL THEN 0 END AS detractor, {', '.join(TEXTS)}
      FROM cf WHERE {among([P.FORM_FEEDBACK, P.FORM_FOLLOWUP])}""",
)
def _(s, d):
    labels = reports.STORY_LABELS
    back = {label: {"consent_to_share": "consent", "fss_nps_question": "rating"}.get(c, c) for c, label in labels.items()}
    return reports.stories(cohort_sheets(s, d)).withColumnsRenamed(back)


# --- risk notes and transcripts ----------------------------------------------------------------

RISK = PEOPLE.replace("WITH ", "WITH " + cte("risk_sheets") + ",\n" + cte("calls") + ",\n", 1) + f""",
    risky AS (SELECT k.case_number, t.case_id, t.account_id, lookup_primary_phone_call AS call_id_1, lookup_secondary_phone_call AS call_id_2,
        lookup_tertiary_phone_call AS call_id_3, {LEVELS.format(c='overall_risk_level')} AS note_risk_level, {', '.join(RISK_FACTORS)}
      FROM risk_sheets r JOIN treatment t ON r."case" = t.case_id JOIN (SELECT id, case_number FROM cases) k ON k.id = t.case_id
      WHERE {window('interaction_date_time', CARE)} AND case_note_type IN ({', '.join(repr(t) for t in CARE.note_types)})
        AND overall_risk_level IN ('HRC', 'MRC', 'LRC'))"""


@query("report_risk_notes", RISK + " SELECT * FROM risky")
def _(s, d):
    return reports.risk_notes(treatment(s, d), view(s, d, "risk_sheets"), CARE)


@query("report_risk_transcripts", RISK + " SELECT r.*, transcript FROM risky r JOIN calls ON calls.id = r.call_id_1")
def _(s, d):
    return reports.risk_note_transcripts(reports.risk_notes(treatment(s, d), view(s, d, "risk_sheets"), CARE), view(s, d, "calls"))


@query(
    "scored_people",
    SCORING_CTES + """ SELECT account_id, case_id, case_created_date FROM (SELECT *, min(case_created_date) OVER (PARTITION BY account_id) AS first_ FROM cohort)
      WHERE case_created_date = first_""",
)
def _(s, d):
    return scored_people(scoring(s, d)).select("account_id", "case_id", "case_created_date")


TIED = {n: SINGLE[n].split(" WHERE ", 1)[1].rsplit(" GROUP BY", 1)[0] for n in ("01", "02", "03", "04", "12")}
TIED |= {"05a": "recent_suicide_attempt = 'Yes' AND impact = 'Yes'", "05b": "recent_suicide_attempt = 'Yes' AND impact <> 'No'"}
TIES = "".join(
    f",\nk{n} AS (SELECT case_id FROM (SELECT case_id, rank() OVER (PARTITION BY case_id ORDER BY created_date) AS rk FROM frame WHERE {cond}) WHERE rk = 1)"
    for n, cond in TIED.items()
)
RAMPS = {n: SINGLE[n].split("SELECT case_id, last_at, ", 1)[1].rsplit(" FROM frame) WHERE v > 0", 1)[0].removesuffix(" AS v") for n in ("07", "08")}
TIES += "".join(
    f",\nk{n} AS (SELECT case_id FROM (SELECT case_id, rank() OVER (PARTITION BY case_id ORDER BY round(v, 12) DESC, created_date) AS rk FROM"
    f" (SELECT case_id, created_date, {v} AS v FROM frame) WHERE v > 0) WHERE rk = 1)"
    for n, v in RAMPS.items()
)
TIES += f""",
k09 AS (SELECT case_id FROM (SELECT case_id, rank() OVER (PARTITION BY case_id ORDER BY round(v, 12) DESC, note_created_date) AS rk FROM
  (SELECT case_id, note_created_date, CASE WHEN overall_risk_level = 'HRC' THEN {HIGH} WHEN overall_risk_level = 'MRC' THEN {MODERATE} END AS v FROM
    (SELECT c.case_id, n.note_created_date, n.overall_risk_level,
       date_diff('day', CAST(n.note_created_date AS DATE), CAST(c.last_connection_date_time AS DATE)) / 30.0::DOUBLE AS m
     FROM cohort c JOIN linked n USING (case_id))) WHERE v > 0) WHERE rk = 1)"""


@query(
    "indicator_assembly_ties",
    ASSEMBLY + TIES + f""" SELECT {', '.join(f't.{n}' for n in SCORE_NAMES)}, round(CASE WHEN i06 = 1 THEN 0.0 ELSE top END, 6) AS score FROM t
      {' '.join(f'LEFT JOIN k{n} ON k{n}.case_id = t.case_id' for n in [*TIED, *RAMPS, '09'])}""",
)
def _(s, d):
    forms = time_window(view(s, d, "forms"), "created_date", CARE.start, CARE.end)
    out = plans.indicator_assembly(scoring(s, d), forms, plans.connected_notes(view(s, d, "notes"), CARE), INTENDED, ties="keep")
    return rounded(out.select(*SCORE_NAMES, "score"), "i07", "i08", "i09", "score")


# --- CSV ------------------------------------------------------------------------------------------


@query(
    "survey_round_trip",
    """SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS question, CAST(count(*) AS DOUBLE) AS percentage, CAST(0.25 AS DOUBLE) AS se,
       CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(min(o_orderkey) AS DOUBLE) END AS ci_lower, CAST(max(o_orderkey) AS DOUBLE) AS ci_upper
       FROM orders GROUP BY year(o_orderdate), o_orderpriority""",
)
def _(s, d):
    o = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("Year"), F.col("o_orderpriority").alias("Question")).agg(
        F.count(F.lit(1)).cast("double").alias("Percentage"), F.lit(0.25).alias("SE"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.min("o_orderkey").cast("double")).alias("CI.lower"), F.max("o_orderkey").cast("double").alias("CI.upper"),
    )
    folder = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/survey-{uuid.uuid4().hex}"
    write_csv(o, path, null="")
    back = survey_scan(s, path)
    return back.toDF("year", "question", "percentage", "se", "ci_lower", "ci_upper")
