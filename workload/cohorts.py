"""Cohort and score jobs on the CRM-shaped views of the driver tables."""

from __future__ import annotations

from cohortloom import params as P
from cohortloom import plans
from cohortloom.plans import reports
from cohortloom.sources import time_window
from workload.mapping import view, with_ctes
from workload.registry import query, rounded

REQUESTS = P.CohortParams(start="1996-01-01", end="2000-01-01")
CARE = P.CohortParams(start="1997-01-01", end="2024-02-01")
INTENDED = P.IndicatorParams(storage_mode="intended")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def window(col: str, p: P.CohortParams) -> str:
    return f"{col} >= TIMESTAMP '{p.start}' AND {col} < TIMESTAMP '{p.end}'"


NO_TESTS = ("(a.name IS NULL OR NOT (contains(upper(a.name), 'TEST') OR contains(upper(a.name), 'RRBC'))) "
            "AND NOT a.test_account")
LEVELS = "CASE {c} WHEN 'HRC' THEN '1. HRC' WHEN 'MRC' THEN '2. MRC' WHEN 'LRC' THEN '3. LRC' END"

# Classification of a joined case (c) and account (a) row, written out independently of the library.
TRAITS = f"""
  CASE WHEN wished_you_were_dead_past_month IS NOT NULL AND thoughts_of_killing_yourself_past_month IS NOT NULL
    AND done_started_prepared_to_end_your_life IS NOT NULL THEN 1 ELSE 0 END AS screened,
  CASE WHEN wished_you_were_dead_past_month = 'No' AND thoughts_of_killing_yourself_past_month = 'No'
      AND done_started_prepared_to_end_your_life = 'No' THEN 0
    WHEN done_started_prepared_last_3_months = 'Yes' OR details_of_how_intend_to_carry_out = 'Yes'
      OR thoughts_intention_of_acting_on_them = 'Yes' THEN 3
    WHEN done_started_prepared_to_end_your_life = 'Yes' OR thinking_about_how_you_might_do_this = 'Yes' THEN 2
    WHEN wished_you_were_dead_past_month = 'Yes' OR thoughts_of_killing_yourself_past_month = 'Yes' THEN 1 END
    AS screen_risk,
  CASE WHEN ethnicity IS NULL OR ethnicity = 'Prefer Not to Say' OR ethnicity = 'Unknown' THEN '{P.UNKNOWN}'
    ELSE ethnicity END AS ethnicity_group,
  CASE WHEN race IN ('Black or African American', 'Black or African American;Nonwhite') THEN 'Black or African American'
    WHEN race = 'White' THEN 'White or Caucasian' WHEN race <> 'Prefer not to say' THEN 'Other or Mixed Race'
    ELSE '{P.UNKNOWN}' END AS race_group,
  CASE WHEN health_cloud_ga_gender IN ('Man', 'Woman', 'Other') THEN health_cloud_ga_gender ELSE '{P.UNKNOWN}' END AS gender,
  CASE WHEN service_status = 'Active Duty' THEN 1 ELSE 0 END AS service_active,
  CASE WHEN service_status LIKE '%Reserve%' OR service_status LIKE '%National Guard%' THEN 1 ELSE 0 END
    AS service_reserve_guard,
  CASE WHEN int_ckl_employment_status LIKE '%Other%' THEN 1 ELSE 0 END AS employment_other,
  CASE WHEN int_ckl_employment_status IS NULL THEN 1 ELSE 0 END AS employment_missing,
  CASE WHEN int_ckl_mental_health_issues IS NULL OR int_ckl_mental_health_issues = ''
    OR upper(int_ckl_mental_health_issues) LIKE '%NONE%' OR upper(int_ckl_mental_health_issues) IN ('NO', 'NO MENTIONED')
    THEN 0 ELSE 1 END AS mentalissues_yes,
  CASE WHEN homeless = 'No' THEN 1 ELSE 0 END AS homeless_no,
  CASE WHEN what_can_help_you_with LIKE '%Trauma%' THEN 1 ELSE 0 END AS help_trauma,
  CASE WHEN thoughts_of_killing_yourself_right_now = 'No' OR any_thoughts_of_killing_yourself = 'No' THEN 1 ELSE 0 END
    AS currentthoughts_no"""
TRAIT_NAMES = ["screened", "screen_risk", "ethnicity_group", "race_group", "gender", "service_active",
               "service_reserve_guard", "employment_other", "employment_missing", "mentalissues_yes", "homeless_no",
               "help_trauma", "currentthoughts_no"]

REQUEST_CTES = with_ctes("cases", "accounts", "notes") + f""",
base AS (
  SELECT c.id AS case_id, c.account_id, c.created_date AS case_created,
    CASE WHEN c.origin = 'Phone' THEN 'Call Center' ELSE c.origin END AS origin0, c.status_change_reason,
    c.*, a.* EXCLUDE (id, created_date)
  FROM cases c JOIN accounts a ON c.account_id = a.id
  WHERE {window('c.created_date', REQUESTS)} AND c.i_am = '{P.SELF_REQUEST}' AND {NO_TESTS}
    AND (c.status_change_reason IS NULL OR c.status_change_reason NOT IN
      ({quoted((*P.THIRD_PARTY_REASONS, *P.INELIGIBLE_REASONS))}))),
nn AS (
  SELECT *, connection_outcome = '{P.CONNECTED}' AS ok,
    CASE WHEN overall_risk_level IN ('HRC', 'MRC', 'LRC') THEN 1 ELSE 0 END AS rated
  FROM notes WHERE {window('interaction_date_time', REQUESTS)}
    AND (call_center_type IS NULL OR call_center_type <> '{P.DUPLICATE_CALL}')),
per_case AS (
  SELECT "case" AS case_id, count(*) AS n_notes,
    max(CASE WHEN case_note_type NOT IN ('Call Center', 'Supervisor') AND ok THEN 1 ELSE 0 END) AS connected,
    sum(CASE WHEN case_note_type NOT IN ('Call Center', 'Supervisor') AND ok THEN 1 ELSE 0 END) AS n_connected,
    max(CASE WHEN case_note_type = 'Call Center' AND ok THEN 1 ELSE 0 END) AS call_center,
    max(CASE WHEN case_note_type = 'Scheduler' AND ok THEN 1 ELSE 0 END) AS scheduler,
    max(CASE WHEN session_type = 'Intake' AND ok THEN 1 ELSE 0 END) AS intake,
    max(CASE WHEN overall_risk_level IS NOT NULL THEN 1 ELSE 0 END) AS risk
  FROM nn GROUP BY 1),
first_note AS (
  SELECT "case" AS case_id, overall_risk_level, call_center_type FROM
    (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY rated DESC, created_date NULLS LAST, id) AS rn FROM nn)
  WHERE rn = 1),
joined AS (
  SELECT b.*, n_notes, coalesce(connected, 0) AS connected_to_client,
    coalesce(call_center, 0) AS call_center_connection, coalesce(scheduler, 0) AS scheduler_connection,
    CASE WHEN intake = 1 AND risk = 1 THEN 1 WHEN connected = 1 AND risk = 1 THEN 1
      WHEN intake = 1 AND n_connected > 3 THEN 1 WHEN p.case_id IS NOT NULL THEN 0 END AS intake_and_risk,
    {LEVELS.format(c='f.overall_risk_level')} AS initial_risk,
    CASE WHEN origin0 IS NULL AND f.call_center_type = '{P.INBOUND_CALL}' THEN 'Call Center' ELSE origin0 END AS origin_
  FROM base b LEFT JOIN per_case p ON b.case_id = p.case_id LEFT JOIN first_note f ON b.case_id = f.case_id),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY intake_and_risk DESC NULLS LAST, case_created, case_id) AS rn
  FROM joined),
requests AS (
  SELECT account_id, case_id, origin_ AS origin, status_change_reason, n_notes, connected_to_client,
    call_center_connection, scheduler_connection, intake_and_risk, initial_risk,
    CAST(month(case_created) AS INT) AS month_created, {TRAITS}
  FROM picked WHERE rn = 1)"""
REQUEST_NAMES = ["account_id", "case_id", "origin", "status_change_reason", "n_notes", "connected_to_client",
                 "call_center_connection", "scheduler_connection", "intake_and_risk", "initial_risk",
                 "month_created", *TRAIT_NAMES]


def requests(s, d):
    return plans.cohort_requests(view(s, d, "cases"), view(s, d, "accounts"), view(s, d, "notes"), REQUESTS)


@query("cohort_requests", REQUEST_CTES + " SELECT * FROM requests")
def _(s, d):
    return requests(s, d).select(*REQUEST_NAMES)


@query(
    "cohort_established",
    REQUEST_CTES + f""" SELECT * FROM requests WHERE intake_and_risk = 1 AND (status_change_reason IS NULL
      OR status_change_reason NOT IN ({quoted(P.NOT_ESTABLISHED_REASONS)}))""",
)
def _(s, d):
    return plans.cohort_established(requests(s, d)).select(*REQUEST_NAMES)


CARE_NOTES = f"""
care_notes AS (
  SELECT *, connection_outcome = '{P.CONNECTED}' AS ok, coalesce(interaction_with_whom, '') = '{P.THIRD_PARTY_CONTACT}' AS third
  FROM notes WHERE {window('interaction_date_time', CARE)} AND case_note_type IN ({quoted(P.NOTE_TYPES)}))"""

TREATMENT_CTES = with_ctes("cases", "accounts", "notes", "forms") + f""",{CARE_NOTES},
flags AS (
  SELECT "case" AS case_id,
    max(CASE WHEN ok AND session_type IN ('CAMS', 'BCBT-SP') THEN 1 ELSE 0 END) AS cams_bcbt,
    max(CASE WHEN ok AND session_type = 'CAMS' THEN 1 ELSE 0 END) AS cams,
    max(CASE WHEN ok AND session_type = 'BCBT-SP' THEN 1 ELSE 0 END) AS bcbt FROM care_notes GROUP BY 1),
first_note AS (
  SELECT "case" AS case_id, {LEVELS.format(c='overall_risk_level')} AS note_risk FROM
    (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY CASE WHEN overall_risk_level IN ('HRC', 'MRC', 'LRC')
        THEN 0 ELSE 1 END, created_date NULLS LAST, id) AS rn FROM care_notes WHERE ok AND NOT third) WHERE rn = 1),
plan_forms AS (
  SELECT *, count(*) OVER (PARTITION BY care_plan) AS n,
    row_number() OVER (PARTITION BY care_plan ORDER BY created_date DESC, id) AS rn
  FROM forms WHERE name = '{P.FORM_CONTINGENCY}' AND cp_plan_enacted_date IS NOT NULL AND {window('created_date', CARE)}),
tx AS (
  SELECT c.id AS case_id, c.account_id, c.status, c.status_change_reason, f.cams_bcbt, f.cams, f.bcbt,
    {LEVELS.format(c='c.most_recent_overall_risk_level')} AS risk_level, note_risk,
    {' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE 1 END' for x in P.PLAN_PARTS)} AS crp_n,
    CASE WHEN p.care_plan IS NULL THEN 0 ELSE 1 END AS contingency_plan, coalesce(p.n, 0) AS n_contingency_plans,
    p.cp_plan_enacted_date,
    coalesce(CASE WHEN contains(health_cloud_ga_last_active_case_ir, 'HRC') THEN '1. HRC'
      WHEN contains(health_cloud_ga_last_active_case_ir, 'MRC') THEN '2. MRC' END,
      CASE WHEN contains(health_cloud_ga_lst_act_case_current_risk_lvll, 'LRC') THEN '3. LRC' END) AS legacy_risk,
    {TRAITS}
  FROM cases c JOIN first_note USING (case_id) JOIN flags f USING (case_id) JOIN accounts a ON c.account_id = a.id
    LEFT JOIN plan_forms p ON p.care_plan = c.id AND p.rn = 1
  WHERE (c.i_am IS NULL OR c.i_am <> '{P.THIRD_PARTY_REQUEST}') AND {NO_TESTS}
    AND ((c.status_change_reason IS NULL AND c.status = '{P.ACTIVE_STATUS}')
      OR c.status_change_reason NOT IN ({quoted(P.TREATMENT_EXCLUDED_REASONS)}))),
treatment AS (
  SELECT * EXCLUDE (note_risk), CASE WHEN crp_n >= 4 THEN 1 ELSE 0 END AS crp,
    CASE WHEN crp_n >= 4 OR contingency_plan = 1 THEN 1 ELSE 0 END AS crp_or_contingency,
    coalesce(note_risk, risk_level) AS initial_risk, coalesce(note_risk, risk_level, legacy_risk) AS initial_risk2 FROM tx)""".replace(
    "JOIN first_note USING (case_id) JOIN flags f USING (case_id)",
    "JOIN first_note n ON n.case_id = c.id JOIN flags f ON f.case_id = c.id",
)
TREATMENT_NAMES = ["case_id", "account_id", "status", "status_change_reason", "cams_bcbt", "cams", "bcbt", "risk_level",
                   "crp_n", "contingency_plan", "n_contingency_plans", "cp_plan_enacted_date", "legacy_risk",
                   *TRAIT_NAMES, "crp", "crp_or_contingency", "initial_risk", "initial_risk2"]


def treatment(s, d):
    return plans.cohort_treatment(
        view(s, d, "notes"), view(s, d, "cases"), view(s, d, "accounts"), view(s, d, "forms"), CARE
    )


@query("cohort_treatment", TREATMENT_CTES + " SELECT * FROM treatment")
def _(s, d):
    return treatment(s, d).select(*TREATMENT_NAMES)


# --- scoring ---------------------------------------------------------------------

SCORING_CTES = with_ctes("cases", "accounts", "notes", "forms") + f""",{CARE_NOTES},
linked AS (SELECT *, "case" AS case_id, created_date AS note_created_date FROM care_notes WHERE ok AND NOT third),
cohort AS (
  SELECT c.*, c.id AS case_id, c.created_date AS case_created_date, a.created_date AS account_created_date
  FROM cases c JOIN accounts a ON c.account_id = a.id
  WHERE c.id IN (SELECT case_id FROM linked) AND (c.i_am IS NULL OR c.i_am <> '{P.THIRD_PARTY_REQUEST}') AND {NO_TESTS}
    AND ((c.status_change_reason IS NULL AND c.status = '{P.ACTIVE_STATUS}')
      OR c.status_change_reason NOT IN ({quoted(P.SCORING_EXCLUDED_REASONS)}))),
in_window AS (SELECT * FROM forms WHERE {window('created_date', CARE)}),
frame AS (
  SELECT c.case_id, c.last_connection_date_time AS last_at, c.status_change_reason,
    CAST(c.last_connection_date_time AS DATE) >= f.crisis_date_crisis_occurred + 30 AS alive,
    date_diff('day', CAST(f.created_date AS DATE), CAST(c.last_connection_date_time AS DATE)) / 30.0::DOUBLE AS m,
    c.thoughts_intention_of_acting_on_them = 'Yes' OR c.details_of_how_intend_to_carry_out = 'Yes'
      OR c.done_started_prepared_last_3_months = 'Yes' AS high,
    c.wished_you_were_dead_past_month = 'Yes' OR c.thoughts_of_killing_yourself_past_month = 'Yes'
      OR c.done_started_prepared_to_end_your_life = 'Yes' AS moderate,
    f.* EXCLUDE (id), f.id AS form_id
  FROM cohort c LEFT JOIN in_window f ON f.care_plan = c.case_id)"""


def flagged(cond: str) -> str:
    return f"SELECT case_id, 1.0::DOUBLE AS value, min(created_date) AS date FROM frame WHERE {cond} GROUP BY 1"


def ramp_sql(full: float, slope: float, start: float, months: int) -> str:
    return f"CASE WHEN m >= {months} THEN {full}::DOUBLE WHEN m < {months} THEN {slope}::DOUBLE / {months} * m + {start} END"


def best(value: str, source: str = "frame") -> str:
    return f"""SELECT case_id, round(max(v), 6) AS value, max(last_at) AS date FROM
      (SELECT case_id, last_at, {value} AS v FROM {source}) WHERE v > 0 GROUP BY 1"""


HIGH, MODERATE = ramp_sql(0.16, 0.08, 0.08, 12), ramp_sql(0.04, 0.03, 0.01, 12)
HAS = "contains(coalesce(crisis_crisis_reasons, ''), '{}')"
SINGLE = {
    "01": flagged(f"{HAS.format('Lethal Means in Hand')} OR {HAS.format('Active Attempt')} OR "
                  f"({HAS.format('Suicidal Gestures')} AND alive)"),
    "02": flagged("crisis_suicide_timing IN ('within the next day', 'within 7 days', 'within 30 days') AND alive"),
    "03": flagged("aborted_suicide_prep = 'Yes' AND alive"),
    "04": flagged("interrupted_prep = 'Yes' AND stopper_details = 'Staff'"),
    "05": """SELECT case_id, max(CASE WHEN impact = 'Yes' THEN 1.0::DOUBLE END) AS value_a,
        min(CASE WHEN impact = 'Yes' THEN created_date END) AS date_a,
        max(CASE WHEN impact <> 'No' THEN 1.0::DOUBLE END) AS value_b,
        min(CASE WHEN impact <> 'No' THEN created_date END) AS date_b
        FROM frame WHERE recent_suicide_attempt = 'Yes' AND impact = 'Yes' GROUP BY 1""",
    "06": f"SELECT case_id, 1.0::DOUBLE AS value FROM cohort WHERE status_change_reason = '{P.DEATH_REASON}'",
    "07": best(f"CASE WHEN high THEN {HIGH} WHEN moderate THEN {MODERATE} END"),
    "08": best(f"CASE WHEN {' + '.join(P.COGNITION_ITEMS)} >= 13 THEN {ramp_sql(0.24, 0.20, 0.04, 6)} END"),
    "09": best(
        f"CASE WHEN overall_risk_level = 'HRC' THEN {HIGH} WHEN overall_risk_level = 'MRC' THEN {MODERATE} END",
        """(SELECT c.case_id, c.last_connection_date_time AS last_at, n.overall_risk_level,
              date_diff('day', CAST(n.note_created_date AS DATE), CAST(c.last_connection_date_time AS DATE))
                / 30.0::DOUBLE AS m FROM cohort c JOIN linked n USING (case_id))""",
    ),
    "11": f"""SELECT case_id, value, date FROM (SELECT case_id, created_date AS date, CASE
          WHEN gap >= 30 AND crp_safe_lockbox_usage = 'Yes' AND crp_firearms_loaded = 'No' THEN 0.82::DOUBLE
          WHEN gap >= 30 AND crp_firearms_loaded = 'No' THEN 0.77::DOUBLE
          WHEN gap >= 30 AND crp_safe_lockbox_usage = 'Yes' THEN 0.72::DOUBLE END AS value FROM
        (SELECT *, date_diff('day', CAST(max(CASE WHEN crp_firearms_access = 'Yes' AND crp_safe_lockbox_usage = 'No'
              AND crp_firearms_loaded = 'Yes' THEN created_date END) OVER (PARTITION BY case_id) AS DATE),
              CAST(created_date AS DATE)) AS gap,
            row_number() OVER (PARTITION BY case_id ORDER BY created_date DESC, form_id DESC) AS rn
         FROM frame WHERE name = '{P.FORM_RESPONSE_PLAN}') WHERE rn = 1) WHERE value > 0""",
    "12": flagged("coq_f_prevent_attempt = 'Yes'"),
}


def scoring(s, d):
    return plans.cohort_scoring(view(s, d, "notes"), view(s, d, "cases"), view(s, d, "accounts"), CARE)


def frame(s, d):
    return plans.form_frame(scoring(s, d), view(s, d, "forms"), CARE.start, CARE.end)


@query("cohort_scoring", SCORING_CTES + " SELECT case_id, account_id, case_created_date, status_change_reason FROM cohort")
def _(s, d):
    return scoring(s, d).select("case_id", "account_id", "case_created_date", "status_change_reason")


def register(number: str) -> None:
    rule = getattr(plans, f"indicator_{number}")

    def run(s, d):
        if number == "06":
            return rule(scoring(s, d), INTENDED)
        if number == "09":
            notes = plans.connected_notes(view(s, d, "notes"), CARE)
            return rounded(rule(plans.note_frame(scoring(s, d), notes), INTENDED), "value")
        out = rule(frame(s, d), INTENDED)
        return out if number == "05" else rounded(out, "value")

    query(f"indicator_{number}", f"{SCORING_CTES} {SINGLE[number]}")(run)


for _number in SINGLE:
    register(_number)


DATED = ["01", "02", "03", "04", "07", "08", "09", "11", "12"]
ASSEMBLY = (
    SCORING_CTES
    + "".join(f",\nx{n} AS ({SINGLE[n]})" for n in SINGLE)
    + f""",
j AS (SELECT c.account_id, c.case_id, x06.value AS i06, x05.value_a AS i05a, x05.date_a AS d05a, x05.value_b AS i05b,
    {', '.join(f'x{n}.value AS i{n}, x{n}.date AS d{n}' for n in DATED)}
  FROM cohort c {' '.join(f'LEFT JOIN x{n} ON x{n}.case_id = c.case_id' for n in SINGLE)}),
z AS (SELECT * REPLACE ({', '.join(f'CASE WHEN i05b = 1 THEN 0.0 ELSE i{n} END AS i{n}' for n in ('07', '08', '09', '11'))},
    {', '.join(f'CASE WHEN i05b = 1 THEN NULL ELSE d{n} END AS d{n}' for n in ('07', '08', '09', '11'))}) FROM j),
t AS (SELECT *, greatest(i01, i02, i03, i04, i05a, i06, i07, i08, i09, i11, i12) AS top,
    least(d01, d02, d03, d04, d05a, d07, d08, d09, d11, d12) AS first FROM z)
"""
)
SCORE_NAMES = ["case_id", "account_id", "i01", "i02", "i03", "i04", "i05a", "i05b", "i06", "i07", "i08", "i09", "i11",
               "i12"]


def assembled(s, d):
    forms = time_window(view(s, d, "forms"), "created_date", CARE.start, CARE.end)
    notes = plans.connected_notes(view(s, d, "notes"), CARE)
    return plans.indicator_assembly(scoring(s, d), forms, notes, INTENDED)


@query(
    "indicator_assembly",
    ASSEMBLY + f"""SELECT {', '.join(SCORE_NAMES)}, round(CASE WHEN i06 = 1 THEN 0.0 ELSE top END, 6) AS score,
      CASE WHEN top > 0 THEN first END AS score_date FROM t""",
)
def _(s, d):
    out = assembled(s, d).select(*SCORE_NAMES, "score", "score_date")
    return rounded(out, "i07", "i08", "i09", "score")


@query(
    "score_totals",
    ASSEMBLY + f"""SELECT {', '.join(f'round(sum({n}), 4) AS {n}' for n in SCORE_NAMES[2:])},
      round(sum(CASE WHEN i06 = 1 THEN 0.0 ELSE top END), 4) AS score FROM t""",
)
def _(s, d):
    totals = plans.score_totals(assembled(s, d))
    return rounded(totals, *totals.columns, places=4)


@query(
    "report_closure_reasons",
    TREATMENT_CTES + f""", lv AS (SELECT unnest(['1. HRC', '2. MRC', '3. LRC']) AS level),
    x AS (SELECT level, CASE WHEN c THEN status_change_reason END AS reason FROM
      (SELECT *, initial_risk = level AND status = 'Closed' AS c FROM treatment, lv) WHERE c OR c IS NULL),
    n AS (SELECT level, reason, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT level, reason, n, round(CASE WHEN reason IS NOT NULL THEN n * 100.0::DOUBLE / sum(n) FILTER (reason IS NOT NULL)
      OVER (PARTITION BY level) END, 6) AS pct_valid, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY level), 6) AS pct_total
    FROM n""",
)
def _(s, d):
    return rounded(reports.closure_reasons(treatment(s, d)), "pct_valid", "pct_total")


@query(
    "report_equity_tests",
    TREATMENT_CTES + f""", people AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t.account_id
        ORDER BY k.created_date DESC, t.case_id) AS rn FROM treatment t JOIN (SELECT id, created_date FROM cases) k
        ON k.id = t.case_id) WHERE rn = 1),
    l AS (SELECT 'gender' AS attribute, gender AS level, cams_bcbt AS k FROM people
      UNION ALL SELECT 'race_group', race_group, cams_bcbt FROM people
      UNION ALL SELECT 'ethnicity_group', ethnicity_group, cams_bcbt FROM people),
    b AS (SELECT attribute, 'all' AS levels, level, k FROM l UNION ALL SELECT attribute, 'known', level, k FROM l
      WHERE level <> '{P.UNKNOWN}'),
    c AS (SELECT attribute, levels, level, k, count(*) AS o FROM b GROUP BY ALL),
    r AS (SELECT attribute, levels, level, sum(o) AS n FROM c GROUP BY ALL),
    q AS (SELECT attribute, levels, k, sum(o) AS n FROM c GROUP BY ALL),
    t AS (SELECT attribute, levels, sum(o) AS n FROM c GROUP BY ALL),
    e AS (SELECT r.attribute, r.levels, t.n, coalesce(c.o, 0) AS o, r.n * q.n / t.n::DOUBLE AS e,
        (SELECT count(*) FROM r x WHERE x.attribute = r.attribute AND x.levels = r.levels) AS nr
      FROM r JOIN q USING (attribute, levels) JOIN t USING (attribute, levels)
      LEFT JOIN c ON c.attribute = r.attribute AND c.levels = r.levels AND c.level = r.level AND c.k = q.k),
    y AS (SELECT *, CASE WHEN nr = 2 THEN least(0.5, min(abs(o - e)) OVER (PARTITION BY attribute, levels)) ELSE 0 END AS y
      FROM e)
    SELECT attribute, levels, CAST(min(n) AS BIGINT) AS n, round(sum(pow(abs(o - e) - y, 2) / e), 4) AS stat,
      CAST(min(nr - 1) AS BIGINT) AS dof FROM y GROUP BY 1, 2""",
)
def _(s, d):
    # p-values have no counterpart in the checking SQL; unit tests cover them.
    people = plans.people_view(treatment(s, d))
    out = reports.equity_tests(people, groups=["gender", "race_group", "ethnicity_group"])
    return rounded(out.select("attribute", "levels", "n", "stat", "dof"), "stat", places=4)


@query(
    "report_treatment_rates",
    TREATMENT_CTES + """, l AS (SELECT 'crp' AS flag, initial_risk, CAST(crp AS VARCHAR) AS level FROM treatment
        UNION ALL SELECT 'cams', initial_risk, CAST(cams AS VARCHAR) FROM treatment),
    g AS (SELECT flag, initial_risk, level, count(*) AS n, grouping(initial_risk) AS gr, grouping(level) AS gk FROM l
          GROUP BY GROUPING SETS ((flag, initial_risk, level), (flag, initial_risk), (flag, level), (flag)))
    SELECT a.flag, a.initial_risk, a.level, a.n, round(a.n * 100.0::DOUBLE / b.n, 6) AS row_pct,
      CASE WHEN a.gr = 0 AND a.gk = 0 THEN 'cell' WHEN a.gr = 0 THEN 'row_total' WHEN a.gk = 0 THEN 'col_total'
        ELSE 'grand_total' END AS margin
    FROM g a JOIN g b ON b.gk = 1 AND a.flag = b.flag AND a.gr = b.gr AND a.initial_risk IS NOT DISTINCT FROM b.initial_risk""",
)
def _(s, d):
    return rounded(reports.treatment_rates(treatment(s, d), flags=["crp", "cams"]), "row_pct")


@query(
    "report_help_topics",
    REQUEST_CTES + ", h AS (SELECT p.* FROM picked p WHERE rn = 1) "
    + " UNION ALL ".join(
        f"SELECT 'help_{n}' AS variable, round(avg(CASE WHEN coalesce(contains(what_can_help_you_with, '{t}'), false) "
        "THEN 1 ELSE 0 END), 6) AS mean FROM h"
        for n, t in P.HELP_TOPICS.items()
    )
    + " UNION ALL SELECT 'help_number', round(avg("
    + " + ".join(
        f"CASE WHEN coalesce(contains(what_can_help_you_with, '{t}'), false) THEN 1 ELSE 0 END" for t in P.HELP_TOPICS.values()
    )
    + "), 6) FROM h",
)
def _(s, d):
    return rounded(reports.help_topic_shares(requests(s, d)), "mean")
