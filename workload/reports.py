"""Report jobs on the CRM-shaped views, and the smaller jobs they start from."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom import operators as op
from cohortloom import params as P
from cohortloom import plans
from cohortloom.plans import reports
from workload.cohorts import CARE, TREATMENT_CTES, treatment, window
from workload.mapping import view, with_ctes
from workload.registry import query, rounded, table
from workload.stats import PCT, freq_sql


@query("count_table", "SELECT kind, count(*) AS n FROM (SELECT nullif(event_type, 'view') AS kind FROM events) WHERE kind IS NOT NULL GROUP BY 1")
def _(s, d):
    return op.count_table(table(s, d, "events").select(F.nullif("event_type", F.lit("view")).alias("kind")), "kind")


@query(
    "cohort_forms",
    TREATMENT_CTES + f""" SELECT id, care_plan, name FROM forms WHERE {window('created_date', CARE)}
      AND care_plan IN (SELECT case_id FROM treatment)""",
)
def _(s, d):
    return plans.cohort_forms(view(s, d, "forms"), treatment(s, d), CARE).select("id", "care_plan", "name")


@query(
    "people_view",
    TREATMENT_CTES + """ SELECT case_id, account_id, initial_risk, cams_bcbt FROM (SELECT t.*, row_number() OVER (
      PARTITION BY t.account_id ORDER BY k.created_date DESC, t.case_id) AS rn FROM treatment t
      JOIN (SELECT id, created_date FROM cases) k ON k.id = t.case_id) WHERE rn = 1""",
)
def _(s, d):
    return plans.people_view(treatment(s, d)).select("case_id", "account_id", "initial_risk", "cams_bcbt")


ALL_SURVEYS = f"(SELECT fss_nps_question AS q FROM surveys WHERE name = '{P.FORM_FEEDBACK}')"
LATEST_SURVEYS = f"""(SELECT CASE WHEN q IN (9, 10) THEN 1 WHEN q IS NOT NULL THEN 0 END AS promoter,
    CASE WHEN q BETWEEN 1 AND 6 THEN 1 WHEN q IS NOT NULL THEN 0 END AS detractor
  FROM (SELECT fss_nps_question AS q, row_number() OVER (PARTITION BY care_plan
    ORDER BY created_date DESC NULLS LAST, id) AS rn FROM surveys WHERE name = '{P.FORM_FEEDBACK}') WHERE rn = 1)"""


@query(
    "report_feedback",
    with_ctes("surveys") + f""" SELECT * FROM ({freq_sql(ALL_SURVEYS, {"fss_nps_question": "q"}, True)})
      UNION ALL SELECT * FROM ({freq_sql(LATEST_SURVEYS, {"promoter": "promoter", "detractor": "detractor"}, True)})""",
)
def _(s, d):
    return rounded(reports.feedback_scores(view(s, d, "surveys")), *PCT)
