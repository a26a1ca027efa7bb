"""CRM-shaped views of the driver tables.

One list of SQL expressions per entity, valid in Spark SQL and in DuckDB alike,
so both sides of a check start from the same input columns. Null-free driver
columns get missing values through CASE, to exercise the missing-value rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import params as P
from cohortloom.plans.reports import RISK_NOTE_COLUMNS

K = "CAST(floor(o_totalprice / 1000) AS INT)"
A = "CAST(floor(abs(c_acctbal) / 10) AS INT)"
V = "CAST(floor(value) AS INT)"


def yes_no(key: str, mod: int, missing: bool = True) -> str:
    """'Yes' for remainder 1, missing for remainder 0, else 'No'."""
    none = f"WHEN {key} % {mod} = 0 THEN CAST(NULL AS STRING) " if missing else ""
    return f"CASE {none}WHEN {key} % {mod} = 1 THEN 'Yes' ELSE 'No' END"


def free_text(key: str, mod: int) -> str:
    return (
        f"CASE {key} % {mod} WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN 'None reported' "
        f"WHEN 3 THEN 'no' WHEN 4 THEN 'No mentioned' ELSE 'ongoing injury' END"
    )


#: Columns of a risk note that are taken over as they are.
RISK_FACTORS = RISK_NOTE_COLUMNS[RISK_NOTE_COLUMNS.index("note_risk_level") + 1 :]

ENTITIES: dict[str, tuple[str, dict[str, str]]] = {
    "cases": (
        "orders",
        {
            "id": "CAST(o_orderkey AS STRING)",
            "account_id": "CAST(o_custkey AS STRING)",
            "case_number": "CAST(o_orderkey AS STRING)",
            "created_date": "o_orderdate",
            "origin": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Phone' WHEN '5-LOW' THEN CAST(NULL AS STRING)"
                      " ELSE 'Web' END",
            "status": f"CASE o_orderstatus WHEN 'O' THEN '{P.ACTIVE_STATUS}' WHEN 'F' THEN 'Closed' ELSE 'Pending' END",
            "status_change_reason": (
                "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Completed Treatment' "
                "WHEN o_orderpriority = '2-HIGH' AND o_totalprice < 100000 THEN 'Declined Services At Intake' "
                "WHEN o_orderpriority = '2-HIGH' THEN 'Moved Away' "
                "WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice < 50000 THEN 'Test Case' "
                "WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice < 100000"
                " THEN 'Third Party - Converted Client' "
                "WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice < 150000"
                " THEN 'Referred to External Provider' "
                f"WHEN o_orderpriority = '5-LOW' AND o_totalprice > 400000 THEN '{P.DEATH_REASON}' "
                "ELSE CAST(NULL AS STRING) END"
            ),
            "i_am": f"CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN '{P.THIRD_PARTY_REQUEST}' "
                    f"WHEN o_totalprice < 20000 THEN CAST(NULL AS STRING) ELSE '{P.SELF_REQUEST}' END",
            "what_can_help_you_with": (
                "CASE WHEN o_totalprice < 30000 THEN CAST(NULL AS STRING) ELSE "
                "(CASE WHEN o_orderpriority = '1-URGENT' THEN 'Sleep;Anxiety;' ELSE 'Anger;' END) || "
                "(CASE WHEN o_totalprice > 250000 THEN 'Trauma;Other' ELSE 'Grief/Loss' END) END"
            ),
            "any_thoughts_of_killing_yourself": yes_no(K, 6),
            "thoughts_of_killing_yourself_right_now": yes_no(K, 8),
            "wished_you_were_dead_past_month": yes_no(K, 4),
            "thoughts_of_killing_yourself_past_month": yes_no(K, 5),
            "thinking_about_how_you_might_do_this": yes_no(K, 9),
            "thoughts_intention_of_acting_on_them": yes_no(K, 17),
            "details_of_how_intend_to_carry_out": yes_no(K, 13),
            "done_started_prepared_to_end_your_life": yes_no(K, 7),
            "done_started_prepared_last_3_months": yes_no(K, 11),
            "int_ckl_chronic_pain": yes_no(K, 3),
            "int_ckl_physical_heath_issues": free_text(K, 7),
            "int_ckl_physical_health_treatment": yes_no(K, 4),
            "int_ckl_mental_health_issues": free_text(K, 6),
            "int_ckl_mental_health_treatment": yes_no(K, 5),
            "int_ckl_substance_abuse": yes_no(K, 6),
            "int_ckl_peer_support": yes_no(K, 7),
            "int_ckl_receiving_care_at_vha": yes_no(K, 8),
            "owner_id": "CAST(o_custkey % 25 AS STRING)",
            "most_recent_overall_risk_level": f"CASE {K} % 5 WHEN 0 THEN 'HRC' WHEN 1 THEN 'MRC' WHEN 2 THEN 'LRC' "
                                              "WHEN 3 THEN 'Unrated' ELSE CAST(NULL AS STRING) END",
            **{
                part: f"CASE WHEN {K} % {i + 2} = 0 THEN CAST(NULL AS STRING) ELSE 'recorded' END"
                for i, part in enumerate(P.PLAN_PARTS)
            },
            "utm_campaign": f"CASE {K} % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'spring' ELSE 'autumn' END",
            "utm_content": f"CASE WHEN {K} % 3 = 0 THEN 'video' ELSE CAST(NULL AS STRING) END",
            "utm_term": f"CAST({K} % 6 AS STRING)",
            "last_connection_date_time": f"CAST(CAST('2024-01-01' AS DATE) + {K} AS TIMESTAMP)",
        },
    ),
    "accounts": (
        "customer",
        {
            "id": "CAST(c_custkey AS STRING)",
            "name": "CASE WHEN c_acctbal < -900 THEN c_name || ' test' WHEN c_acctbal < -800 THEN 'rrbc ' || c_name "
                    "WHEN c_acctbal < -700 THEN CAST(NULL AS STRING) ELSE c_name END",
            "created_date": "CAST('1994-01-01 00:00:00' AS TIMESTAMP)",
            "test_account": "c_acctbal > 9500",
            "health_cloud_ga_age": "CASE WHEN c_acctbal < 0 THEN CAST(NULL AS STRING) WHEN c_acctbal > 9000 "
                                   "THEN 'unknown' ELSE CAST(CAST(floor(c_acctbal / 100) AS INT) AS STRING)"
                                   " || ' Years' END",
            "health_cloud_ga_gender": "CASE c_mktsegment WHEN 'BUILDING' THEN 'Man' WHEN 'AUTOMOBILE' THEN 'Woman' "
                                      "WHEN 'MACHINERY' THEN 'Other' WHEN 'HOUSEHOLD' THEN CAST(NULL AS STRING) "
                                      "ELSE 'Refused' END",
            "race": "CASE c_nationkey % 6 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'White' "
                    "WHEN 2 THEN 'Black or African American;Nonwhite' WHEN 3 THEN 'Prefer not to say' "
                    "WHEN 4 THEN 'Black or African American' ELSE 'Asian' END",
            "ethnicity": "CASE c_nationkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Hispanic or Latino' "
                         "WHEN 2 THEN 'Prefer Not to Say' ELSE 'Not Hispanic or Latino' END",
            "assigned_sex_at_birth": f"CASE {A} % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Female' ELSE 'Male' END",
            "service_status": "CASE c_nationkey % 7 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Active Duty' "
                              "WHEN 2 THEN 'Army Reserve;Retired' WHEN 3 THEN 'Discharged (any status)' "
                              "WHEN 4 THEN 'National Guard' ELSE 'Veteran' END",
            "homeless": yes_no(A, 5),
            "int_ckl_domestic_violence": yes_no(A, 6),
            "int_ckl_employment_status": f"CASE {A} % 6 WHEN 0 THEN CAST(NULL AS STRING) "
                                         "WHEN 1 THEN 'Disabled;Looking for work' WHEN 2 THEN 'Retired;Other' "
                                         "WHEN 3 THEN 'Working full time for pay' ELSE 'Student' END",
            "int_ckl_health_insurance": yes_no(A, 7),
            "health_cloud_ga_last_active_case_ir": f"CASE {A} % 9 WHEN 0 THEN 'acute HRC' WHEN 1 THEN 'was MRC' "
                                                   "ELSE CAST(NULL AS STRING) END",
            "health_cloud_ga_lst_act_case_current_risk_lvll": f"CASE {A} % 4 WHEN 0 THEN 'LRC now' "
                                                              "WHEN 1 THEN 'none' ELSE CAST(NULL AS STRING) END",
        },
    ),
    "notes": (
        "lineitem",
        {
            "id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
                  "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
            "case": "CAST(l_orderkey AS STRING)",
            "created_date": "l_shipdate",
            "interaction_date_time": "l_shipdate",
            "case_note_type": "CASE WHEN l_linenumber = 7 THEN 'Call Center' WHEN l_linenumber = 6 THEN 'Scheduler' "
                              "WHEN l_linenumber = 5 THEN 'Supervisor' WHEN l_returnflag = 'A' THEN 'Session' "
                              "WHEN l_returnflag = 'N' THEN 'General' ELSE 'RRBC' END",
            "call_center_type": f"CASE WHEN l_linenumber = 7 AND l_quantity < 10 THEN '{P.DUPLICATE_CALL}' "
                                f"WHEN l_linenumber = 7 THEN '{P.INBOUND_CALL}' ELSE CAST(NULL AS STRING) END",
            "connection_outcome": f"CASE WHEN l_linestatus = 'F' THEN '{P.CONNECTED}' ELSE 'Left voicemail' END",
            "session_type": "CASE WHEN l_quantity < 15 THEN 'Intake' WHEN l_quantity < 20 THEN 'CAMS' "
                            "WHEN l_quantity < 25 THEN 'BCBT-SP' ELSE CAST(NULL AS STRING) END",
            "interaction_with_whom": f"CASE WHEN l_discount > 0.085 THEN '{P.THIRD_PARTY_CONTACT}' "
                                     "WHEN l_discount < 0.015 THEN CAST(NULL AS STRING) ELSE 'Client' END",
            "overall_risk_level": "CASE WHEN l_tax < 0.015 THEN 'HRC' WHEN l_tax < 0.035 THEN 'MRC' "
                                  "WHEN l_tax < 0.045 THEN 'LRC' WHEN l_tax < 0.065 THEN CAST(NULL AS STRING) "
                                  "ELSE 'Unrated' END",
        },
    ),
    "forms": (
        "events",
        {
            "id": "CAST(event_id AS STRING)",
            "care_plan": "CAST(user_id AS STRING)",
            "account": "CAST(NULL AS STRING)",
            "name": f"CASE event_type WHEN 'click' THEN '{P.FORM_FOLLOWUP}' WHEN 'error' THEN '{P.FORM_RESPONSE_PLAN}' "
                    f"WHEN 'purchase' THEN '{P.FORM_CONTINGENCY}' WHEN 'signup' THEN '{P.FORM_SESSION_BASELINE}' "
                    f"ELSE '{P.FORM_BASELINE}' END",
            "created_date": f"CASE WHEN event_type = 'error' AND {V} % 3 = 0 THEN ts - INTERVAL '45' DAY ELSE ts END",
            "cp_plan_enacted_date": f"CASE WHEN {V} % 3 = 0 THEN CAST(NULL AS DATE) ELSE CAST(ts AS DATE) END",
            **{
                item: f"CASE WHEN {V} % 10 = {i} THEN CAST(NULL AS INT) ELSE ({V} + {i}) % 6 END"
                for i, item in enumerate(P.COGNITION_ITEMS)
            },
            "crisis_crisis_reasons": f"CASE {V} % 12 WHEN 0 THEN 'Lethal Means in Hand;Other' "
                                     "WHEN 1 THEN 'Suicidal Gestures' WHEN 2 THEN 'Active Attempt' "
                                     "WHEN 3 THEN CAST(NULL AS STRING) ELSE 'Other' END",
            "crisis_suicide_timing": f"CASE {V} % 9 WHEN 0 THEN 'within the next day' WHEN 1 THEN 'within 30 days' "
                                     "WHEN 2 THEN 'no plan' ELSE CAST(NULL AS STRING) END",
            "crisis_date_crisis_occurred": f"CASE WHEN {V} % 8 = 0 THEN CAST(NULL AS DATE) "
                                           f"ELSE CAST(ts AS DATE) - ({V} % 40) END",
            "aborted_suicide_prep": yes_no(V, 21),
            "interrupted_prep": yes_no(V, 15),
            "recent_suicide_attempt": yes_no(V, 23),
            "impact": yes_no(V, 4),
            "stopper_details": f"CASE WHEN {V} % 2 = 0 THEN 'Staff' ELSE 'Friend' END",
            "coq_f_prevent_attempt": yes_no(V, 25),
            "crp_firearms_access": yes_no(V, 2, missing=False),
            "crp_safe_lockbox_usage": yes_no(V, 3, missing=False),
            "crp_firearms_loaded": f"CASE WHEN {V} % 5 < 3 THEN 'Yes' ELSE 'No' END",
        },
    ),
    "sheets": (
        "events",
        {
            "id": "CAST(event_id AS STRING)",
            "care_plan": "CAST(user_id AS STRING)",
            "name": "CASE CAST(event_id % 9 AS INT) "
                    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate([*P.FORM_SESSIONS, P.FORM_BASELINE, P.FORM_FOLLOWUP, P.FORM_COGNITION,
                                                                           P.FORM_INTAKE_LITE, P.FORM_FEEDBACK]))
                    + f" ELSE '{P.FORM_BASELINE}' END",
            "created_date": "ts",
            **{c: f"CASE WHEN {V} % 10 = {i} THEN CAST(NULL AS INT) ELSE ({V} + {i}) % 5 + 1 END" for i, c in enumerate(P.SESSION_RATINGS)},
            **{c: f"CASE WHEN {V} % 11 = {i} THEN CAST(NULL AS INT) ELSE ({V} + {i}) % 5 END" for i, c in enumerate([*P.WELLBEING_ITEMS, *P.COGNITION_ITEMS])},
            "coq_b_talked_about_suicide": yes_no(V, 3),
            "coq_b_talked_about_suicide_who": f"CASE {V} % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Friend/s;Family member/s' ELSE 'Other;' END",
            "coq_b_talked_about_suicide_other": f"CASE WHEN {V} % 5 = 0 THEN 'someone' ELSE CAST(NULL AS STRING) END",
            "coq_fleeting_thoughts": yes_no(V, 6),
            "coq_current_thoughts": yes_no(V, 7),
            "fss_nps_question": f"CASE WHEN {V} % 7 = 0 THEN CAST(NULL AS INT) ELSE {V} % 11 END",
            "coq_f_consent_for_attempt_details": yes_no(V, 4),
            "fss_consent_to_share": yes_no(V, 5),
            "coq_f_prevent_attempt": yes_no(V, 25),
            **{c: f"CASE WHEN {V} % {m} = 0 THEN CAST(NULL AS STRING) ELSE 'answer ' || CAST({V} % {m} AS STRING) END"
               for c, m in (("coq_f_prevent_attempt_details", 3), ("fss_share_with_others_txt", 5), ("fss_learned_from_txt", 7), ("fss_improvement_txt", 4))},
        },
    ),
    "owners": (
        "nation",
        {"id": "CAST(n_nationkey AS STRING)", "name": "n_name", "username": "lower(n_name)"},
    ),
    "calls": (
        "part",
        {"id": "'call-' || CAST(p_partkey AS STRING)", "transcript": "p_name || ' said'"},
    ),
    "risk_sheets": (
        "lineitem",
        {
            "id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
                  "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
            "case": "CAST(l_orderkey AS STRING)",
            "interaction_date_time": "l_shipdate",
            "case_note_type": "CASE WHEN l_linenumber = 5 THEN 'Supervisor' WHEN l_returnflag = 'A' THEN 'Session' "
                              "WHEN l_returnflag = 'N' THEN 'General' ELSE 'RRBC' END",
            "overall_risk_level": "CASE WHEN l_tax < 0.015 THEN 'HRC' WHEN l_tax < 0.035 THEN 'MRC' "
                                  "WHEN l_tax < 0.045 THEN 'LRC' WHEN l_tax < 0.065 THEN CAST(NULL AS STRING) ELSE 'Unrated' END",
            "lookup_primary_phone_call": "CASE WHEN l_linenumber = 1 THEN CAST(NULL AS STRING) ELSE 'call-' || CAST(l_partkey AS STRING) END",
            "lookup_secondary_phone_call": "CASE WHEN l_linenumber > 3 THEN 'call-' || CAST(l_suppkey AS STRING) ELSE CAST(NULL AS STRING) END",
            "lookup_tertiary_phone_call": "CAST(NULL AS STRING)",
            **{c: f"CASE l_linenumber % {i % 4 + 2} WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Yes' ELSE 'No' END"
               for i, c in enumerate(RISK_FACTORS)},
        },
    ),
    "surveys": (
        "events",
        {
            "id": "CAST(event_id AS STRING)",
            "care_plan": "CAST(user_id AS STRING)",
            "name": f"CASE WHEN {V} % 6 = 0 THEN '{P.FORM_FOLLOWUP}' ELSE '{P.FORM_FEEDBACK}' END",
            "created_date": "ts",
            "fss_nps_question": f"CASE WHEN {V} % 7 = 0 THEN CAST(NULL AS INT) ELSE {V} % 11 END",
        },
    ),
}

_PLAIN_TIME = {"created_date", "last_connection_date_time", "interaction_date_time"}


def view(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """The entity as a Spark frame; timestamps stay without time zone like the source."""
    table, exprs = ENTITIES[entity]
    df = spark.read.parquet(f"{folder}/{table}.parquet").selectExpr(*[f"{e} AS `{n}`" for n, e in exprs.items()])
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in _PLAIN_TIME & set(df.columns)})


def cte(entity: str) -> str:
    """The entity as a SQL common table expression."""
    table, exprs = ENTITIES[entity]
    cols = ",\n    ".join(f'{e} AS "{n}"' for n, e in exprs.items())
    return f"{entity} AS (SELECT\n    {cols}\n  FROM {table})"


def with_ctes(*entities: str) -> str:
    return "WITH " + ",\n".join(cte(e) for e in entities)
