from __future__ import annotations

import datetime as dt

from conftest import rows
from fixtures import PARAMS, account, at, case, entity, form, note
from pyspark.sql import functions as F

from cohortloom import params as P
from cohortloom import plans
from cohortloom.plans import reports


def requests(spark, cases, accounts, notes):
    return plans.cohort_requests(
        entity(spark, "case", cases), entity(spark, "account", accounts), entity(spark, "case_note", notes), PARAMS
    )


def test_request_exclusions(spark):
    cases = [
        case("in"), case("start", "B", "2023-12-01 05:00"), case("end", "C", "2024-03-01 05:00"),
        case("third", "D", i_am=P.THIRD_PARTY_REQUEST), case("noiam", "E", i_am=None), case("noacc", None),
        case("conv", "F", status_change_reason="Third Party - Converted Client"),
        case("test", "G", status_change_reason="Test Case"), case("tname", "H"), case("tflag", "I"),
        case("lost", "no such account"), case("other", "J", status_change_reason="Moved", status="Closed"),
        case("nullname", "K"),
    ]
    accounts = [account(x) for x in "ABCDEFGJ"] + [account("H", name="my Test"), account("I", test_account=True),
                                                   account("K", name=None)]
    out = requests(spark, cases, accounts, [])
    assert {r[0] for r in rows(out, "case_id")} == {"in", "start", "other", "nullname"}
    assert set(rows(out, "n_notes", "connected_to_client", "intake_and_risk", "initial_risk")) == {(None, 0, None, None)}


def test_request_note_flags(spark):
    cases = [case(x, x) for x in ("rated", "many", "three", "calls", "dup")]
    notes = [
        # the first note with a risk level is not the first note
        note("1", "rated", "2024-01-01 10:00", overall_risk_level=None),
        note("2", "rated", "2024-01-03 10:00", overall_risk_level="MRC"),
        note("3", "rated", "2024-01-02 10:00", overall_risk_level="LRC", connection_outcome="Left voicemail"),
        note("4", "rated", None, overall_risk_level="HRC"),
        *[note(f"m{i}", "many", session_type="Intake" if i == 0 else None) for i in range(4)],
        *[note(f"t{i}", "three", session_type="Intake" if i == 0 else None) for i in range(3)],
        note("c1", "calls", case_note_type="Call Center", call_center_type=P.INBOUND_CALL),
        note("c2", "calls", case_note_type="Supervisor"),
        note("c3", "calls", case_note_type="Scheduler", connection_outcome=None),
        note("d1", "dup", call_center_type=P.DUPLICATE_CALL, overall_risk_level="HRC"),
        {**note("late", "dup"), "interaction_date_time": at("2024-03-01 05:00")},
        note("nocase", None),
    ]
    out = requests(spark, cases, [account(c["id"]) for c in cases], notes)
    got = {r.case_id: r for r in out.collect()}
    assert got["rated"].initial_risk == "3. LRC" and got["rated"].intake_and_risk == 1 and got["rated"].n_notes == 4
    assert (got["many"].n_connections, got["many"].intake_and_risk) == (4, 1)
    assert (got["three"].n_connections, got["three"].intake_and_risk) == (3, 0)
    calls = got["calls"]
    assert (calls.connected_to_client, calls.call_center_connection, calls.scheduler_connection) == (0, 1, 0)
    assert calls.origin == "Call Center"
    assert got["dup"].n_notes is None and got["dup"].origin is None


def test_request_one_case_per_person(spark):
    cases = [
        case("early", "P", "2024-01-01 00:00"), case("rated", "P", "2024-02-01 00:00"), case("later", "P", "2024-02-02 00:00"),
        case("q2", "Q", "2024-01-05 00:00"), case("q1", "Q", "2024-01-05 00:00"),
    ]
    notes = [note("1", "rated", overall_risk_level="HRC"), note("2", "later", overall_risk_level="HRC"), note("3", "early")]
    out = requests(spark, cases, [account("P"), account("Q")], notes)
    assert rows(out, "account_id", "case_id") == [("P", "rated"), ("Q", "q1")]
    established = plans.cohort_established(out)
    assert rows(established, "case_id") == [("rated",)]


def test_one_hots_and_triples_add_up(spark):
    accounts = [
        account("A", race="White;Other", ethnicity="Unknown", health_cloud_ga_gender="Man", health_cloud_ga_age="17 Years"),
        account("B", race=None, ethnicity="Hispanic or Latino", homeless="Yes", health_cloud_ga_age="80 Years"),
    ]
    out = requests(spark, [case("1", "A"), case("2", "B", int_ckl_chronic_pain="No")], accounts, [])
    for block in (["race_black", "race_white", "race_other_mixed", "race_missing"],
                  ["age_18_34", "age_35_54", "age_55_74", "age_75_plus", "age_missing"],
                  ["gender_man", "gender_woman", "gender_other", "gender_missing"],
                  ["homeless_yes", "homeless_no", "homeless_missing"],
                  ["chronicpain_yes", "chronicpain_no", "chronicpain_missing"],
                  ["ethnicity_hl", "ethnicity_not_hl", "ethnicity_missing"]):
        total = sum((F.col(c) for c in block), F.lit(0))
        assert {r[0] for r in out.select(total).collect()} == {1}, block


def test_treatment_cohort(spark):
    crp = dict.fromkeys(P.PLAN_PARTS[:4], "x")
    cases = [
        case("full", "A", most_recent_overall_risk_level="LRC", **crp),
        case("legacy", "B", **dict.fromkeys(P.PLAN_PARTS[:3], "x")),
        case("third", "C"), case("closed", "D", status="Closed"), case("ext", "E", status_change_reason="Referred to External Provider"),
        case("iamnull", "F", i_am=None), case("unreached", "G"), case("done", "H", status="Closed", status_change_reason="Graduated"),
    ]
    accounts = [account(x) for x in "ACDEFGH"] + [
        account("B", health_cloud_ga_last_active_case_ir="-", health_cloud_ga_lst_act_case_current_risk_lvll="was MRC")
    ]
    notes = [
        note("1", "full", "2024-01-01 00:00", session_type="CAMS"),
        note("2", "full", "2024-01-02 00:00", session_type="BCBT-SP", connection_outcome="No answer", overall_risk_level="HRC"),
        note("3", "legacy", session_type="BCBT-SP", interaction_with_whom=P.THIRD_PARTY_CONTACT),
        note("4", "legacy"), note("5", "third", interaction_with_whom=P.THIRD_PARTY_CONTACT),
        note("6", "closed"), note("7", "ext"), note("8", "iamnull", overall_risk_level="MRC"),
        note("9", "unreached", connection_outcome=None), note("10", "done", case_note_type="Call Center"),
        note("11", "done", case_note_type="General"),
    ]
    forms = [
        form("f1", "full", P.FORM_CONTINGENCY, "2024-01-05 00:00", cp_plan_enacted_date=dt.date(2024, 1, 5)),
        form("f2", "full", P.FORM_CONTINGENCY, "2024-01-09 00:00", cp_plan_enacted_date=dt.date(2024, 1, 8)),
        form("f3", "full", P.FORM_CONTINGENCY, "2024-01-10 00:00"),
        form("f4", "legacy", P.FORM_CONTINGENCY, "2024-03-02 00:00", cp_plan_enacted_date=dt.date(2024, 3, 1)),
    ]
    out = plans.cohort_treatment(
        entity(spark, "case_note", notes), entity(spark, "case", cases), entity(spark, "account", accounts),
        entity(spark, "form", forms), PARAMS,
    )
    got = {r.case_id: r for r in out.collect()}
    assert set(got) == {"full", "legacy", "iamnull", "done"}
    full = got["full"]
    # the unanswered note sets no flag and gives no risk level
    assert (full.cams, full.bcbt, full.cams_bcbt, full.initial_risk) == (1, 0, 1, "3. LRC")
    assert (full.crp, full.contingency_plan, full.n_contingency_plans, full.cp_plan_enacted_date) == (1, 1, 2, dt.date(2024, 1, 8))
    legacy = got["legacy"]
    assert (legacy.bcbt, legacy.crp, legacy.contingency_plan, legacy.crp_or_contingency) == (1, 0, 0, 0)
    assert (legacy.initial_risk, legacy.initial_risk2) == (None, "2. MRC")
    assert got["iamnull"].initial_risk == "2. MRC"


def test_closure_reasons_count_unknown_risk_everywhere(spark):
    df = spark.createDataFrame(
        [("1. HRC", "Closed", "done", 1), ("1. HRC", "Open", "x", 1), (None, "Closed", "y", 0), (None, "Open", "z", 1),
         ("2. MRC", None, "w", 1)],
        "initial_risk string, status string, status_change_reason string, cams_bcbt int",
    )
    assert rows(reports.closure_reasons(df), "level", "reason", "n") == sorted(
        [("1. HRC", "done", 1), ("1. HRC", None, 1), ("2. MRC", None, 2), ("3. LRC", None, 1)], key=repr
    )
    assert rows(reports.closure_reasons(df, treated_only=True), "level", "reason", "n") == sorted(
        [("1. HRC", "done", 1), ("2. MRC", None, 1)], key=repr
    )


def test_owner_report_and_never_talked(spark):
    people = spark.createDataFrame(
        [("1", "N1", "o1", None, "2. MRC", "r"), ("2", "N2", "o2", None, None, "s"), ("3", "N3", "o1", "1. HRC", "1. HRC", None)],
        "case_id string, case_number string, owner_id string, initial_risk string, initial_risk2 string, status_change_reason string",
    )
    owners = entity(spark, "owner", [{"id": "o1", "name": "Owner One"}, {"id": "o2", "name": "Owner Two"}])
    owned = reports.with_owner(people, owners, "Owner Two")
    assert rows(reports.no_risk_cases(owned), "case_number", "owner_name") == [("N1", "Owner One")]
    forms = entity(spark, "form", [
        form("1", "1", P.FORM_BASELINE, coq_b_talked_about_suicide="No"),
        form("2", "9", P.FORM_BASELINE, coq_b_talked_about_suicide="No", coq_b_talked_about_suicide_who="Friend/s;Other;"),
        form("3", "3", P.FORM_BASELINE, coq_b_talked_about_suicide="Yes", coq_b_talked_about_suicide_who=None),
    ])
    talked = reports.talked_before(forms)
    assert rows(talked, "case_id", "talked_friends", "talked_other", "talked_family") == [
        ("1", 0, 0, 0), ("3", 0, 0, 0), ("9", 1, 1, 0),
    ]
    got = {(r.variable, r.kind, r.value): r.n for r in reports.never_talked(talked, owned).collect()}
    assert got[("initial_risk2", "value", "2. MRC")] == 1 and got[("initial_risk2", "missing", None)] == 1


def test_feedback_stories_and_transcripts(spark):
    forms = entity(spark, "form", [
        form("1", "a", P.FORM_FEEDBACK, "2024-01-01 00:00", fss_nps_question=3),
        form("2", "a", P.FORM_FEEDBACK, "2024-01-09 00:00", fss_nps_question=9, fss_consent_to_share="Yes"),
        form("3", "b", P.FORM_FEEDBACK, fss_nps_question=0),
        form("4", "b", P.FORM_FOLLOWUP, coq_f_prevent_attempt="Yes"),
    ])
    got = {(r.variable, r.kind, r.value): r.n for r in reports.feedback_scores(forms).collect()}
    assert got[("promoter", "value", "1")] == 1 and got[("detractor", "value", "0")] == 2
    # Answers count in every survey, not in the latest only.
    assert {v: n for (var, kind, v), n in got.items() if var == "fss_nps_question" and kind == "value"} == {"0": 1, "3": 1, "9": 1}
    cohort = spark.createDataFrame([("a",)], "case_id string")
    inside = plans.cohort_forms(forms, cohort, PARAMS)
    assert rows(inside, "care_plan").count(("a",)) == 2 and not {r for r in rows(inside, "care_plan")} - {("a",)}
    assert {r.variable for r in reports.feedback_scores(inside).collect()} == {"fss_nps_question", "promoter", "detractor"}
    out = reports.stories(forms)
    assert "Consent to share stories" in out.columns and out.count() == 4
    assert rows(out.groupBy("Consent to share stories").count(), "Consent to share stories", "count") == [("No", 3), ("Yes", 1)]

    cases = spark.createDataFrame([("N1", "1", "A"), ("N2", "2", "B")], "case_number string, case_id string, account_id string")
    notes = entity(spark, "case_note", [
        note("1", "1", overall_risk_level="HRC", lookup_primary_phone_call="p1", recent_attempt="Yes"),
        note("2", "1", overall_risk_level="other", lookup_primary_phone_call="p1"),
        note("3", "2", overall_risk_level="LRC"), note("4", "zzz", overall_risk_level="LRC"),
    ])
    risk = reports.risk_notes(cases, notes, PARAMS)
    assert len(risk.columns) == 36
    assert rows(risk, "case_id", "note_risk_level", "recent_attempt") == [("1", "1. HRC", "Yes"), ("2", "3. LRC", None)]
    text = "amazonconnect_contact_lens_transcripts_full_text"
    calls = entity(spark, "contact_analytics", [{"id": "p1", text: "hello"}, {"id": "p2", text: "x"}])
    assert rows(reports.risk_note_transcripts(risk, calls), "case_id", text) == [("1", "hello")]


def test_trajectory_reports(spark):
    rating = dict.fromkeys(P.SESSION_RATINGS, 4)
    items, well = dict.fromkeys(P.COGNITION_ITEMS, 2), dict.fromkeys(P.WELLBEING_ITEMS, 3)
    forms = entity(spark, "form", [
        form("1", "a", P.FORM_SESSION_BASELINE, "2024-01-01 00:00", **rating),
        form("2", "a", "CAMS Interim Session", "2024-01-09 00:00", **dict.fromkeys(P.SESSION_RATINGS, 1)),
        form("3", "a", "CAMS Final Session", "2024-02-09 00:00", **dict.fromkeys(P.SESSION_RATINGS, 0)),
        form("4", "b", "CAMS Interim Session", **rating),
        form("5", "a", P.FORM_INTAKE_LITE, "2024-01-01 00:00", **items),
        form("6", "a", P.FORM_COGNITION, "2024-01-20 00:00", **{**items, P.COGNITION_ITEMS[0]: 5}),
        form("7", "a", P.FORM_COGNITION, "2024-01-21 00:00", **{**items, P.COGNITION_ITEMS[0]: None}),
        form("8", "c", P.FORM_BASELINE, "2024-01-01 00:00", **well), form("9", "c", P.FORM_FOLLOWUP, "2024-02-05 00:00", **well),
    ])
    sessions = reports.session_trajectories(forms)
    pain, pct = "cams_rate_psychological_pain_bdiff", "cams_rate_overall_suicide_risk_pctdiff"
    assert rows(sessions, "id", pain, pct, "weeks_from_first") == [("1", 0, 0.0, 0), ("2", -3, -0.75, 2), ("3", -4, -1.0, 6)]
    assert rows(reports.cognition_trajectories(forms), "id", "score", "score_bdiff") == [("5", 12, 0), ("6", 15, 3)]
    assert rows(reports.wellbeing_trajectories(forms), "id", "score", "day_group") == [("8", 21, "0. Baseline"), ("9", 21, "31-60 Days")]
    weekly = reports.weekly_report(sessions, "weeks_from_first", ["cams_rate_stress", pain])
    assert rows(weekly.filter("measure = 'cams_rate_stress'"), "weeks_from_first", "mean", "n") == [(0, 4.0, 1), (2, 1.0, 1), (6, 0.0, 1)]
    trend = reports.trend_report(sessions, "weeks_from_first", ["cams_rate_stress", pain], targets=[4])
    assert {r.measure for r in trend.collect()} == {"cams_rate_stress", pain}


def test_characteristics_reports_run(spark):
    out = requests(spark, [case("1"), case("2", "B")], [account("A"), account("B", health_cloud_ga_gender="Man")], [])
    table = reports.characteristics_report(out)
    totals = {r.variable: r.n for r in table.filter("kind = 'total'").collect()}
    assert set(totals) == set(reports.REQUEST_COLUMNS) and set(totals.values()) == {2}
    assert reports.connected_by_month(out, [1]).filter("kind = 'total'").first().n == 2
    people = out.withColumn("cams_bcbt", F.when(F.col("case_id") == "1", 1).otherwise(0))
    shares = reports.treated_characteristics(people)
    assert rows(shares.filter("variable = 'gender'"), "cohort", "level", "n") == sorted(
        [("all", "Man", 1), ("all", P.UNKNOWN, 1), ("treated", P.UNKNOWN, 1), ("untreated", "Man", 1)], key=repr
    )
