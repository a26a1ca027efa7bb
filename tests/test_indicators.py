from __future__ import annotations

import datetime as dt
import random
from functools import reduce

import pytest
from conftest import rows
from fixtures import END, PARAMS, START, account, at, case, entity, form, note
from pyspark.sql import functions as F

from cohortloom import params as P
from cohortloom import plans
from cohortloom.plans.indicators import finish_score
from cohortloom.sources import time_window

IP = P.IndicatorParams(storage_mode="intended")
LAST = "last_connection_date_time"


def build(spark, cases, forms, notes=()):
    notes = [*notes, *[note(f"auto{c['id']}", c["id"]) for c in cases]]
    cases, notes = entity(spark, "case", cases), entity(spark, "case_note", notes)
    accounts = entity(spark, "account", [account("A")])
    cohort = plans.cohort_scoring(notes, cases, accounts, PARAMS)
    forms = time_window(entity(spark, "form", forms), "created_date", START, END)
    return cohort, forms, plans.connected_notes(notes, PARAMS)


def scored(spark, cases, forms, notes=(), ip=IP):
    return {r.case_id: r for r in plans.indicator_assembly(*build(spark, cases, forms, notes), ip).collect()}


def by_joins(cohort, forms, notes, ip):
    """The same frame from one small frame per indicator, joined one after another."""
    frame = plans.form_frame(cohort, forms)
    base = cohort.select("account_id", "account_created_date", "case_id", "case_created_date")
    parts = []
    for n in ("01", "02", "03", "04", "07", "08", "11", "12"):
        part = getattr(plans, f"indicator_{n}")(frame, ip)
        parts.append(part.withColumnsRenamed({"value": f"i{n}", "date": f"d{n}"}))
    parts.append(
        plans.indicator_05(frame, ip).withColumnsRenamed(
            {"value_a": "i05a", "date_a": "d05a", "value_b": "i05b", "date_b": "d05b"}
        )
    )
    parts.append(plans.indicator_06(cohort, ip).withColumnRenamed("value", "i06"))
    nine = plans.indicator_09(plans.note_frame(cohort, notes), ip)
    parts.append(nine.withColumnsRenamed({"value": "i09", "date": "d09"}))
    return finish_score(reduce(lambda a, b: a.join(b, "case_id", "left"), parts, base), ip)


def random_tables(seed):
    rnd = random.Random(seed)
    yn = ["Yes", "No", None]
    cases, forms, notes = [], [], []
    for i in range(40):
        items = {c: rnd.choice(yn) for c in plans.indicators.HIGH_ITEMS + plans.indicators.MODERATE_ITEMS}
        last = at("2023-11-20 00:00") + dt.timedelta(days=rnd.randrange(500))
        cases.append(case(f"c{i}", **items, status_change_reason=rnd.choice([None, None, P.DEATH_REASON, "Moved"]),
                          **{LAST: rnd.choice([last, last, last, None])}))
        for j in range(rnd.randrange(7)):
            when = at("2023-11-25 00:00") + dt.timedelta(days=rnd.randrange(110), hours=rnd.randrange(24))
            forms.append({
                **form(f"f{i}-{j}", f"c{i}", rnd.choice([P.FORM_RESPONSE_PLAN, P.FORM_BASELINE])), "created_date": when,
                "crisis_crisis_reasons": rnd.choice([*P.CRISIS_PHRASES, "Other", None]),
                "crisis_suicide_timing": rnd.choice([*P.CRISIS_TIMINGS, "later", None]),
                "crisis_date_crisis_occurred": rnd.choice([when.date(), None]),
                **{c: rnd.choice(yn) for c in ("aborted_suicide_prep", "interrupted_prep", "recent_suicide_attempt",
                                               "impact", "coq_f_prevent_attempt", "crp_firearms_access",
                                               "crp_safe_lockbox_usage", "crp_firearms_loaded")},
                "stopper_details": rnd.choice(["Staff", "Friend", None]),
                **{c: rnd.choice([0, 2, 4, 5, 5, 5, None] if rnd.random() < 0.1 else [2, 3, 4]) for c in P.COGNITION_ITEMS},
            })
        for j in range(rnd.randrange(4)):
            notes.append(note(f"n{i}-{j}", f"c{i}", "2023-12-10 00:00", overall_risk_level=rnd.choice(["HRC", "MRC", "LRC", None])))
    return cases, forms, notes


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    "ip",
    [IP, P.IndicatorParams(), P.IndicatorParams(date_rule="all", no_impact_rule="no", storage_mode="intended")],
)
def test_one_pass_equals_join_chain(spark, seed, ip):
    tables = build(spark, *random_tables(seed))
    one, chain = plans.indicator_assembly(*tables, ip), by_joins(*tables, ip)
    names = one.columns
    got, want = rows(one, *names), rows(chain, *names)
    assert len(got) == len(want) > 5
    for a, b in zip(got, want, strict=True):
        for name, x, y in zip(names, a, b, strict=True):
            assert x == (pytest.approx(y) if isinstance(y, float) else y), name


def test_thirty_day_rule_binds_to_the_last_phrase(spark):
    crisis = dt.date(2024, 1, 10)
    cases = [case(x, **{LAST: at(when)}) for x, when in
             (("gest30", "2024-02-09 08:00"), ("gest29", "2024-02-08 23:00"), ("lethal", "2024-01-11 00:00"))]
    forms = [
        form("1", "gest30", "Crisis", crisis_crisis_reasons="x;Suicidal Gestures", crisis_date_crisis_occurred=crisis),
        form("2", "gest29", "Crisis", crisis_crisis_reasons="Suicidal Gestures", crisis_date_crisis_occurred=crisis),
        form("3", "lethal", "Crisis", crisis_crisis_reasons="Lethal Means in Hand", crisis_date_crisis_occurred=crisis),
    ]
    got = scored(spark, cases, forms)
    assert [got[c].i01 for c in ("gest30", "gest29", "lethal")] == [1.0, None, 1.0]
    strict = scored(spark, cases, forms, ip=P.IndicatorParams(date_rule="all"))
    assert [strict[c].i01 for c in ("gest30", "gest29", "lethal")] == [1.0, None, None]


def test_ramps_at_their_edges(spark):
    high = {"thoughts_intention_of_acting_on_them": "Yes"}
    mod = {"wished_you_were_dead_past_month": "Yes"}
    day = at("2024-01-15 12:00")
    cases = [
        case("h360", **high, **{LAST: day + dt.timedelta(days=360)}), case("h180", **high, **{LAST: day + dt.timedelta(days=180)}),
        case("h0", **high, **{LAST: day}), case("before", **high, **{LAST: day - dt.timedelta(days=400)}),
        case("m30", **mod, **{LAST: day + dt.timedelta(days=30)}), case("both", **high, **mod, **{LAST: day}),
        case("none", **{LAST: day}), case("nolast", **high),
    ]
    forms = [form(c["id"], c["id"], P.FORM_BASELINE) for c in cases]
    got = scored(spark, cases, forms)
    want = {"h360": 0.16, "h180": 0.12, "h0": 0.08, "before": None, "m30": 0.0125, "both": 0.08, "none": None, "nolast": None}
    assert {k: v.i07 and round(v.i07, 6) for k, v in got.items()} == want
    assert got["h360"].score_date == got["h360"].d07 == day + dt.timedelta(days=360)


def test_cognition_score_needs_all_items(spark):
    day = at("2024-01-15 12:00")
    yes = dict(zip(P.COGNITION_ITEMS, (3, 2, 2, 2, 2, 2), strict=True))
    cases = [case(x, **{LAST: day + dt.timedelta(days=n)}) for x, n in (("six", 180), ("less", 90), ("low", 180), ("gap", 180))]
    forms = [
        form("1", "six", P.FORM_COGNITION, **yes), form("2", "less", P.FORM_COGNITION, **yes),
        form("3", "low", P.FORM_COGNITION, **{**yes, P.COGNITION_ITEMS[0]: 2}),
        form("4", "gap", P.FORM_COGNITION, **{**yes, P.COGNITION_ITEMS[0]: None}),
    ]
    got = scored(spark, cases, forms)
    assert {k: v.i08 and round(v.i08, 6) for k, v in got.items()} == {"six": 0.24, "less": 0.14, "low": None, "gap": None}


def test_attempt_rules_and_overrides(spark):
    high = {"thoughts_intention_of_acting_on_them": "Yes", LAST: at("2024-02-15 00:00")}
    cases = [case(x, **high) for x in ("yes", "no", "unknown", "unsure")] + [
        case("died", **high, status="Closed", status_change_reason=P.DEATH_REASON)
    ]
    forms = [
        form("1", "yes", "S", recent_suicide_attempt="Yes", impact="Yes"),
        form("2", "no", "S", recent_suicide_attempt="Yes", impact="No"),
        form("3", "unknown", "S", recent_suicide_attempt="Yes"),
        form("4", "unsure", "S", recent_suicide_attempt="Yes", impact="Unsure"),
        form("5", "died", "S", coq_f_prevent_attempt="Yes"),
    ]
    got = scored(spark, cases, forms)
    assert {k: (v.i05a, v.i05b) for k, v in got.items()} == {
        "yes": (1.0, 1.0), "no": (None, None), "unknown": (None, None), "unsure": (None, 1.0), "died": (None, None),
    }
    assert (got["yes"].i07, got["yes"].d07, got["yes"].score) == (0.0, None, 1.0)
    assert got["unsure"].score == 0.0 and got["unsure"].score_date is None
    assert (got["died"].i12, got["died"].score, got["died"].score_date) == (1.0, 0.0, at("2024-01-15 12:00"))
    stated = scored(spark, cases, forms, ip=P.IndicatorParams(no_impact_rule="no"))
    assert {k: v.i05b for k, v in stated.items() if v.i05b} == {"no": 1.0}


def test_storage_modes(spark):
    unsafe = {"crp_firearms_access": "Yes", "crp_safe_lockbox_usage": "No", "crp_firearms_loaded": "Yes"}
    plan = P.FORM_RESPONSE_PLAN
    better = {"crp_firearms_access": "Yes", "crp_safe_lockbox_usage": "Yes", "crp_firearms_loaded": "No"}
    cases = [case(x, **{LAST: at("2024-02-20 00:00")}) for x in ("both", "locked", "soon", "worse")]
    forms = [
        form("1", "both", plan, "2024-01-01 00:00", **unsafe), form("2", "both", plan, "2024-01-31 00:00", **better),
        form("3", "locked", plan, "2024-01-01 00:00", **unsafe),
        form("4", "locked", plan, "2024-02-10 00:00", **{**better, "crp_firearms_loaded": "Yes"}),
        form("5", "soon", plan, "2024-01-01 00:00", **unsafe), form("6", "soon", plan, "2024-01-30 00:00", **better),
        form("7", "worse", plan, "2024-01-01 00:00", **better), form("8", "worse", plan, "2024-02-10 00:00", **unsafe),
    ]
    got = scored(spark, cases, forms)
    assert {k: v.i11 for k, v in got.items()} == {"both": 0.82, "locked": 0.72, "soon": None, "worse": None}
    assert got["both"].score_date == at("2024-01-31 00:00")
    written = scored(spark, cases, forms, ip=P.IndicatorParams())
    assert {v.i11 for v in written.values()} == {None}


def test_scoring_cohort_rules(spark):
    cases = [
        case("active"), case("idle", status="Closed"), case("ext", status_change_reason="Referred to External Provider"),
        case("carer", status_change_reason="Caring Contacts - Ongoing"), case("iamnull", i_am=None),
        case("third", i_am=P.THIRD_PARTY_REQUEST), case("silent"),
    ]
    notes = [note(c["id"], c["id"]) for c in cases[:-1]]
    notes.append(note("x", "silent", interaction_with_whom=P.THIRD_PARTY_CONTACT))
    cohort = plans.cohort_scoring(
        entity(spark, "case_note", notes), entity(spark, "case", cases), entity(spark, "account", [account("A")]), PARAMS
    )
    assert rows(cohort, "case_id") == [("active",), ("ext",), ("iamnull",)]


def test_case_without_forms_keeps_its_row(spark):
    got = scored(spark, [case("quiet", **{LAST: at("2024-02-01 00:00")})], [form("1", "other", "S")],
                 [note("n", "quiet", "2024-01-02 00:00", overall_risk_level="HRC")])
    assert round(got["quiet"].score, 6) == 0.086667 and got["quiet"].i01 is None


def test_totals(spark):
    tables = build(spark, *random_tables(4))
    scores = plans.indicator_assembly(*tables, IP)
    want = scores.agg(F.sum("score").alias("s")).first().s
    assert plans.score_totals(scores).first().score == pytest.approx(want)


def test_people_keep_tied_first_cases(spark):
    df = spark.createDataFrame(
        [("A", "1", at("2024-01-01 00:00")), ("A", "2", at("2024-01-01 00:00")), ("A", "3", at("2024-01-02 00:00"))],
        "account_id string, case_id string, case_created_date timestamp",
    )
    assert rows(plans.scored_people(df), "case_id") == [("1",), ("2",)]


def test_falling_ramp_is_refused(spark):
    with pytest.raises(ValueError):
        plans.indicators.ramp(F.lit(None), F.lit(None), P.Ramp(full=0.1, slope=-0.1, start=0.1, months=12))
