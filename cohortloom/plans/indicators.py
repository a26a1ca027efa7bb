"""Scoring cohort and the multi-indicator fractional outcome score.

``indicator_*`` give one indicator each from a case-by-form (or case-by-note)
frame. ``indicator_assembly`` computes all of them from one aggregate over forms
and one over notes and reads the cohort once; forms are collapsed before they
meet it, so a case with any number of forms costs the join only as many rows as
it has crisis dates.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import params as P
from cohortloom.functions import contains0, days_between, flag, months30, rowwise_extremes
from cohortloom.operators import (
    drop_test_names,
    exclude_list,
    exclude_list_status,
    inner_join,
    min_date_ties,
    numeric_totals,
)
from cohortloom.operators.skew import lookup_join
from cohortloom.sources import key_semi_join, null_or_ne, time_window, type_filter

HIGH_ITEMS = (
    "thoughts_intention_of_acting_on_them",
    "details_of_how_intend_to_carry_out",
    "done_started_prepared_last_3_months",
)
MODERATE_ITEMS = (
    "wished_you_were_dead_past_month",
    "thoughts_of_killing_yourself_past_month",
    "done_started_prepared_to_end_your_life",
)
LAST = "last_connection_date_time"


# --- cohort ------------------------------------------------------------------


def connected_notes(notes: DataFrame, p: P.CohortParams) -> DataFrame:
    """Connected first-party notes of the window that belong to a case."""
    notes = type_filter(time_window(notes, "interaction_date_time", p.start, p.end), "case_note_type", p.note_types)
    third = flag(F.col("interaction_with_whom") == p.third_party_contact)
    return notes.filter(
        (F.col("connection_outcome") == p.connected) & F.col("case").isNotNull() & (third == 0)
    ).withColumnsRenamed({"case": "case_id", "created_date": "note_created_date"})


def cohort_scoring(notes: DataFrame, cases: DataFrame, accounts: DataFrame, p: P.CohortParams) -> DataFrame:
    """Scored cases: contacted in the window, in care or closed for a reason not excluded, no test records."""
    cases = cases.withColumnsRenamed({"id": "case_id", "created_date": "case_created_date"})
    cases = cases.filter(F.col("account_id").isNotNull() & null_or_ne(F.col("i_am"), P.THIRD_PARTY_REQUEST))
    cases = exclude_list(cases, "status_change_reason", P.THIRD_PARTY_REASONS)
    cases = exclude_list_status(cases, "status_change_reason", p.scoring_excluded, "status", p.active_status)
    cases = key_semi_join(cases, "case_id", connected_notes(notes, p))
    accounts = accounts.withColumnsRenamed({"id": "account_id", "created_date": "account_created_date"})
    accounts = drop_test_names(accounts, "name", p.test_tokens, "test_account")
    return inner_join(cases, accounts, "account_id")


def form_frame(cohort: DataFrame, forms: DataFrame, start=None, end=None) -> DataFrame:
    """One row per case and form of the window; cases without forms stay."""
    if start is not None:
        forms = time_window(forms, "created_date", start, end)
    forms = forms.withColumnsRenamed({"care_plan": "case_id", "name": "form_name", "id": "form_id"}).drop("account")
    return _keep_cases(cohort, forms)


def _keep_cases(cohort: DataFrame, many: DataFrame) -> DataFrame:
    """Left join of cases to their many rows, where one case may own any share of them.

    Spark splits a crowded key on the left of an inner join only, so cases without rows are added.
    """
    names = [*cohort.columns, *[c for c in many.columns if c != "case_id"]]
    found = lookup_join(many, cohort, ["case_id"], "inner")
    alone = cohort.join(many, "case_id", "left_anti")
    return found.select(*names).unionByName(alone, allowMissingColumns=True)


def note_frame(cohort: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per case and connected note, with the case's last contact."""
    return _keep_cases(cohort.select("case_id", LAST), notes)


# --- rules on one form or note -----------------------------------------------


def survived_30(last: Column, crisis: Column) -> Column:
    """Last contact at least 30 days after the crisis."""
    return F.to_date(last) >= F.date_add(crisis, 30)


def _phrases(ip: P.IndicatorParams) -> tuple[Column, Column]:
    """Crisis phrases that need no date check and those that do."""
    tests = [contains0(F.col("crisis_crisis_reasons"), t) for t in ip.crisis_phrases]
    if ip.date_rule == "last":
        free, bound = tests[:-1], tests[-1:]
    elif ip.date_rule == "all":
        free, bound = [], tests
    else:
        raise ValueError(f"unknown date_rule {ip.date_rule!r}")

    def any_of(conds):
        out = F.lit(False)
        for cond in conds:
            out = out | cond
        return out

    return any_of(free), any_of(bound)


def _attempt(ip: P.IndicatorParams) -> dict[str, Column]:
    attempt, impact = F.col("recent_suicide_attempt") == "Yes", F.col("impact")
    without = {"not_no": impact != "No", "no": impact == "No"}
    if ip.no_impact_rule not in without:
        raise ValueError(f"unknown no_impact_rule {ip.no_impact_rule!r}")
    return {"05a": attempt & (impact == "Yes"), "05b": attempt & without[ip.no_impact_rule]}


def _dated_rules(ip: P.IndicatorParams) -> dict[str, Column]:
    """Form conditions that also need the 30-day check."""
    return {
        "02": F.col("crisis_suicide_timing").isin(list(ip.crisis_timings)),
        "03": F.col("aborted_suicide_prep") == "Yes",
    }


def _plain_rules(ip: P.IndicatorParams) -> dict[str, Column]:
    """Form conditions that stand alone."""
    return {
        "04": (F.col("interrupted_prep") == "Yes") & (F.col("stopper_details") == ip.staff_label),
        **_attempt(ip),
        "12": F.col("coq_f_prevent_attempt") == "Yes",
    }


def _any_yes(items) -> Column:
    out = F.lit(False)
    for item in items:
        out = out | (F.col(item) == "Yes")
    return out


def ramp(last: Column, since: Column, r: P.Ramp) -> Column:
    """Score of the time in care from ``since`` to ``last``, in 30-day months."""
    if r.slope < 0 or r.start + r.slope > r.full + 1e-9:
        raise ValueError("a ramp must not fall: the earliest date has to give the largest score")
    m = months30(last, since)
    return F.when(m >= r.months, F.lit(r.full)).when(m < r.months, F.lit(r.slope / r.months) * m + F.lit(r.start))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def _screen_ramp(last: Column, since: Column) -> Column:
    """High-risk answers take the high ramp, else moderate answers the moderate one.

    Both lengths of the high rule come before the moderate rule, and a missing
    date gives neither.
    """
    return F.when(_any_yes(HIGH_ITEMS), ramp(last, since, P.HIGH_RAMP)).when(
        _any_yes(MODERATE_ITEMS), ramp(last, since, P.MODERATE_RAMP)
    )


def _cognition_positive() -> Column:
    total = F.lit(0)
    for item in P.COGNITION_ITEMS:
        total = total + F.col(item)
    return total >= P.COGNITION_CUTOFF


def _unsafe() -> Column:
    return flag(
        (F.col("crp_firearms_access") == "Yes")
        & (F.col("crp_safe_lockbox_usage") == "No")
        & (F.col("crp_firearms_loaded") == "Yes")
    )


def _plan_row() -> Column:
    """A response-plan form as a sortable struct, latest last."""
    return F.struct(
        F.col("created_date").alias("at"), F.col("form_id").alias("id"), _unsafe().alias("unsafe"),
        F.col("crp_safe_lockbox_usage").alias("locked"), F.col("crp_firearms_loaded").alias("loaded"),
    )


def _storage(mode: str, last: Column, unsafe_at: Column, all_unsafe: Column) -> tuple[Column, Column]:
    """Value and date of the storage indicator from the latest plan and the latest unsafe plan."""
    if mode == "as_written":
        # Needs every plan unsafe, and the latest one both unsafe and improved: never holds.
        base = (all_unsafe == 1) & (last["unsafe"] == 1)
    elif mode == "intended":
        base = F.lit(True)
    else:
        raise ValueError(f"unknown storage_mode {mode!r}")
    later = base & (days_between(last["at"], unsafe_at) >= 30)
    locked, unloaded = last["locked"] == "Yes", last["loaded"] == "No"
    value = (
        F.when(later & locked & unloaded, P.STORAGE_SCORES["both"])
        .when(later & unloaded, P.STORAGE_SCORES["unloaded"])
        .when(later & locked, P.STORAGE_SCORES["locked"])
    )
    return value, F.when(value.isNotNull(), last["at"])


# --- single indicators: case_id, value, date ----------------------------------


def _flagged(frame: DataFrame, cond: Column, value: str = "value", date: str = "date") -> DataFrame:
    """Value 1 at the earliest form that meets the condition, one row per case."""
    return frame.filter(cond).groupBy("case_id").agg(
        F.lit(1.0).alias(value), F.min("created_date").alias(date)
    )


def indicator_01(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Crisis form with one of the three phrases; the 30-day check binds as ``date_rule`` says."""
    free, bound = _phrases(ip)
    return _flagged(frame, free | (bound & survived_30(F.col(LAST), F.col("crisis_date_crisis_occurred"))))


def indicator_02(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Crisis with a near timing, survived 30 days."""
    return _flagged(frame, _dated_rules(ip)["02"] & survived_30(F.col(LAST), F.col("crisis_date_crisis_occurred")))


def indicator_03(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Aborted preparation, survived 30 days."""
    return _flagged(frame, _dated_rules(ip)["03"] & survived_30(F.col(LAST), F.col("crisis_date_crisis_occurred")))


def indicator_04(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Preparation interrupted by staff."""
    return _flagged(frame, _plain_rules(ip)["04"])


def indicator_05(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Attempt with impact (a) and attempt without (b): values and dates of both."""
    rules = _attempt(ip)
    a, b = rules["05a"], rules["05b"]
    return (
        frame.filter(a | b)
        .groupBy("case_id")
        .agg(
            F.max(F.when(a, 1.0)).alias("value_a"),
            F.min(F.when(a, F.col("created_date"))).alias("date_a"),
            F.max(F.when(b, 1.0)).alias("value_b"),
            F.min(F.when(b, F.col("created_date"))).alias("date_b"),
        )
    )


def indicator_06(cohort: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Case closed by death; no date."""
    return cohort.filter(F.col("status_change_reason") == ip.death_reason).select(
        "case_id", F.lit(1.0).alias("value")
    )


def _best_ramp(frame: DataFrame, value: Column) -> DataFrame:
    """Largest positive score of the case, dated at its last contact."""
    return (
        frame.withColumn("_v", value)
        .filter(F.col("_v") > 0)
        .groupBy("case_id")
        .agg(F.max("_v").alias("value"), F.max(LAST).alias("date"))
    )


def indicator_07(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Screening answers weighted by time in care since the form."""
    return _best_ramp(frame, _screen_ramp(F.col(LAST), F.col("created_date")))


def indicator_08(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Positive cognition score weighted by time in care; an unanswered item gives none."""
    value = F.when(_cognition_positive(), ramp(F.col(LAST), F.col("created_date"), P.COGNITION_RAMP))
    return _best_ramp(frame, value)


def indicator_09(notes: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Risk level of a note weighted by time in care since the note."""
    level, last, since = F.col("overall_risk_level"), F.col(LAST), F.col("note_created_date")
    value = F.when(level == "HRC", ramp(last, since, P.HIGH_RAMP)).when(
        level == "MRC", ramp(last, since, P.MODERATE_RAMP)
    )
    return _best_ramp(notes, value)


def indicator_11(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Firearm storage improved at least 30 days after an unsafe plan."""
    plans = (
        frame.filter(F.col("form_name") == P.FORM_RESPONSE_PLAN)
        .groupBy("case_id")
        .agg(
            F.max(_plan_row()).alias("_last"),
            F.max(F.when(_unsafe() == 1, F.col("created_date"))).alias("_unsafe_at"),
            F.min(_unsafe()).alias("_all_unsafe"),
        )
    )
    value, date = _storage(ip.storage_mode, F.col("_last"), F.col("_unsafe_at"), F.col("_all_unsafe"))
    return plans.select("case_id", value.alias("value"), date.alias("date")).filter(F.col("value") > 0)


def indicator_12(frame: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Self-reported help, earliest form."""
    return _flagged(frame, _plain_rules(ip)["12"])


# --- assembly -----------------------------------------------------------------


def _forms_by_crisis(forms: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Forms collapsed to (case, crisis date): earliest form of each condition, latest response plan."""
    created = F.col("created_date")
    free, bound = _phrases(ip)
    first_seen = {"01_free": free, "01_bound": bound, **_dated_rules(ip), **_plain_rules(ip)}
    is_plan = F.col("form_name") == P.FORM_RESPONSE_PLAN
    forms = forms.withColumnsRenamed({"care_plan": "case_id", "name": "form_name", "id": "form_id"})
    return forms.groupBy("case_id", F.col("crisis_date_crisis_occurred").alias("_crisis")).agg(
        *[F.min(F.when(cond, created)).alias(f"_d{n}") for n, cond in first_seen.items()],
        F.min(created).alias("_first_form"),
        F.min(F.when(_cognition_positive(), created)).alias("_first_cognition"),
        F.max(F.when(is_plan, _plan_row())).alias("_plan"),
        F.max(F.when(is_plan & (_unsafe() == 1), created)).alias("_unsafe_at"),
        F.min(F.when(is_plan, _unsafe())).alias("_all_unsafe"),
    )


def _first_notes(notes: DataFrame) -> DataFrame:
    """Earliest note of each scored risk level per case."""
    level, created = F.col("overall_risk_level"), F.col("note_created_date")
    return notes.groupBy("case_id").agg(
        F.min(F.when(level == "HRC", created)).alias("_high"),
        F.min(F.when(level == "MRC", created)).alias("_moderate"),
    )


def tie_counts(cohort: DataFrame, forms: DataFrame, notes: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """``case_id`` and ``n_rows``: how often a case would stand in the result if every indicator kept its tied records.

    An indicator keeps the records of its earliest date, a ramp those of its largest value and then of its earliest date; the
    case stands there as often as the product of these numbers. Records are counted per case and date, then per case, by
    map-side aggregates; no record meets another. The storage indicator keeps its one latest plan.
    """
    c = F.col
    free, bound = _phrases(ip)
    alive = survived_30(c(LAST), c("crisis_date_crisis_occurred"))
    rules = {"01": free | (bound & alive), **{n: r & alive for n, r in _dated_rules(ip).items()}, **_plain_rules(ip)}
    ramps = {
        "07": _screen_ramp(c(LAST), c("created_date")),
        "08": F.when(_cognition_positive(), ramp(c(LAST), c("created_date"), P.COGNITION_RAMP)),
    }
    # All positive values of one ramp, case and date are equal.
    per_date = form_frame(cohort, forms).groupBy("case_id", "created_date").agg(
        *[F.count_if(r).alias(f"n{n}") for n, r in rules.items()], *[F.count_if(v > 0).alias(f"n{n}") for n, v in ramps.items()],
        *[F.max(v).alias(f"v{n}") for n, v in ramps.items()],
    )
    first = {n: F.when(c(f"n{n}") > 0, F.struct(F.lit(0.0).alias("v"), c("created_date").alias("d"))) for n in rules}
    first |= {n: F.when(c(f"n{n}") > 0, F.struct((-c(f"v{n}")).alias("v"), c("created_date").alias("d"))) for n in ramps}
    per_case = per_date.groupBy("case_id").agg(*[F.min_by(f"n{n}", order).alias(f"n{n}") for n, order in first.items()])
    level, since = c("overall_risk_level"), c("note_created_date")
    risk = F.when(level == "HRC", ramp(c(LAST), since, P.HIGH_RAMP)).when(level == "MRC", ramp(c(LAST), since, P.MODERATE_RAMP))
    noted = note_frame(cohort, notes).withColumn("_v", risk).filter(c("_v") > 0).groupBy("case_id", "_v", since.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    noted = noted.groupBy("case_id").agg(F.min_by("_n", F.struct((-c("_v")).alias("v"), c("_d").alias("d"))).alias("n09"))
    names = [f"n{n}" for n in [*first, "09"]]
    rows = reduce(mul, [F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("long") for n in names])
    return per_case.join(noted, "case_id", "full").select("case_id", rows.alias("n_rows"))


def indicator_assembly(
    cohort: DataFrame, forms: DataFrame, notes: DataFrame, ip: P.IndicatorParams = P.IndicatorParams(), ties: str = "one"
) -> DataFrame:
    """One row per case: every indicator, the score and its date.

    ``notes`` are the connected notes. An attempt without impact zeroes the
    ramp and storage indicators; death zeroes the score. With ``ties='keep'`` a
    case has one row for every combination of its tied records (``tie_counts``).
    """
    if ties not in ("one", "keep"):
        raise ValueError(f"unknown ties {ties!r}")
    if ties == "keep":
        once = indicator_assembly(cohort, forms, notes, ip)
        counted = once.join(tie_counts(cohort, forms, notes, ip), "case_id", "left")
        times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n_rows", F.lit(1)).cast("long"))).alias("_time")
        return counted.select(*once.columns, times).drop("_time")
    case_cols = [
        "account_id", "account_created_date", "case_id", "case_created_date", "status_change_reason", LAST,
        *HIGH_ITEMS, *MODERATE_ITEMS,
    ]
    last, ok = F.col(LAST), survived_30(F.col(LAST), F.col("_crisis"))
    per_case = (
        cohort.select(*case_cols)
        .join(_first_notes(notes), "case_id", "left")
        .join(_forms_by_crisis(forms, ip), "case_id", "left")
        .groupBy(*case_cols, "_high", "_moderate")
        .agg(
            F.least(F.min("_d01_free"), F.min(F.when(ok, F.col("_d01_bound")))).alias("d01"),
            *[F.min(F.when(ok, F.col(f"_d{n}"))).alias(f"d{n}") for n in _dated_rules(ip)],
            *[F.min(f"_d{n}").alias(f"d{n}") for n in _plain_rules(ip)],
            F.min("_first_form").alias("_first_form"),
            F.min("_first_cognition").alias("_first_cognition"),
            F.max("_plan").alias("_plan"),
            F.max("_unsafe_at").alias("_unsafe_at"),
            F.min("_all_unsafe").alias("_all_unsafe"),
        )
    )
    # Ramps never fall with time, so the earliest form or note gives the case's largest score.
    values = {
        "07": _screen_ramp(last, F.col("_first_form")),
        "08": ramp(last, F.col("_first_cognition"), P.COGNITION_RAMP),
        "09": F.greatest(
            ramp(last, F.col("_high"), P.HIGH_RAMP), ramp(last, F.col("_moderate"), P.MODERATE_RAMP)
        ),
    }
    v11, d11 = _storage(ip.storage_mode, F.col("_plan"), F.col("_unsafe_at"), F.col("_all_unsafe"))
    flags = ["01", *_dated_rules(ip), *_plain_rules(ip)]
    full = per_case.withColumns(
        {
            **{f"i{n}": F.when(F.col(f"d{n}").isNotNull(), 1.0) for n in flags},
            "i06": F.when(F.col("status_change_reason") == ip.death_reason, 1.0),
            **{f"i{n}": _positive(v) for n, v in values.items()},
            **{f"d{n}": F.when(v > 0, last) for n, v in values.items()},
            "i11": v11,
            "d11": d11,
        }
    )
    return finish_score(full, ip)


def finish_score(full: DataFrame, ip: P.IndicatorParams) -> DataFrame:
    """Overrides, score and date on a frame with all ``i..`` and ``d..`` columns."""
    failed = F.col("i05b") == 1
    zeroed = ("07", "08", "09", "11")
    full = full.withColumns(
        {
            **{f"i{n}": F.when(failed, 0.0).otherwise(F.col(f"i{n}")) for n in zeroed},
            **{f"d{n}": F.when(~F.coalesce(failed, F.lit(False)), F.col(f"d{n}")) for n in zeroed},
        }
    )
    values = ("01", "02", "03", "04", "05a", "06", "07", "08", "09", "11", "12")
    dates = ["01", "02", "03", "04", "05a", "07", "08", "09", "12"]
    if ip.storage_mode == "intended":
        dates.append("11")
    full = full.withColumn("score", rowwise_extremes([F.col(f"i{n}") for n in values], "max"))
    earliest = rowwise_extremes([F.col(f"d{n}") for n in dates], "min")
    full = full.withColumn("score_date", F.when(F.col("score") > 0, earliest))
    full = full.withColumn("score", F.when(F.col("i06") == 1, 0.0).otherwise(F.col("score")))
    order = ("01", "02", "03", "04", "05a", "05b", "06", "07", "08", "09", "11", "12")
    shown = [c for n in order for c in ([f"i{n}"] if n == "06" else [f"i{n}", f"d{n}"])]
    return full.select(
        "account_id", "account_created_date", "case_id", "case_created_date", *shown, "score", "score_date"
    )


def score_totals(scores: DataFrame) -> DataFrame:
    """Column totals of the assembled scores."""
    return numeric_totals(scores)


def scored_people(cohort: DataFrame) -> DataFrame:
    """Earliest case of each person in the scoring cohort, ties kept."""
    return min_date_ties(cohort, ["account_id"], "case_created_date")
