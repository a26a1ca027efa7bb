"""Jobs over all their groups, flags, columns and dates."""

from __future__ import annotations

from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import workload
from cohortloom import params as P
from cohortloom.plans import reports
from workload.whole import WHOLE

FOLDER = "/root/testdata/sf0.001"


def exact_two_rows(table):
    """Fisher's exact p of a table of two columns, by enumerating all tables with its margins."""
    rows, hits = [sum(r) for r in table], sum(r[1] for r in table)

    def tables(at, left):
        if at == len(rows) - 1:
            if 0 <= left <= rows[at]:
                yield comb(rows[at], left)
            return
        for k in range(min(rows[at], left) + 1):
            for w in tables(at + 1, left - k):
                yield comb(rows[at], k) * w

    seen = 1
    for n, (_, k) in zip(rows, table, strict=True):
        seen *= comb(n, k)
    return sum(w for w in tables(0, hits) if w <= seen * (1 + 1e-7)) / comb(sum(rows), hits)


def test_equity_tests_run_on_every_group(spark):
    got = {(r.attribute, r.levels): r for r in entry.queries()["report_equity_tests_all"](spark, FOLDER).collect()}
    assert {a for a, _ in got} == set(reports.GROUPS)
    for r in workload.QUERIES["report_equity_tests"](spark, FOLDER).collect():
        mine = got[r.attribute, r.levels]
        assert (mine.n, round(mine.stat, 4), mine.dof) == (r.n, r.stat, r.dof)
    people = workload.cohorts.plans.people_view(workload.cohorts.treatment(spark, FOLDER)).select("cams_bcbt", *reports.GROUPS).collect()
    for (attribute, levels), row in got.items():
        cells = Counter((p[attribute], p.cams_bcbt) for p in people if p[attribute] is not None and (levels == "all" or p[attribute] != P.UNKNOWN))
        names = sorted({level for level, _ in cells})
        table = [[cells[level, 0], cells[level, 1]] for level in names]
        assert row.n == sum(map(sum, table)) and row.dof == len(names) - 1 and row.method
        assert row.p is not None
        assert row.p_exact == pytest.approx(exact_two_rows(table), abs=1e-9)
    assert "report_equity_tests_all" in WHOLE


@pytest.mark.parametrize(("name", "at_least"), [("cohort_requests", 160), ("cohort_established", 160), ("cohort_treatment", 160)])
def test_cohorts_return_every_column(spark, name, at_least):
    whole, narrow = entry.queries()[f"{name}_all"](spark, FOLDER), workload.QUERIES[name](spark, FOLDER)
    assert len(whole.columns) == len(set(whole.columns)) >= at_least
    full = whole.collect()  # every column is computed
    shared = [tuple(r[c] for c in narrow.columns) for r in full]
    assert full and sorted(shared, key=repr) == sorted(map(tuple, narrow.collect()), key=repr)


def test_rates_cover_every_flag_and_scores_every_date(spark):
    rates = entry.queries()["report_treatment_rates_all"](spark, FOLDER).collect()
    assert {r.flag for r in rates} == set(reports.TREATMENT_FLAGS)
    scores = entry.queries()["indicator_assembly_all"](spark, FOLDER)
    assert {f"d{n}" for n in ("01", "02", "03", "04", "05a", "05b", "07", "08", "09", "11", "12")} <= set(scores.columns)


def test_kept_ties_multiply(spark):
    """Every form twice, under two ids: a case stands there twice as often for each indicator that comes from forms."""
    from cohortloom import plans
    from workload import cohorts as w
    from workload.mapping import view

    folder = "/root/testdata/sf0.01"
    cohort, notes = w.scoring(spark, folder), plans.connected_notes(view(spark, folder, "notes"), w.CARE)
    forms = view(spark, folder, "forms")
    twice = forms.unionByName(forms.withColumn("id", F.concat("id", F.lit("-copy"))))
    once = {r.case_id: r for r in plans.indicator_assembly(cohort, forms, notes, w.INTENDED).collect()}
    single = Counter(r.case_id for r in plans.indicator_assembly(cohort, forms, notes, w.INTENDED, ties="keep").select("case_id").collect())
    double = Counter(r.case_id for r in plans.indicator_assembly(cohort, twice, notes, w.INTENDED, ties="keep").select("case_id").collect())
    assert single.keys() == double.keys() == once.keys()
    grown = 0
    for case, row in once.items():
        if row.i05b is None:
            found = sum(row[f"i{n}"] is not None for n in ("01", "02", "03", "04", "05a", "07", "08", "12"))
            assert double[case] == single[case] * 2**found
            grown += found > 0
    assert grown > 0
    with pytest.raises(ValueError):
        plans.indicator_assembly(cohort, forms, notes, w.INTENDED, ties="some")
