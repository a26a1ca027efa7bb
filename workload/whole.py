"""Jobs of ``cohorts`` over all their groups, flags, columns and dates.

Those whose results SQL can express are registered with it. The others go to ``WHOLE``: tests compare what they share
with the narrower queries and work out the rest anew.
"""

from __future__ import annotations

from cohortloom import plans
from cohortloom.plans import reports
from workload.cohorts import ASSEMBLY, SCORE_NAMES, TREATMENT_CTES, assembled, requests, treatment
from workload.registry import Query, query, rounded

WHOLE: dict[str, Query] = {}


def whole(name: str):
    def add(fn: Query) -> Query:
        WHOLE[name] = fn
        return fn

    return add


@whole("report_equity_tests_all")
def _(s, d):
    # Chi-square and exact p-values have no counterpart in SQL.
    return reports.equity_tests(plans.people_view(treatment(s, d)))


@query(
    "report_treatment_rates_all",
    TREATMENT_CTES.replace("treatment AS (", "treatment AS MATERIALIZED (") + f""", people AS MATERIALIZED (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.account_id
        ORDER BY k.created_date DESC, t.case_id) AS rn FROM treatment t JOIN (SELECT id, created_date FROM cases) k
        ON k.id = t.case_id) WHERE rn = 1),
    l AS MATERIALIZED (SELECT unnest([{", ".join(f"'{f}'" for f in reports.TREATMENT_FLAGS)}]) AS flag, initial_risk,
        unnest([{", ".join(f"CAST({f} AS VARCHAR)" for f in reports.TREATMENT_FLAGS)}]) AS level FROM people),
    g AS MATERIALIZED (SELECT flag, initial_risk, level, count(*) AS n, grouping(initial_risk) AS gr, grouping(level) AS gk FROM l
          GROUP BY GROUPING SETS ((flag, initial_risk, level), (flag, initial_risk), (flag, level), (flag)))
    SELECT a.flag, a.initial_risk, a.level, a.n, round(a.n * 100.0::DOUBLE / b.n, 6) AS row_pct,
      CASE WHEN a.gr = 0 AND a.gk = 0 THEN 'cell' WHEN a.gr = 0 THEN 'row_total' WHEN a.gk = 0 THEN 'col_total'
        ELSE 'grand_total' END AS margin
    FROM g a JOIN g b ON b.gk = 1 AND a.flag = b.flag AND a.gr = b.gr AND a.initial_risk IS NOT DISTINCT FROM b.initial_risk""",
)
def _(s, d):
    return rounded(reports.treatment_rates(plans.people_view(treatment(s, d))), "row_pct")


DATE_NAMES = ["d01", "d02", "d03", "d04", "d05a", "d07", "d08", "d09", "d11", "d12"]


@query(
    "indicator_assembly_all",
    ASSEMBLY + f"""SELECT {', '.join(f't.{n}' for n in [*SCORE_NAMES, *DATE_NAMES])}, x05.date_b AS d05b, c.account_created_date,
      c.case_created_date, round(CASE WHEN i06 = 1 THEN 0.0 ELSE top END, 6) AS score,
      CASE WHEN top > 0 THEN first END AS score_date
      FROM t JOIN cohort c ON c.case_id = t.case_id LEFT JOIN x05 ON x05.case_id = t.case_id""",
)
def _(s, d):
    return rounded(assembled(s, d), "i07", "i08", "i09", "score")


@whole("cohort_requests_all")
def _(s, d):
    return requests(s, d)


@whole("cohort_established_all")
def _(s, d):
    return plans.cohort_established(requests(s, d))


@whole("cohort_treatment_all")
def _(s, d):
    return treatment(s, d)
