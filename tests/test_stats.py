from __future__ import annotations

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from cohortloom import operators as op
from cohortloom.operators import significance, stats
from cohortloom.operators.significance import chi2_tail


@pytest.mark.parametrize("above", [None, 3])
def test_freq_layout_and_identities(spark, above):
    data = ["b", "a", None, "10", "9", "a", None, "b", "b"]
    df = spark.createDataFrame([(x,) for x in data], "v string").repartition(3)
    out = op.freq(df, "v", above).collect()
    values = sorted((r for r in out if r.kind == "value"), key=lambda r: r.cum_total)
    assert [r.value for r in values] == ["9", "10", "a", "b"]
    assert [r.n for r in values] == [1, 1, 2, 3]
    assert values[-1].cum_valid == pytest.approx(100) and sum(r.pct_valid for r in values) == pytest.approx(100)
    missing = next(r for r in out if r.kind == "missing")
    assert (missing.n, missing.pct_valid) == (2, None) and missing.cum_total == 100
    total = next(r for r in out if r.kind == "total")
    assert total.n == len(data)


def test_freq_of_only_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v string")
    assert {r.kind: r.n for r in op.freq(df, "v").collect()} == {"missing": 2, "total": 2}


def test_count_table_leaves_missing_out(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "v string")
    assert rows(op.count_table(df, "v"), "v", "n") == [("a", 2)]


def test_subset_freq_counts_missing_conditions(spark):
    df = spark.createDataFrame([("x", "A", "C"), ("y", None, "C"), ("z", None, "O"), ("x", "B", "C")], "v string, r string, s string")
    out = op.na_subset_freq(df, "v", (F.col("r") == "A") & (F.col("s") == "C"))
    got = {(r.kind, r.value): r.n for r in out.collect()}
    assert got == {("value", "x"): 1, ("missing", None): 1, ("total", None): 2}


def test_crosstab_margins(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["s", "t"]), rnd.choice("abc"), rnd.choice(["u", None])) for _ in range(300)]
    df = spark.createDataFrame(data, "by string, r string, c string")
    out = op.crosstab(df, "r", "c", by=["by"]).collect()
    cells = Counter(data)
    for r in out:
        want = {
            "cell": cells[(r.by, r.r, r.c)],
            "row_total": sum(n for k, n in cells.items() if k[:2] == (r.by, r.r)),
            "col_total": sum(n for k, n in cells.items() if (k[0], k[2]) == (r.by, r.c)),
            "grand_total": sum(n for k, n in cells.items() if k[0] == r.by),
        }[r.margin]
        assert r.n == want
    for by, level in product("st", "abc"):
        assert sum(r.row_pct for r in out if (r.by, r.r, r.margin) == (by, level, "cell")) == pytest.approx(100)


def test_describe_matches_numpy(spark):
    rnd = np.random.default_rng(4)
    x = np.round(rnd.exponential(10, 501), 1)
    data = [(float(v) if i % 10 else None, i) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "x double, i int")
    got = {r.variable: r for r in op.describe_numeric(df, ["x", "i"]).collect()}
    kept = np.array([v for v, _ in data if v is not None])
    r = got["x"]
    q1, med, q3 = np.quantile(kept, [0.25, 0.5, 0.75])
    want = {
        "mean": kept.mean(), "std_dev": kept.std(ddof=1), "min": kept.min(), "max": kept.max(), "q1": q1, "median": med,
        "q3": q3, "iqr": q3 - q1, "mad": 1.4826 * np.median(np.abs(kept - med)), "cv": kept.std(ddof=1) / kept.mean(),
        "n_valid": len(kept), "pct_valid": 100 * len(kept) / 501,
    }
    for name, value in want.items():
        assert r[name] == pytest.approx(value), name
    assert got["i"].median == 250


def test_quantiles_of_odd_numbers_are_exact(spark):
    """Neighbouring doubles, many magnitudes, both signs, zeros, infinities, one value, few values, ties."""
    rnd = np.random.default_rng(9)
    close = [1.0]
    while len(close) < 400:
        close.append(float(np.nextafter(close[-1], 2)))
    columns = {
        "close": rnd.permutation(close).tolist(), "wide": (rnd.choice([-1, 1], 400) * 10.0 ** rnd.uniform(-300, 300, 400)).tolist(),
        "ties": rnd.integers(-2, 3, 400).astype(float).tolist(), "one": [7.25] * 400, "signs": [-0.0, 0.0, 5e-324, -5e-324] * 100,
        "ends": [float("inf"), float("-inf"), 3.0, 4.0] * 100,
    }
    data = [(name, v) for name, values in columns.items() for v in values] + [("single", -3.5), ("pair", 1.0), ("pair", 2.0)]
    columns |= {"single": [-3.5], "pair": [1.0, 2.0]}
    df = spark.createDataFrame(data, "variable string, value double").repartition(7)
    got = {r.variable: r for r in stats._quantiles(df, {"low": 0.25, "mid": 0.5, "third": 1 / 3, "end": 1.0}).collect()}
    for name, values in columns.items():
        values = sorted(values)
        for label, p in (("low", 0.25), ("mid", 0.5), ("third", 1 / 3), ("end", 1.0)):
            at = (len(values) - 1) * p
            a, b, share = values[math.floor(at)], values[math.ceil(at)], at - math.floor(at)
            assert repr(got[name][label] + 0.0) == repr((a + (b - a) * share if share else a) + 0.0), (name, label)


def test_profile_never_shuffles_long_texts(spark):
    df = spark.createDataFrame([("x" * 100 + str(i % 7), i) for i in range(200)], "t string, n int")
    out = op.profile_table(df, 3)
    got = {r.value: r.value_n for r in out.filter("variable = 't' AND rank IS NOT NULL").collect()}
    assert len(got) == 3 and all(len(v) == 101 and n in (28, 29) for v, n in got.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(value" in plan
    counted = [line for line in plan.splitlines() if "Aggregate [variable" in line and "_head#" in line and "count(1) AS n#" in line]
    assert counted and not any("value#" in line for line in counted)


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "s string, n int")
    got = rows(op.profile_table(df, 1), "variable", "type", "n_valid", "n_missing", "n_distinct", "mean", "value", "value_n", "n_values")
    assert got == sorted(
        [("n", "int", 3, 0, 2, 5 / 3, "2", 2, 1), ("n", "int", 3, 0, 2, 5 / 3, None, 1, 1), ("s", "string", 2, 1, 1, None, "a", 2, 1)], key=repr
    )


def test_flag_means_with_missing(spark):
    df = spark.createDataFrame([(1, None), (0, 1)], "a int, b int")
    assert rows(op.multi_flag_means(df, ["a", "b"]), "variable", "mean") == [("a", 0.5), ("b", 1.0)]
    assert rows(op.multi_flag_means(df, ["a", "b"], na="propagate"), "variable", "mean") == [("a", 0.5), ("b", None)]


def test_scores(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, None, 3), (None, None, None)], "a int, b int, c int")
    out = op.completeness_score(df, ["a", "b", "c"], 2, "s")
    assert rows(out, "s_n", "s_enough", "s_sum") == sorted([(3, 1, 6), (2, 1, None), (0, 0, None)], key=repr)


def test_nps_zero_and_missing(spark):
    df = spark.createDataFrame([(10,), (9,), (8,), (6,), (1,), (0,), (None,)], "q int")
    r = op.nps_score(df, "q").first()
    assert (r.n_answered, r.promoters, r.detractors) == (6, 2, 2)
    assert r.nps == pytest.approx(0)
    assert op.nps_score(df, "q", zero_is_detractor=True).first().detractors == 3
    flags = op.nps_flags(df, "q", missing_detractor_as_no=True)
    assert (None, None, 0) in rows(flags, "q", "promoter", "detractor")


# --- tests ---------------------------------------------------------------------


def test_chi2_tail_values(spark):
    # 5 % points from standard tables
    points = {1: 3.841458820694124, 2: 5.991464547107979, 3: 7.814727903251179, 10: 18.307038053275146, 31: 44.98534328036513}
    df = spark.createDataFrame([(v, k) for k, v in points.items()], "s double, d bigint")
    assert [r[0] for r in df.select(chi2_tail("s", "d")).collect()] == pytest.approx([0.05] * 5, rel=1e-9)


def test_chi2_tail_far_and_near(spark):
    """Against the finite sum for even degrees of freedom and the error function for one, over many magnitudes."""
    cases = [(x, k) for x in (1e-9, 0.01, 0.7, 3.0, 9.9, 40.0, 300.0, 1200.0) for k in (1, 2, 4, 8, 50, 400)] + [(0.0, 3)]
    df = spark.createDataFrame(cases, "s double, d bigint").coalesce(1)
    for (x, k), row in zip(cases, df.select(chi2_tail("s", "d")).collect(), strict=True):
        h = x / 2
        if k == 1:
            want = math.erfc(math.sqrt(h))
        elif k == 3:
            want = 1.0
        else:
            want = math.fsum(math.exp(i * math.log(h) - h - math.lgamma(i + 1)) for i in range(k // 2))
        assert row[0] == pytest.approx(want, rel=1e-8, abs=1e-13), (x, k)


def two_way(seed, levels, n):
    rnd = random.Random(seed)
    return [(rnd.randrange(levels), rnd.randrange(2)) for _ in range(n)]


def test_chi_square_agrees_with_spark_ml(spark):
    df = spark.createDataFrame(two_way(2, 4, 400), "r int, c int")
    got = op.chi_square(df, "r", "c").first()
    vec = VectorAssembler(inputCols=["r"], outputCol="f").transform(df)
    want = ChiSquareTest.test(vec, "f", "c").first()
    assert got.stat == pytest.approx(want.statistics[0]) and got.p == pytest.approx(want.pValues[0])
    assert got.dof == want.degreesOfFreedom[0]


def test_chi_square_correction_and_degenerate_tables(spark):
    cells = {("t", 0, 0): 12, ("t", 0, 1): 5, ("t", 1, 0): 7, ("t", 1, 1): 9, ("empty", 0, 0): 4, ("empty", 1, 1): 6,
             ("flat", 0, 0): 3, ("flat", 1, 0): 5}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "s string, r int, c int")
    got = {r.s: r for r in op.chi_square(df, "r", "c", by=["s"]).collect()}

    def yates(a, b, c, d):
        n = a + b + c + d
        e = [(a + b) * (a + c) / n, (a + b) * (b + d) / n, (c + d) * (a + c) / n, (c + d) * (b + d) / n]
        y = min(0.5, *[abs(o - x) for o, x in zip((a, b, c, d), e, strict=True)])
        return sum((abs(o - x) - y) ** 2 / x for o, x in zip((a, b, c, d), e, strict=True))

    assert got["t"].stat == pytest.approx(yates(12, 5, 7, 9))
    assert got["empty"].stat == pytest.approx(yates(4, 0, 0, 6))
    assert (got["flat"].stat, got["flat"].dof, got["flat"].p) == (None, None, None)


def brute_fisher(data):
    rowt, colt = Counter(r for r, _ in data), Counter(c for _, c in data)
    k, n, cell = colt[min(colt)], len(data), Counter(data)
    sizes, seen = list(rowt.values()), [cell[(r, min(colt))] for r in rowt]

    def p(a):
        return math.prod(math.comb(t, x) for t, x in zip(sizes, a, strict=True)) / math.comb(n, k)

    every = [p(a) for a in product(*[range(t + 1) for t in sizes]) if sum(a) == k]
    return sum(x for x in every if x <= p(seen) * (1 + 1e-7))


@pytest.mark.parametrize("levels,n", [(2, 40), (3, 45), (4, 36), (5, 40), (7, 21), (8, 18)])
def test_fisher_matches_enumeration(spark, levels, n):
    data = two_way(levels, levels, n)
    df = spark.createDataFrame(data, "r int, c int")
    got = op.fisher_exact(df, "r", "c").first()
    assert (got.method, got.n) == ("exact", n) and got.p == pytest.approx(brute_fisher(data), rel=1e-9)


def test_fisher_far_from_chance(spark):
    data = [(i % 3, int((i % 3 == 0) ^ (i % 31 == 0))) for i in range(150)]
    df = spark.createDataFrame(data, "r int, c int")
    got = op.fisher_exact(df, "r", "c").first().p
    assert 0 < got < 1e-12 and got == pytest.approx(brute_fisher(data), rel=1e-9)


def test_parts_and_choices_cover_every_fill():
    low, size = np.array([3, 0, 7, 1]), np.array([2, 1, 4, 3])
    row, a = significance._choices(low, size)
    assert list(zip(row, a, strict=True)) == [(i, low[i] + j) for i in range(4) for j in range(size[i])]
    big = np.full(5, significance.CHILDREN // 2)
    assert [i for s in significance._parts(big) for i in range(s.start, s.stop)] == list(range(5))


def test_fisher_textbook_and_strata(spark):
    tea = [("tea", 0, 0)] * 3 + [("tea", 0, 1)] + [("tea", 1, 0)] + [("tea", 1, 1)] * 3
    flat = [("flat", 0, 0)] * 3 + [("flat", 1, 0)] * 2
    wide = [("wide", i % 2, i % 3) for i in range(12)]
    df = spark.createDataFrame(tea + flat + wide, "s string, r int, c int")
    got = {r.s: (r.p, r.method) for r in op.fisher_exact(df, "r", "c", by=["s"]).collect()}
    assert got["tea"][0] == pytest.approx(34 / 70) and got["tea"][1] == "exact"
    assert got["flat"] == (None, "none") and got["wide"] == (None, "none")


def test_fisher_simulation_is_close(spark):
    data = two_way(9, 4, 60)
    df = spark.createDataFrame(data, "r int, c int")
    got = op.fisher_exact(df, "r", "c", method="simulate", draws=4000).first()
    assert got.method == "simulated" and got.p == pytest.approx(brute_fisher(data), abs=0.04)
    assert op.fisher_exact(df, "r", "c", method="simulate", draws=4000).first().p == got.p


def test_fisher_large_counts(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("r"), ((F.col("id") % 7) < 3).cast("int").alias("c"))
    got = op.fisher_exact(df, "r", "c").first()
    assert got.method == "exact" and 0.9 < got.p <= 1.0


# --- trends --------------------------------------------------------------------


def numpy_loess(x, y, x0, span):
    d = np.abs(x - x0)
    need = max(1, math.floor(len(x) * span + 1e-5))
    h = np.sort(d)[need - 1]
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
    a = np.vander((x - x0) / h, 3, increasing=True)
    coef, *_ = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)
    return coef[0]


def test_local_trend_matches_least_squares(spark):
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 20, 400)
    y = np.sin(x / 4) + rnd.normal(0, 0.3, 400)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y, strict=True)], "w int, y double")
    got = op.local_trend(df, "w", "y", grid=30).collect()
    assert len(got) == 30
    for r in got:
        assert r.y == pytest.approx(numpy_loess(x.astype(float), y, r.w, 0.75), abs=1e-9)


def test_local_trend_needs_three_weeks(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 3.0)], "w int, y double")
    assert all(r.y is None for r in op.local_trend(df, "w", "y", grid=5).collect())


def test_points_read_off_the_curve(spark):
    df = spark.createDataFrame([(0.0, 10.0), (3.5, 12.0), (4.5, 14.0), (8.0, 5.0)], "x double, y double")
    assert rows(op.nearest_point(df, "x", "y", [4, 9]), "target", "y") == [(4.0, 12.0), (9.0, 5.0)]
    out = op.pct_change_points(df, "x", "y", 0, [4, 8])
    assert rows(out, "target", "value", "pct_change") == [(4.0, 12.0, 20.0), (8.0, 5.0, -50.0)]
    scaled = op.pct_change_points(df, "x", "y", 0, [8], scale=5)
    assert rows(scaled, "pct_change") == [(100.0,)]


def test_trend_band_matches_least_squares(spark):
    """Weights, residual variance and standard errors against dense matrices over all rows."""
    rnd = np.random.default_rng(6)
    x = rnd.integers(0, 25, 160).astype(float)
    y = np.sin(x / 5) + rnd.normal(0, 0.3, 160)

    def weights(at):
        d = np.abs(x - at)
        order = np.sort(d)
        h = order[int(np.floor(160 * 0.75 + 1e-5)) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        basis = np.vander((x - at) / h, 3, increasing=True)
        return np.linalg.solve(basis.T @ (basis * w[:, None]), (basis * w[:, None]).T)[0]

    smoother = np.array([weights(v) for v in x])
    rest = np.eye(160) - smoother
    variance = ((rest @ y) ** 2).sum() / np.trace(rest @ rest.T)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 1.0), ("few", 2.0, 3.0), (None, None, 1.0)], "k string, x double, y double")
    got = op.local_trend(df, "x", "y", by=["k"], grid=20, se=True).collect()
    plain = {(r.k, r.grid_index): r.y for r in op.local_trend(df, "x", "y", by=["k"], grid=20).collect()}
    for r in (r for r in got if r.k == "a"):
        part = weights(r.x)
        assert r.y == pytest.approx(part @ y, rel=1e-8) and r.y == pytest.approx(plain["a", r.grid_index], rel=1e-8)
        assert r.se == pytest.approx(math.sqrt(variance * (part**2).sum()), rel=1e-7)
    assert all(r.y is None and r.se is None for r in got if r.k != "a") and sum(r.k == "a" for r in got) == 20


def dense_spline(x, y, grid, pieces=10):
    """The same spline from dense matrices over all rows; the basis by recursion over its degree."""
    from cohortloom.operators.spline import PENALTIES

    lo, hi, m = x.min(), x.max(), pieces + 3

    def design(v):
        s = (v - lo) / (hi - lo) * pieces
        knots = np.arange(-3, pieces + 4)
        b = ((s[:, None] >= knots[:-1]) & (s[:, None] < knots[1:])).astype(float)
        for d in range(1, 4):
            b = (s[:, None] - knots[: -d - 1]) / d * b[:, :-1] + (knots[d + 1 :] - s[:, None]) / d * b[:, 1:]
        return b[:, :m]

    basis = design(x)
    # Second derivatives are linear on an interval: Simpson's rule is exact for their products.
    form = np.zeros((m, m))
    second = np.diff(np.eye(m), 2, axis=0)
    for k in range(pieces):
        ends = second[k], (second[k] + second[k + 1]) / 2, second[k + 1]
        form += sum(w * np.outer(e, e) for w, e in zip((1 / 6, 4 / 6, 1 / 6), ends, strict=True))
    own = np.trace(basis.T @ basis) / np.trace(form)
    best = None
    for p in PENALTIES:
        pen = 10**p * own
        a = basis.T @ basis + pen * form
        c = np.linalg.solve(a, basis.T @ y)
        left = ((y - basis @ c) ** 2).sum() + pen * c @ form @ c
        score = (len(x) - 2) * np.log(left) + np.linalg.slogdet(a)[1] - (m - 2) * np.log(pen)
        if best is None or score <= best[0]:
            best = score, c, left, a
    at = design(np.nextafter(lo + (hi - lo) * np.arange(grid) / (grid - 1), -np.inf).clip(lo))
    variance = best[2] / (len(x) - 2)
    return at @ best[1], np.sqrt(variance * np.einsum("ij,ji->i", at, np.linalg.solve(best[3], at.T)))


def test_spline_trend_matches_dense_least_squares(spark):
    rnd = np.random.default_rng(8)
    x = rnd.integers(0, 40, 600).astype(float)
    wave = 50 + 5 * np.sin(x / 5) + rnd.normal(0, 1, 600)
    line = 3 - 0.2 * x + rnd.normal(0, 2, 600)
    sparse = np.where(x < 10, x, np.where(x > 30, x, np.nan))  # a gap: intervals without rows
    data = [("wave", float(a), float(b)) for a, b in zip(x, wave, strict=True)]
    data += [("line", float(a), float(b)) for a, b in zip(x, line, strict=True)]
    data += [("gap", float(a), float(b)) for a, b in zip(sparse, wave, strict=True) if a == a]
    data += [("few", 1.0, 1.0), ("few", 2.0, 3.0), ("one", 5.0, 1.0), ("flat", 1.0, 7.0), ("flat", 2.0, 7.0), ("flat", 4.0, 7.0)]
    data += [("wave", None, 1.0), ("wave", 3.0, None), (None, None, None)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    got = {}
    for r in op.local_trend(df, "x", "y", by=["k"], grid=21, se=True, method="spline").collect():
        got.setdefault(r.k, {})[r.grid_index] = r
    held = ~np.isnan(sparse)
    for k, (a, b) in {"wave": (x, wave), "line": (x, line), "gap": (sparse[held], wave[held])}.items():
        fit, se = dense_spline(a, b, 21)
        assert [got[k][i].y for i in range(21)] == pytest.approx(fit, rel=1e-6)
        assert [got[k][i].se for i in range(21)] == pytest.approx(se, rel=1e-5)
    assert all(r.y is None and r.se is None for k in ("few", "one") for r in got[k].values())
    assert [r.y for r in got["flat"].values()] == pytest.approx([7.0] * 21)
    assert None not in got
    plain = op.spline_trend(df.where("k = 'line'"), "x", "y", grid=21).collect()
    assert {r.grid_index: r.y for r in plain} == pytest.approx({i: r.y for i, r in got["line"].items()})
    assert op.spline_trend(df.limit(0), "x", "y").count() == 0
    with pytest.raises(ValueError):
        op.local_trend(df, "x", "y", method="loess")


def test_exact_test_of_large_tables_sends_few_rows(spark):
    """Five levels of 20,000 people each: no row per fill leaves a task, and p agrees with a sum over all fills."""
    def tested(table):
        cells = [(str(i), t, 1) for i, (n, k) in enumerate(table) for t in [1] * k + [0] * (n - k)]
        return spark.createDataFrame(cells, "level string, treated int, one int")

    crowd = tested([(20_000, 5_400), (20_100, 5_410), (20_200, 5_560), (20_300, 5_480), (20_400, 5_590)])
    tables, keys = significance._tables(crowd, "level", "treated", [])
    sized = significance._sized(tables, keys)
    fills = significance._open_fills(sized, keys)
    assert fills.count() < 1_000
    work = fills.mapInArrow(significance._paired, significance._schema(sized, keys, significance.WORK))
    assert work.count() < 20_000

    table = [(500, 140), (600, 150), (700, 210), (800, 230)]
    log = np.array([math.lgamma(v + 1) for v in range(2_601)])
    ways = [log[n] - log[: n + 1] - log[n::-1] for n, _ in table]
    total = sum(k for _, k in table)
    whole = log[2_600] - log[total] - log[2_600 - total]
    limit = sum(w[k] for w, (_, k) in zip(ways, table, strict=True)) + np.log1p(1e-7)
    p = 0.0
    for a in range(501):
        b = np.arange(601)[:, None]
        c = np.arange(701)[None, :]
        d = total - a - b - c
        weight = ways[0][a] + ways[1][:, None] + ways[2][None, :] + ways[3][np.clip(d, 0, 800)]
        p += np.exp(weight - whole)[(d >= 0) & (d <= 800) & (weight <= limit)].sum()
    got = significance.fisher_exact(tested(table), "level", "treated").first()
    assert got.p == pytest.approx(p, rel=1e-9)
