from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom import operators as op
from cohortloom.operators import skew
from cohortloom.operators.ordered import ordered_rows, running_totals


def skewed(seed=3, n=600):
    """Rows where one key holds a third, half of those being copies of one date; some keys and dates missing."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rnd.choice([None, "a", "b", "c"] + [f"k{j}" for j in range(40)])
        day = dt.datetime(2024, 1, 1) if i % 6 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60))
        if i % 29 == 0:
            day = None
        out.append((i, key, day, rnd.choice([None, -3, 0, 2, 5])))
    return out


SCHEMA = "id int, k string, ts timestamp, v int"


def by_key(data):
    groups = {}
    for r in data:
        groups.setdefault(r[1], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[2] is None, r[2] or dt.datetime.max, r[0]))
    return groups


@pytest.mark.parametrize("above", [None, 500, 40, 7])
def test_ordered_rows_match_brute_force(spark, above):
    data = skewed()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    out = ordered_rows(df, ["k"], ["ts", "id"], ["id", "v"], above)
    assert out.columns == [*df.columns, "_rn", "_prev", "_first", "_many"]
    got = {r.id: (r["_rn"], r["_prev"] and tuple(r["_prev"]), tuple(r["_first"]), r["_many"]) for r in out.collect()}
    want = {}
    for g in by_key(data).values():
        for i, r in enumerate(g):
            prev = (g[i - 1][0], g[i - 1][3]) if i else None
            want[r[0]] = (i + 1, prev, (g[0][0], g[0][3]), len(g) > 1)
    assert got == want


@pytest.mark.parametrize("above", [None, 40, 7])
def test_running_totals_match_brute_force(spark, above):
    data = skewed(5)
    df = spark.createDataFrame(data, SCHEMA)
    got = dict(rows(running_totals(df, ["k"], ["ts", "id"], {"s": "id"}, above), "id", "s"))
    want = {}
    for g in by_key(data).values():
        total = 0
        for r in g:
            total += r[0]
            want[r[0]] = total
    assert got == want


def test_hot_key_is_cut_into_bounded_ranges(spark):
    data = skewed(7, 3000)
    df = spark.createDataFrame(data, SCHEMA)
    ranges = skew.with_ranges(df, ["k"], ["ts", "id"], 100).groupBy("k", F.col("_range.number").alias("r")).count()
    hot = [n for k, _, n in rows(ranges, "k", "r", "count") if k == "hot"]
    assert len(hot) >= 8 and max(hot) < 250 and sum(hot) == 1000


def test_many_copies_of_one_date_are_cut_too(spark):
    df = spark.range(2000).select(F.lit("x").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("ts"), "id")
    sizes = [r["count"] for r in skew.with_ranges(df, ["k"], ["ts", "id"], 200).groupBy("_range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 500


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("col", ["text", "number", "day", "amount"])
def test_ranges_follow_the_window_order(spark, col, desc):
    rnd = random.Random(2)
    data = [
        (i, "k" if i % 3 else None, rnd.choice([None, "a", "b", "é", ""]), rnd.choice([None, float("nan"), -0.0, 0.0, float("inf"), 1.5]),
         rnd.choice([None, dt.date(2024, 1, 1), dt.date(1969, 5, 5)]), rnd.choice([None, Decimal("1.10"), Decimal("-2.00")]))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "id int, k string, text string, number double, day date, amount decimal(9,2)")
    order = [(col, "desc") if desc else col, "id"]
    whole = rows(op.priority_sort(df, ["k"], order), "id", "position")
    spark.conf.set(skew.RANGE_ROWS_CONF, "10")
    try:
        assert rows(op.priority_sort(df, ["k"], order), "id", "position") == whole
    finally:
        spark.conf.unset(skew.RANGE_ROWS_CONF)
    plain = Window.partitionBy("k").orderBy(*skew.order_columns(order))
    assert rows(df.withColumn("p", F.row_number().over(plain)), "id", "p") == whole


def test_one_lag_reads_its_input_twice_at_most(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 3 as k", "id as ts").write.parquet(path)
    out = op.lag_score(spark.read.parquet(path), ["k"], ["ts", "id"], "ts")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") <= 2, plan


def test_group_values(spark):
    data = skewed()
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    out = op.attach_group(
        df, ["k"], {"n": F.count(F.lit(1)), "any": F.max(F.when(F.col("v") == 5, 1).otherwise(0))}
    )
    sizes = Counter(r[1] for r in data)
    fives = {r[1] for r in data if r[3] == 5}
    assert rows(out, "id", "n", "any") == sorted(((r[0], sizes[r[1]], int(r[1] in fives)) for r in data), key=repr)


def test_descending_and_missing_last(spark):
    df = spark.createDataFrame(
        [(1, "k", 1, dt.date(2024, 1, 2)), (2, "k", None, dt.date(2023, 1, 1)), (3, "k", 1, None),
         (4, "k", 0, dt.date(2022, 1, 1)), (5, "k", 1, dt.date(2024, 1, 2))],
        "id int, k string, f int, d date",
    )
    want = [(1, 1), (2, 5), (3, 3), (4, 4), (5, 2)]
    order = [("f", "desc"), "d", "id"]
    assert rows(op.priority_sort(df, ["k"], order), "id", "position") == want
    spark.conf.set(skew.RANGE_ROWS_CONF, "2")
    try:
        assert rows(op.priority_sort(df, ["k"], order), "id", "position") == want
    finally:
        spark.conf.unset(skew.RANGE_ROWS_CONF)
    assert rows(op.first_per_group_priority(df, ["k"], order), "id") == [(1,)]
    assert rows(op.latest_per_group(df, ["k"], "d", "id"), "id") == [(1,)]


def test_ties_are_kept(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    df = spark.createDataFrame(
        [(1, "a", 2, d1), (2, "a", 2, d1), (3, "a", 5, d2), (4, "a", 5, d2), (5, None, 1, d2), (6, "b", None, d1)],
        "id int, k string, v int, d date",
    )
    assert rows(op.min_date_ties(df, ["k"], "d"), "id") == [(1,), (2,), (5,), (6,)]
    assert rows(op.max_value_min_date(df, ["k"], "v", "d"), "id") == [(3,), (4,), (5,)]


def test_strict_max_needs_every_row(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    df = spark.createDataFrame([("a", 1, d1), ("a", 1, d2), ("b", 1, d1), ("b", 0, d2), ("c", None, d1)], "k string, f int, d date")
    out = op.strict_group_max(df, ["k"], F.col("f") == 1, "d", "m")
    assert set(rows(out, "k", "m")) == {("a", d2), ("b", None), ("c", None)}


def test_baseline_rules(spark):
    day = [dt.datetime(2024, 1, i) for i in (1, 2, 3)]
    df = spark.createDataFrame(
        [(1, "neg", day[0], -4), (2, "neg", day[1], 3), (3, "alone", day[0], -4), (4, "none", day[0], None),
         (5, "none", day[1], 7), (6, "zero", day[0], 0), (7, "zero", day[1], 2)],
        SCHEMA,
    )
    out = op.baseline_diff(df, ["k"], ["ts", "id"], ["v"], pct=True)
    assert rows(out, "id", "v_base", "v_bdiff", "v_pctdiff") == sorted(
        [
            (1, 0, -4, None), (2, 0, 3, None),      # a negative first score counts as 0 in a longer group
            (3, -4, 0, 0.0),                        # but not in a group of one
            (4, None, None, None), (5, None, None, None),
            (6, 0, 0, None), (7, 0, 2, None),       # division by zero gives nothing
        ],
        key=repr,
    )


def test_day_gaps_and_running_days(spark):
    data = skewed(11)
    df = spark.createDataFrame(data, SCHEMA)
    for above in ("1000000", "30"):
        spark.conf.set(skew.RANGE_ROWS_CONF, above)
        try:
            lag = dict(rows(op.lag_days(df, ["k"], ["ts", "id"], "ts"), "id", "lag_days"))
            run = dict(rows(op.running_days(df, ["k"], ["ts", "id"], "ts"), "id", "running_days"))
            chg = dict(rows(op.lag_score(df, ["k"], ["ts", "id"], "v"), "id", "lag_score"))
        finally:
            spark.conf.unset(skew.RANGE_ROWS_CONF)
        for g in by_key(data).values():
            total = 0
            for i, r in enumerate(g):
                gap = 0 if i == 0 else (r[2].date() - g[i - 1][2].date()).days if r[2] and g[i - 1][2] else None
                total = total + gap if gap is not None and total is not None else None
                assert (lag[r[0]], run[r[0]]) == (gap, total)
                want = r[3] - g[i - 1][3] if i and r[3] is not None and g[i - 1][3] is not None else None
                assert chg[r[0]] == want


def test_trajectory_only_with_baseline_form(spark):
    day = [dt.datetime(2024, 1, i, 12) for i in (1, 4, 20)]
    forms = spark.createDataFrame(
        [
            ("1", "x", "Interim", day[0], 4), ("2", "x", "Initial", day[1], 2), ("3", "x", "Other", day[2], 9),
            ("4", "x", "Interim", day[2], None), ("5", "y", "Interim", day[0], 1),
        ],
        "id string, care string, name string, ts timestamp, r int",
    )
    out = op.trajectory_multi(forms, "care", "ts", ["r"], ["Initial", "Interim"], ["Initial"], pct=["r"])
    assert rows(out, "id", "days_between", "days_from_first", "day_group", "weeks_from_first", "n_per_week", "n_per_day",
                "session_number", "r_bdiff", "r_pctdiff") == [
        ("1", 0, 0, "0. Baseline", 0, 1, 1, 1, 0, 0.0),
        ("2", 3, 3, "1-30 Days", 1, 1, 1, 2, -2, -0.5),
        ("4", 16, 19, "1-30 Days", 3, 1, 1, 3, None, None),
    ]


def test_trajectory_score_needs_complete_forms(spark):
    day = [dt.datetime(2024, 1, i) for i in (1, 8, 15)]
    forms = spark.createDataFrame(
        [("1", "x", "B", day[0], 1, None), ("2", "x", "F", day[1], 1, 2), ("3", "x", "F", day[2], 2, 3)],
        "id string, care string, name string, ts timestamp, a int, b int",
    )
    out = op.trajectory_score(forms, "care", "ts", ["a", "b"], ["B", "F"], ["B"])
    assert rows(out, "id", "score", "score_change", "score_bdiff", "days_from_first", "session_number") == [
        ("2", 3, None, 0, 0, 1), ("3", 5, 2, 2, 7, 2),
    ]
