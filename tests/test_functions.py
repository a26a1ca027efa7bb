from __future__ import annotations

from conftest import one, rows
from pyspark.sql import functions as F

from cohortloom import functions as fn
from cohortloom import params as P



def none():
    return F.lit(None).cast("string")


def test_missing_text_contains_nothing(spark):
    assert one(spark, [fn.contains0(none(), "x"), fn.contains0(F.lit("a.xb"), ".x"), fn.contains0(F.lit("axb"), ".x")]) == (
        False, True, False,
    )


def test_missing_value_is_no_member(spark):
    assert one(spark, [fn.isin0(none(), ["a"]), fn.isin0(F.lit("a"), ["a"]), fn.isin0(F.lit("b"), ["a"])]) == (
        False, True, False,
    )


def test_days_and_months(spark):
    a, b = F.lit("2024-03-31 23:59:00").cast("timestamp"), F.lit("2024-03-01 00:10:00").cast("timestamp")
    assert one(spark, [fn.days_between(a, b), fn.months30(a, b)]) == (30, 1.0)


def test_recode_keeps_value_where_condition_is_missing(spark):
    df = spark.createDataFrame([("Phone",), (None,), ("Web",)], "o string")
    out = df.select("o", fn.recode_value(F.col("o"), [(F.col("o") == "Phone", "Call Center")]).alias("r"))
    assert rows(out, "o", "r") == [("Phone", "Call Center"), ("Web", "Web"), (None, None)]


def test_relabel_and_levels(spark):
    assert one(spark, [fn.relabel(F.lit("HRC"), P.RISK_LABELS), fn.relabel(F.lit("x"), P.RISK_LABELS),
                       fn.coalesce_levels(none(), F.lit("b"))]) == ("1. HRC", None, "b")


def test_extremes_skip_missing(spark):
    cols = [F.lit(None).cast("int"), F.lit(3), F.lit(1)]
    assert one(spark, [fn.rowwise_extremes(cols, "max"), fn.rowwise_extremes(cols, "min")]) == (3, 1)


def test_tiered_risk_order(spark):
    names = ["a", "b", "c", "d"]
    data = [
        ("No", "No", "No", "Yes"),   # all screener items "No" wins over a severe "Yes"
        ("Yes", None, None, None),
        (None, None, "Yes", None),
        ("Yes", "No", "Yes", "Yes"),
        (None, "No", "No", "No"),
    ]
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    a, b, c, d = (F.col(n) for n in names)
    risk = fn.tiered_risk(all_no=[a, b, c], high=[d], moderate=[c], low=[a, b])
    assert [r[0] for r in df.select(risk).collect()] == [0, 1, 2, 3, None]


def test_screen_needs_every_item(spark):
    df = spark.createDataFrame([("Yes", "No"), ("Yes", None)], "a string, b string")
    assert [r[0] for r in df.select(fn.screen_flag([F.col("a"), F.col("b")])).collect()] == [1, 0]


def test_age_bands_from_text(spark):
    data = ["41 Years", "7 Years", "17 Years", "18 Years", "75 Years", "99 Years", "abc", "", None]
    df = spark.createDataFrame([(x,) for x in data], "age string")
    got = {r[0]: r[1] for r in df.select("age", fn.numeric_bands(F.col("age"), P.AGE_BANDS, P.UNKNOWN)).collect()}
    assert got == {
        "41 Years": "35 to 54 Years", "7 Years": P.UNKNOWN, "17 Years": P.UNKNOWN, "18 Years": "18 to 34 Years",
        "75 Years": "75+ Years", "99 Years": "75+ Years", "abc": P.UNKNOWN, "": P.UNKNOWN, None: P.UNKNOWN,
    }
    whole = F.lit("101 Years")
    bands = [fn.numeric_bands(whole, P.AGE_BANDS, P.UNKNOWN, d) for d in (2, None)]
    assert tuple(spark.range(1).select(*bands).first()) == (P.UNKNOWN, "75+ Years")


def test_free_text_yes_no_missing_sums_to_one(spark):
    data = [None, "", "None", "none at all", "no", "No", "no mentioned", "nothing", "back pain"]
    df = spark.createDataFrame([(x,) for x in data], "t string")
    out = fn.freetext_yes_no(df, "t", "p_")
    got = {r.t: (r.p_yes, r.p_no, r.p_missing) for r in out.collect()}
    assert all(sum(v) == 1 for v in got.values())
    assert got[None] == (0, 0, 1)
    assert {k for k, v in got.items() if v[1]} == {"", "None", "none at all", "no", "No", "no mentioned"}


def test_yes_no_with_implied_no(spark):
    df = spark.createDataFrame([("Yes", None), (None, "No"), (None, None), ("Maybe", "Yes")], "now string, ever string")
    out = fn.yes_no_missing(df, "now", "n_", implied_no="ever")
    assert rows(out, "now", "ever", "n_yes", "n_no", "n_missing") == sorted(
        [("Yes", None, 1, 0, 0), (None, "No", 0, 1, 0), (None, None, 0, 0, 1), ("Maybe", "Yes", 0, 0, 0)], key=repr
    )


def test_multi_select_counts_and_missing(spark):
    df = spark.createDataFrame([("Sleep;Anger",), (None,), ("",)], "h string")
    out = fn.multi_select_flags(df, "h", {"Sleep": "s", "Anger": "a", "Trust": "t"}, "n", "m")
    assert rows(out, "h", "s", "a", "t", "n", "m") == sorted(
        [("Sleep;Anger", 1, 1, 0, 2, 0), (None, 0, 0, 0, 0, 1), ("", 0, 0, 0, 0, 0)], key=repr
    )


def test_one_hot_keeps_missing(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    out = fn.one_hot_flags(df, "c", {"x": "is_x", "y": "is_y"})
    assert rows(out, "c", "is_x", "is_y") == sorted([("x", 1, 0), ("y", 0, 1), (None, None, None)], key=repr)


def test_day_bins_edges(spark):
    days = [0, 1, 30, 31, 60, 90, 120, 150, 180, 181, -1, None]
    df = spark.createDataFrame([(x,) for x in days], "d int")
    got = dict(df.select("d", fn.day_bins(F.col("d"))).collect())
    assert got[0] == "0. Baseline" and got[30] == "1-30 Days" and got[31] == "31-60 Days"
    assert got[180] == "151-180 Days" and got[181] == "181+ Days" and got[-1] is None and got[None] is None


def test_buckets(spark):
    data = ["Black or African American;Nonwhite", "White", "White;Other", "Prefer not to say", None]
    df = spark.createDataFrame([(x,) for x in data], "r string")
    c = fn.bucket_collapse(F.col("r"), P.RACE_MAP, "Other or Mixed Race", P.UNKNOWN, ["Prefer not to say"])
    assert [r[0] for r in df.select(c).collect()] == [
        "Black or African American", "White or Caucasian", "Other or Mixed Race", P.UNKNOWN, P.UNKNOWN,
    ]
    known = fn.bucket_unknown(F.col("r"), known=["White"], unknown="?")
    assert [r[0] for r in df.select(known).collect()] == ["?", "White", "?", "?", "?"]
