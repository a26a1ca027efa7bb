"""Frequency tables, cross-tabs, descriptives and scores.

Raw rows are collapsed by one map-side-combined aggregate; totals, shares,
running sums and order statistics are taken on the collapsed table.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.scalars import answered, flag, isin0
from cohortloom.operators.ordered import running_totals
from cohortloom.operators.rows import na_subset

MAD_SCALE = 1.4826  # fixed value: makes the MAD of normal data its standard deviation


def _long_counts(df: DataFrame, cols: Iterable[str], kind: str) -> DataFrame:
    """Row counts by (variable, value) over several columns in one pass."""
    cols = list(cols)
    plain = df.select(*[F.col(c).cast(kind).alias(c) for c in cols])
    return plain.unpivot([], cols, "variable", "value").groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def freq_multi(df: DataFrame, cols: Iterable[str], min_rows: int | None = None) -> DataFrame:
    """Frequency table of several columns: value rows, one missing row, one total row each.

    Shares of valid and of all rows with running shares; values in numeric order
    where they read as numbers, else in text order.
    """
    cols = list(cols)
    counts = _long_counts(df, cols, "string")
    totals = F.broadcast(  # one row per requested column
        counts.groupBy("variable").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("_valid"),
            F.sum("n").alias("_total"),
        )
    )
    # Missing values sort last and are dropped after the running sum: a filter before it would reach
    # the scan and keep Spark from sharing one aggregate between the sums and the totals.
    ordered = counts.withColumn("_num", F.col("value").try_cast("double"))
    values = (
        running_totals(ordered, ["variable"], ["_num", "value"], {"_cum": "n"}, min_rows)
        .filter(F.col("value").isNotNull())
        .join(totals, "variable")
        .select(
            "variable",
            F.lit("value").alias("kind"),
            "value",
            "n",
            _pct(F.col("n"), F.col("_valid")).alias("pct_valid"),
            _pct(F.col("_cum"), F.col("_valid")).alias("cum_valid"),
            _pct(F.col("n"), F.col("_total")).alias("pct_total"),
            _pct(F.col("_cum"), F.col("_total")).alias("cum_total"),
        )
    )
    gone = F.col("_total") - F.col("_valid")
    none, whole = F.lit(None).cast("double"), F.lit(100.0)
    text = F.lit(None).cast("string")
    ends = totals.select(
        "variable",
        F.inline(
            F.array(
                F.struct(
                    F.lit("missing").alias("kind"), text.alias("value"), gone.alias("n"),
                    none.alias("pct_valid"), none.alias("cum_valid"),
                    _pct(gone, F.col("_total")).alias("pct_total"), whole.alias("cum_total"),
                ),
                F.struct(
                    F.lit("total").alias("kind"), text.alias("value"), F.col("_total").alias("n"),
                    whole.alias("pct_valid"), whole.alias("cum_valid"),
                    whole.alias("pct_total"), whole.alias("cum_total"),
                ),
            )
        ),
    )
    return values.unionByName(ends)


def freq(df: DataFrame, col: str, min_rows: int | None = None) -> DataFrame:
    """Frequency table of one column."""
    return freq_multi(df, [col], min_rows).drop("variable")


def count_table(df: DataFrame, col: str) -> DataFrame:
    """Plain counts of present values."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def na_subset_freq(df: DataFrame, col: str, cond: Column) -> DataFrame:
    """Frequency table of a subset; rows with a missing condition count as missing."""
    return freq(na_subset(df, col, cond), col)


def crosstab(df: DataFrame, row: str, col: str, by: Iterable[str] = ()) -> DataFrame:
    """Counts and row percents with margins, a missing value being its own level.

    ``margin``: cell, row_total, col_total or grand_total.
    """
    by = list(by)
    counts = df.groupBy(*by, row, col).agg(F.count(F.lit(1)).alias("n"))
    sets = [[*by, row, col], [*by, row], [*by, col], by]
    cells = counts.groupingSets([[F.col(c) for c in s] for s in sets], *by, row, col).agg(
        F.sum("n").alias("n"), F.grouping(row).alias("_gr"), F.grouping(col).alias("_gc")
    )
    same_row = Window.partitionBy(*by, "_gr", row)
    row_total = F.max(F.when(F.col("_gc") == 1, F.col("n"))).over(same_row)
    margin = (
        F.when((F.col("_gr") == 0) & (F.col("_gc") == 0), "cell")
        .when(F.col("_gr") == 0, "row_total")
        .when(F.col("_gc") == 0, "col_total")
        .otherwise("grand_total")
    )
    return cells.select(
        *by, row, col, "n", _pct(F.col("n"), row_total).alias("row_pct"), margin.alias("margin")
    )


def crosstab_subset(df: DataFrame, row: str, col: str, cond: Column) -> DataFrame:
    """Cross-tab of a subset; rows with a missing condition count as missing on both sides."""
    return crosstab(na_subset(df, [row, col], cond), row, col)


LOG_BINS = 1024  # first round: bins per doubling
LINE_BINS = 1 << 22  # second and third round: bins between the least and the largest value of a bin


def _log_bin(value: Column) -> Column:
    """A whole number that never falls as the value grows: 1,024 bins per doubling on both sides of zero, NaN last."""
    size = F.abs(value)
    bin_ = (F.floor(F.log2(size) * LOG_BINS) + 1_200_000) * F.signum(value).cast("bigint")
    return F.when(F.isnan(value), F.lit(1 << 41)).when(size == float("inf"), F.signum(value).cast("bigint") * (1 << 40)).when(value == 0, F.lit(0)).otherwise(bin_)


def _line_bin(value: Column, low: Column, high: Column) -> Column:
    return F.when(low < high, F.floor((value - low) / (high - low) * LINE_BINS)).otherwise(F.lit(0)).cast("bigint")


def _narrowed(rows: DataFrame, keys: list[str], name: str, carried: list[str]) -> DataFrame:
    """One histogram over ``name`` within ``keys``: the bins that hold a wanted rank, with the ranks counted in them.

    ``_wanted`` (name, side, share, rank) belongs to the keys and is grouped by, so that it needs no join back.
    """
    low, high = F.min("value").alias(f"{name}_low"), F.max("value").alias(f"{name}_high")
    hist = rows.groupBy(*keys, *carried, name).agg(F.count(F.lit(1)).alias("_n"), low, high)
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    hist = hist.withColumns({"_upto": upto, "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    return hist


def _in_bin(hist: DataFrame, wanted: str) -> DataFrame:
    """Keep of ``wanted`` what lies in the bin, ranks counted from its start."""
    start = "(_upto - _n)"
    inside = f"filter({wanted}, t -> t.rank >= {start} AND t.rank < _upto)"
    found = f"transform({inside}, t -> named_struct('name', t.name, 'side', t.side, 'share', t.share, 'rank', t.rank - {start}))"
    return hist.withColumn("_wanted", F.expr(found)).filter("size(_wanted) > 0").drop("_n", "_upto", "_all")


def _quantiles(values: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per variable of a (variable, value) table of present values.

    Every wanted order statistic is narrowed down by three histograms, each one map-side aggregate: bins of equal ratio, then
    bins between the least and the largest value of the bin that holds the rank, twice. A bin of the third is one double: a
    first bin spans fewer than 2^43 of them. Only rows of the few bins that hold a rank go into the later rounds; the windows
    run over bins.
    """
    values = values.withColumn("_b1", _log_bin(F.col("value")))
    first = _narrowed(values, ["variable"], "_b1", [])
    ranks = ", ".join(
        f"named_struct('name', '{name}', 'side', '{side}', 'share', (_all - 1) * {p}D - floor((_all - 1) * {p}D), 'rank', {side}((_all - 1) * {p}D))"
        for name, p in probs.items() for side in ("floor", "ceil")
    )
    bins = _in_bin(first, f"array({ranks})")
    keys, ends = ["variable", "_b1"], ["_b1_low", "_b1_high"]
    for name in ("_b2", "_b3"):
        # Two bins per variable and quantile at most.
        rows = values.join(F.broadcast(bins), ["variable", "_b1"])
        if name == "_b3":
            rows = rows.filter(F.col("_b2") == _line_bin(F.col("value"), F.col("_b1_low"), F.col("_b1_high")))
        rows = rows.withColumn(name, _line_bin(F.col("value"), F.col(ends[-2]), F.col(ends[-1])))
        bins = _in_bin(_narrowed(rows, keys, name, [*ends, "_wanted"]), "_wanted")
        keys, ends = [*keys, name], [*ends, f"{name}_low", f"{name}_high"]
    found = bins.select("variable", F.col("_b3_low").alias("value"), F.inline("_wanted"))

    def at(name, side):
        return F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("value")))

    def share(name):
        return F.max(F.when(F.col("name") == name, F.col("share")))

    return found.groupBy("variable").agg(*[
        (at(n, "floor") + F.when(share(n) > 0, (at(n, "ceil") - at(n, "floor")) * share(n)).otherwise(0.0)).alias(n) for n in probs
    ])


def describe_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Descriptives, one row per column: moments, quartiles, MAD, IQR, CV, valid share.

    The input is read once for the moments and three times each for the quartiles and the MAD, by map-side aggregates only.
    """
    cols = list(cols)
    moments = {
        "mean": F.avg, "std_dev": F.stddev_samp, "min": F.min, "max": F.max,
        "skewness": F.skewness, "kurtosis": F.kurtosis,
    }
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[fn(F.col(c).cast("double")).alias(f"{c}|{m}") for c in cols for m, fn in moments.items()],
        *[F.count(c).alias(f"{c}|n_valid") for c in cols],
    )
    per_col = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("variable"),
                        *[F.col(f"`{c}|{m}`").alias(m) for m in [*moments, "n_valid"]],
                        (F.col(f"`{c}|n_valid`") * 100.0 / F.col("_rows")).alias("pct_valid"),
                    )
                    for c in cols
                ]
            )
        )
    )
    plain = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    values = plain.unpivot([], cols, "variable", "value").filter(F.col("value").isNotNull())
    quartiles = _quantiles(values, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    off = F.abs(F.col("value") - F.col("median")).alias("value")
    mad = _quantiles(values.join(F.broadcast(quartiles.select("variable", "median")), "variable").select("variable", off), {"mad": 0.5})
    out = per_col.join(F.broadcast(quartiles), "variable", "left").join(F.broadcast(mad), "variable", "left")
    return out.withColumns(
        {
            "mad": F.col("mad") * MAD_SCALE,
            "iqr": F.col("q3") - F.col("q1"),
            "cv": F.try_divide(F.col("std_dev"), F.col("mean")),
        }
    )


HEAD = 64  # characters of a value that its profile is grouped and ordered by


def profile_table(df: DataFrame, top: int = 10) -> DataFrame:
    """Whole-table profile: per column its type, counts and range, with its ``top`` most frequent values as rows and one
    row without rank and value for all others (``value_n`` rows, ``n_values`` values).

    Values are counted by their beginning and a 128-bit digest, so long texts are not shuffled; only those of the most frequent
    digests are read again. Equal counts are ordered by the first ``HEAD`` characters, then by digest.
    """
    cols = df.columns
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    digest = {"_d1": F.xxhash64("value"), "_d2": F.xxhash64(F.lit(1), "value")}
    key = ["variable", "_there", "_d1", "_d2"]
    long = long.withColumns({**digest, "_there": F.col("value").isNotNull()})
    counts = long.select(*key, F.substring("value", 1, HEAD).alias("_head")).groupBy(*key, "_head").agg(F.count(F.lit(1)).alias("n"))
    number = F.when(F.col("variable").isin(sorted(numeric)), F.col("_head").try_cast("double"))
    there = F.col("_there")
    summary = counts.groupBy("variable").agg(
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count_if(there).alias("n_distinct"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.try_divide(F.sum(number * F.col("n")), F.sum(F.when(number.isNotNull(), F.col("n")))).alias("mean"),
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    type_map = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    # Missing last instead of filtered first, so that both tables share one aggregate.
    by_count = Window.partitionBy("variable").orderBy(F.col("_there").desc(), F.col("n").desc(), "_head", "_d1", "_d2")
    best = counts.withColumn("rank", F.row_number().over(by_count)).filter((F.col("rank") <= top) & there)
    # ``top`` rows per column: small enough to send to every task.
    texts = long.filter(there).join(F.broadcast(best.select(*key, "rank", "n")), key)
    best = texts.groupBy("variable", "rank", "n").agg(F.min("value").alias("value"))
    row = F.struct("rank", "value", F.col("n").alias("value_n"), F.lit(1).cast("bigint").alias("n_values"))
    best = best.groupBy("variable").agg(
        F.sum("n").alias("_shown"), F.count(F.lit(1)).alias("_rows"), F.sort_array(F.collect_list(row)).alias("_best")
    )
    number, text = F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("value")
    none = F.lit(None).cast("bigint")
    others = F.struct(
        number, text, (F.col("n_valid") - F.col("_shown")).alias("value_n"), (F.col("n_distinct") - F.col("_rows")).alias("n_values")
    )
    more = F.when(F.col("n_distinct") > F.col("_rows"), F.array(others)).otherwise(F.array().cast("array<struct<rank:int,value:string,value_n:bigint,n_values:bigint>>"))
    empty = F.array(F.struct(number, text, none.alias("value_n"), none.alias("n_values")))
    out = summary.withColumn("type", type_map[F.col("variable")]).join(best, "variable", "left")
    shown = F.when(F.col("_best").isNull(), empty).otherwise(F.concat("_best", more))
    return out.select(*summary.columns, "type", F.inline(shown))


def multi_flag_means(df: DataFrame, flags: Iterable[str], na: str = "skip") -> DataFrame:
    """Mean of each flag; with ``na='propagate'`` a column with a missing value has no mean."""
    flags = list(flags)

    def mean(c):
        return F.avg(c) if na == "skip" else F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))

    return df.agg(*[mean(c).alias(c) for c in flags]).unpivot([], flags, "variable", "mean")


def numeric_totals(df: DataFrame) -> DataFrame:
    """Sum of every numeric column, missing values left out; one row."""
    return df.agg(*[F.sum(f.name).alias(f.name) for f in df.schema if isinstance(f.dataType, T.NumericType)])


def distinct_keys(df: DataFrame, key: str | Iterable[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys).distinct()


def completeness_score(df: DataFrame, items: Iterable[str], need: int, out: str) -> DataFrame:
    """Answered items, whether at least ``need`` are, and the sum if all are."""
    cols = [F.col(c) for c in items]
    n = answered(cols)
    return df.withColumns(
        {
            f"{out}_n": n,
            f"{out}_enough": flag(n >= need),
            f"{out}_sum": F.when(n == len(cols), reduce(add, cols)),
        }
    )


def nps_flags(df: DataFrame, col: str, missing_detractor_as_no: bool = False, zero_is_detractor: bool = False) -> DataFrame:
    """Promoter (9-10) and detractor flags; missing if unanswered.

    A 0 is no detractor unless asked for. ``missing_detractor_as_no`` counts an
    unanswered question as no detractor.
    """
    c = F.col(col)
    low = range(0 if zero_is_detractor else 1, 7)
    detractor = F.when(isin0(c, low), 1)
    detractor = detractor.otherwise(0) if missing_detractor_as_no else detractor.when(c.isNotNull(), 0)
    return df.withColumns(
        {"promoter": F.when(c.isin(9, 10), 1).when(c.isNotNull(), 0), "detractor": detractor}
    )


def nps_score(df: DataFrame, col: str, key: str | None = None, **options) -> DataFrame:
    """Answers, promoter and detractor shares and their difference in percent points."""
    keys = [key] if key else []
    return (
        nps_flags(df, col, **options)
        .groupBy(*keys)
        .agg(
            F.count(col).alias("n_answered"),
            F.sum("promoter").alias("promoters"),
            F.sum("detractor").alias("detractors"),
            F.avg("promoter").alias("promoter_share"),
            F.avg("detractor").alias("detractor_share"),
            ((F.avg("promoter") - F.avg("detractor")) * 100).alias("nps"),
        )
    )
