"""Trend series: weekly means, local regression on weekly sums, points read off the curve."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.skew import attach
from cohortloom.operators.spline import spline_trend


def weekly_mean(df: DataFrame, week: str, measures: Iterable[str]) -> DataFrame:
    """Mean and number of values of each measure by week."""
    measures = list(measures)
    plain = df.select(week, *[F.col(m).cast("double").alias(m) for m in measures])
    return (
        plain.unpivot([week], measures, "measure", "value")
        .groupBy("measure", week)
        .agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    )


def local_trend(
    df: DataFrame, x: str, y: str, by: Iterable[str] = (), span: float = 0.75, grid: int = 80, se: bool = False,
    method: str = "local",
) -> DataFrame:
    """Local quadratic regression of ``y`` on a whole-number ``x``, on an even grid over its range.

    Rows collapse to (count, sum) per x first; each x then meets the constant-size
    grid. The bandwidth of a grid point is the distance within which the nearest
    ``span`` share of all rows lies; weights are tricube. Fewer than three
    distinct x, or a degenerate neighbourhood, give no value. With ``se`` there is a column ``se``, the standard error of
    each value (see ``trend_band``). ``method="spline"`` gives the penalised spline of ``spline_trend`` instead; the caller
    chooses, never the size of the data.
    """
    by = list(by)
    if method not in ("local", "spline"):
        raise ValueError("method must be local or spline")
    if method == "spline":
        return spline_trend(df, x, y, by, grid=grid, se=se)
    if se:
        return trend_band(df, x, y, by, span, grid)
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    points = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_sy"))
    )
    whole = Window.partitionBy(*by)
    points = points.withColumns(
        {
            "_lo": F.min("_x").over(whole), "_hi": F.max("_x").over(whole),
            "_rows": F.sum("_n").over(whole), "_weeks": F.count(F.lit(1)).over(whole),
        }
    )
    at = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    pairs = points.withColumn("_g", at).withColumn(
        "_x0", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_g") / F.lit(max(grid - 1, 1))
    )
    pairs = pairs.withColumn("_d", F.abs(F.col("_x") - F.col("_x0")))
    near = Window.partitionBy(*by, "_g").orderBy("_d", "_x")
    pairs = pairs.withColumn("_within", F.sum("_n").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    need = F.greatest(F.floor(F.col("_rows") * F.lit(span) + 1e-5), F.lit(1))
    point = Window.partitionBy(*by, "_g")
    pairs = pairs.withColumn("_h", F.min(F.when(F.col("_within") >= need, F.col("_d"))).over(point))
    u = (F.col("_x") - F.col("_x0")) / F.col("_h")
    share = F.col("_d") / F.col("_h")
    weight = F.when(share < 1, F.pow(1 - F.pow(share, 3), 3)).otherwise(0.0)
    pairs = pairs.filter(F.col("_h") > 0).withColumns({"_u": u, "_w": weight})
    w, n, sy, v = (F.col(c) for c in ("_w", "_n", "_sy", "_u"))
    moments = pairs.groupBy(*by, "_g", "_x0", "_weeks").agg(
        *[F.sum(w * n * F.pow(v, k)).alias(f"s{k}") for k in range(5)],
        *[F.sum(w * sy * F.pow(v, k)).alias(f"t{k}") for k in range(3)],
    )
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    top = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    solid = (F.col("_weeks") >= 3) & (F.abs(det) > 1e-12 * F.pow(s0, 3))
    return moments.select(
        *by, F.col("_g").alias("grid_index"), F.col("_x0").alias(x), F.when(solid, top / det).alias(y)
    ).drop("_all")


def _smoothed(points: DataFrame, by: list[str], at: Column, span: float) -> DataFrame:
    """Local quadratic fits at the points of the array ``at`` (``index``, ``x0``) over (``_x``, ``_n``, ``_sy``) per x.

    ``fit``, ``norm`` (the squared length of the weights that the fit gives to the rows) and ``own`` (the weight of a row at
    the point itself).
    """
    pairs = points.select("*", F.inline(at)).withColumn("_d", F.abs(F.col("_x") - F.col("x0")))
    near = Window.partitionBy(*by, "index").orderBy("_d", "_x").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("_within", F.sum("_n").over(near))
    need = F.greatest(F.floor(F.col("_rows") * F.lit(span) + 1e-5), F.lit(1))
    point = Window.partitionBy(*by, "index")
    pairs = pairs.withColumn("_h", F.min(F.when(F.col("_within") >= need, F.col("_d"))).over(point)).filter(F.col("_h") > 0)
    share = F.col("_d") / F.col("_h")
    pairs = pairs.withColumns({
        "_u": (F.col("_x") - F.col("x0")) / F.col("_h"), "_w": F.when(share < 1, F.pow(1 - F.pow(share, 3), 3)).otherwise(0.0)
    })
    w, n, u = F.col("_w"), F.col("_n"), F.col("_u")
    pairs = pairs.withColumns({f"s{k}": F.sum(w * n * F.pow(u, k)).over(point) for k in range(5)})
    s0, s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(5))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    solid = (F.col("_weeks") >= 3) & (F.abs(det) > 1e-12 * F.pow(s0, 3))
    # The first row of the inverse of the moments gives every row's part in the fitted value.
    part = w * ((s2 * s4 - s3 * s3) - (s1 * s4 - s2 * s3) * u + (s1 * s3 - s2 * s2) * u * u) / det
    pairs = pairs.withColumn("_l", F.when(solid, part))
    return pairs.groupBy(*by, "index", "x0").agg(
        F.sum(F.col("_l") * F.col("_sy")).alias("fit"), F.sum(n * F.col("_l") * F.col("_l")).alias("norm"), F.max(F.when(F.col("_d") == 0, F.col("_l"))).alias("own")
    )


def trend_band(df: DataFrame, x: str, y: str, by: Iterable[str] = (), span: float = 0.75, grid: int = 80) -> DataFrame:
    """``local_trend`` with the standard error ``se`` of every value.

    A fitted value is a weighted sum of all rows; its variance is the residual variance times the sum of the squared weights.
    The residual variance divides the squared residuals by the trace of (I - L)(I - L)', L being the matrix of those weights.
    All of it comes from the count, the sum and the sum of squares per x: the residuals from fits at every x, of which there
    are as many as weeks.
    """
    by = list(by)
    keys = by or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    value = F.col(y).cast("double")
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sy"), F.sum(value * value).alias("_syy")
    )
    whole = Window.partitionBy(*keys)
    points = points.withColumns({
        "_lo": F.min("_x").over(whole), "_hi": F.max("_x").over(whole), "_rows": F.sum("_n").over(whole), "_weeks": F.count(F.lit(1)).over(whole),
        "_xs": F.collect_list("_x").over(whole),
    })
    step = (F.col("_hi") - F.col("_lo")) / F.lit(max(grid - 1, 1))
    even = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.struct(i.alias("index"), (F.col("_lo") + step * i).alias("x0")))
    every = F.transform("_xs", lambda v, i: F.struct(i.alias("index"), v.alias("x0")))
    curve = _smoothed(points, keys, even, span)
    at_x = _smoothed(points, keys, every, span)
    sums = points.select(*[F.col(k).alias(f"_p_{k}") for k in keys], "_x", "_n", "_sy", "_syy")
    met = at_x.join(sums, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys]) & (F.col("x0") == F.col("_x")))
    n, fit = F.col("_n"), F.col("fit")
    spread = met.groupBy(*keys).agg(
        F.sum(F.col("_syy") - 2 * fit * F.col("_sy") + n * fit * fit).alias("_rss"),
        (F.sum(n) - 2 * F.sum(n * F.col("own")) + F.sum(n * F.col("norm"))).alias("_free"),
        (F.count("fit") == F.count(F.lit(1))).alias("_full"),
    )
    variance = spread.select(*keys, F.when(F.col("_full") & (F.col("_free") > 0), F.greatest(F.col("_rss"), F.lit(0.0)) / F.col("_free")).alias("_var"))
    out = attach(curve, variance, keys)
    return out.select(*by, F.col("index").alias("grid_index"), F.col("x0").alias(x), F.col("fit").alias(y), F.sqrt(F.col("_var") * F.col("norm")).alias("se"))


def nearest_point(
    df: DataFrame, x: str, y: str, targets: Iterable[float], by: Iterable[str] = ()
) -> DataFrame:
    """Value at the point nearest to each target, the smaller point on ties."""
    by, targets = list(by), list(targets)
    picks = [
        F.struct(
            F.lit(float(t)).alias("target"),
            F.min_by(y, F.struct(F.abs(F.col(x) - F.lit(t)), F.col(x))).alias(y),
        )
        for t in targets
    ]
    return df.groupBy(*by).agg(F.array(*picks).alias("_p")).select(*by, F.inline("_p"))


def pct_change_points(
    df: DataFrame, x: str, y: str, start: float, targets: Mapping[str, float] | Iterable[float],
    by: Iterable[str] = (), scale: float | None = None,
) -> DataFrame:
    """Value at the start and at each target, with the change in percent.

    Of the start value, or with ``scale`` the value itself as percent of a scale.
    """
    by = list(by)
    targets = list(targets.values()) if isinstance(targets, Mapping) else list(targets)

    def at(t):
        return F.min_by(y, F.struct(F.abs(F.col(x) - F.lit(t)), F.col(x)))

    wide = df.groupBy(*by).agg(
        at(start).alias("start_value"),
        F.array(*[F.struct(F.lit(float(t)).alias("target"), at(t).alias("value")) for t in targets]).alias("_p"),
    )
    rows = wide.select(*by, "start_value", F.inline("_p"))
    if scale is not None:
        change = F.col("value") / F.lit(float(scale)) * 100
    else:
        change = F.try_divide(F.col("value") - F.col("start_value"), F.col("start_value")) * 100
    return rows.withColumn("pct_change", change)
