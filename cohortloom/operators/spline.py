"""Penalised cubic regression spline over per-x sums, its penalty chosen by restricted maximum likelihood."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.skew import attach

#: Penalties that are tried, as powers of ten relative to the data's own weight.
PENALTIES = tuple(k / 4 for k in range(-24, 25))


def curvature_bands(pieces: int) -> np.ndarray:
    """The integral of the squared second derivative of a cubic spline on ``pieces`` unit intervals, as a form in its
    B-spline coefficients: row i holds the entries (i, i), (i, i - 1), (i, i - 2), (i, i - 3).

    The second derivative is piecewise linear with the second differences of the coefficients as its corner values.
    """
    m = pieces + 3
    differences = np.diff(np.eye(m), 2, axis=0)
    hats = np.diag([1 / 3] + [2 / 3] * (pieces - 1) + [1 / 3]) + np.diag([1 / 6] * pieces, 1) + np.diag([1 / 6] * pieces, -1)
    form = differences.T @ hats @ differences
    return np.array([[form[i, i - d] if i >= d else 0.0 for d in range(4)] for i in range(m)])


def _basis(u: Column) -> list[Column]:
    """The four cubic B-splines that are not zero on an interval, at the share ``u`` of it."""
    one = F.lit(1.0)
    return [
        (one - u) * (one - u) * (one - u) / 6, (3 * u * u * u - 6 * u * u + 4) / 6,
        (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6, u * u * u / 6,
    ]


def _placed(share: Column, pieces: int) -> tuple[Column, Column]:
    """The interval that holds a share of the range, and the place in it."""
    at = F.greatest(F.least(F.floor(share * pieces), F.lit(pieces - 1)), F.lit(0)).cast("int")
    return at, share * pieces - at


_START = "array(struct(1D as d, 0D as l1, 0D as l2, 0D as l3, 0D as z))"


def _factored(rows: Column) -> Column:
    """The banded system ``rows`` (a0..a3 and right side r) factored row by row: pivot d, the factor's entries l1..l3 left
    of the diagonal and the forward solution z. Three unit rows lie before and after, so that every row has neighbours."""
    edge = F.array_repeat(F.expr(_START)[0], 3)

    def step(done: Column, row: Column) -> Column:
        p1, p2, p3 = (F.element_at(done, -k) for k in (1, 2, 3))
        v3 = row["a3"]
        v2 = row["a2"] - v3 * p2["l1"]
        v1 = row["a1"] - v3 * p1["l2"] - v2 * p1["l1"]
        l1, l2, l3 = v1 / p1["d"], v2 / p2["d"], v3 / p3["d"]
        new = F.struct(
            (row["a0"] - v1 * l1 - v2 * l2 - v3 * l3).alias("d"), l1.alias("l1"), l2.alias("l2"), l3.alias("l3"),
            (row["r"] - l1 * p1["z"] - l2 * p2["z"] - l3 * p3["z"]).alias("z"),
        )
        return F.concat(done, F.array(new))

    return F.concat(F.aggregate(rows, edge, step), edge)


def _solved(factor: Column, m: int) -> Column:
    """The coefficients behind ``_factored``, by going backwards through its rows."""

    def step(have: Column, i: Column) -> Column:  # have: coefficients i + 1, i + 2, ... in this order
        row, n1, n2, n3 = (F.element_at(factor, i + 3 + k) for k in range(4))
        value = row["z"] / row["d"] - n1["l1"] * have[0] - n2["l2"] * have[1] - n3["l3"] * have[2]
        return F.concat(F.array(value), have)

    back = F.sequence(F.lit(m), F.lit(1), F.lit(-1))
    return F.slice(F.aggregate(back, F.array_repeat(F.lit(0.0), 3), step), 1, m)


def _length(factor: Column, at: Column, values: Column, m: int) -> Column:
    """b' A^-1 b for the four ``values`` of b from place ``at`` (from 0) on, A being the factored matrix."""

    def step(state: Column, i: Column) -> Column:
        row, w = F.element_at(factor, i + 3), state["w"]
        own = F.coalesce(F.get(values, i - 1 - at), F.lit(0.0))
        new = own - row["l1"] * w[0] - row["l2"] * w[1] - row["l3"] * w[2]
        return F.struct(F.array(new, w[0], w[1]).alias("w"), (state["sum"] + new * new / row["d"]).alias("sum"))

    start = F.struct(F.array_repeat(F.lit(0.0), 3).alias("w"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(m)), start, step, lambda s: s["sum"])


def spline_trend(
    df: DataFrame, x: str, y: str, by: Iterable[str] = (), pieces: int = 10, grid: int = 80, se: bool = False,
    penalties: Iterable[float] = PENALTIES,
) -> DataFrame:
    """Penalised cubic regression spline of ``y`` on ``x``, on an even grid over the range of ``x``.

    Rows collapse to (count, sum, sum of squares) per x and these to the banded normal equations of the B-splines on
    ``pieces`` equal intervals, one row per group. Each penalty of the grid is a row of its own: the banded system is
    factored in columns, and the penalty with the highest restricted likelihood gives the curve (the larger of equals). The
    penalty weighs the integrated squared second derivative, so a straight line costs nothing. With ``se`` there is a
    column ``se``, from the posterior variance at that penalty.

    Null x or y take no part; fewer than three distinct x give no value. An empty table gives an empty result.
    """
    by = list(by)
    keys = by or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    m, bands, value = pieces + 3, curvature_bands(pieces), F.col(y).cast("double")
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sy"), F.sum(value * value).alias("_syy")
    )
    whole = Window.partitionBy(*keys)
    total = F.sum("_n").over(whole)
    points = points.withColumns({
        "_lo": F.min("_x").over(whole), "_hi": F.max("_x").over(whole), "_mean": F.sum("_sy").over(whole) / total,
        "_weeks": F.count(F.lit(1)).over(whole),
    })
    span = F.col("_hi") - F.col("_lo")
    at, u = _placed(F.when(span > 0, (F.col("_x") - F.col("_lo")) / span).otherwise(0.0), pieces)
    points = points.withColumns({"_at": at, "_u": u})
    points = points.withColumns({f"_b{k}": b for k, b in enumerate(_basis(F.col("_u")))})
    b, n, rest = [F.col(f"_b{k}") for k in range(4)], F.col("_n"), F.col("_sy") - F.col("_n") * F.col("_mean")
    cells = F.array(*[
        F.struct((F.col("_at") + k).alias("_i"), *[(n * b[k] * b[k - d] if k >= d else F.lit(0.0)).alias(f"a{d}") for d in range(4)], (rest * b[k]).alias("r"))
        for k in range(4)
    ])
    names = ["a0", "a1", "a2", "a3", "r"]
    entries = points.select(*keys, F.inline(cells)).groupBy(*keys, "_i").agg(*[F.sum(c).alias(c) for c in names])
    system = entries.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", F.struct(*names)))).alias("_cells"), F.sum("a0").alias("_trace")
    )
    zero = F.struct(*[F.lit(0.0).alias(c) for c in names])
    system = system.withColumn("_rows", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.coalesce(F.try_element_at("_cells", i), zero)))
    sums = points.groupBy(*keys, "_lo", "_hi", "_mean", "_weeks").agg(
        F.sum("_n").alias("_rowcount"), F.sum(F.col("_syy") - 2 * F.col("_mean") * F.col("_sy") + n * F.col("_mean") * F.col("_mean")).alias("_ss")
    )
    own = F.col("_trace") / F.lit(float(bands[:, 0].sum()))
    fixed = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in bands])
    tried = F.explode(F.array(*[F.lit(float(p)) for p in penalties]))
    fits = attach(system, sums, keys).filter("_weeks >= 3").withColumn("_power", tried).withColumn("_pen", F.pow(F.lit(10.0), "_power") * own)
    penalised = F.zip_with("_rows", fixed, lambda row, p: F.struct(*[(row[f"a{d}"] + F.col("_pen") * p[d]).alias(f"a{d}") for d in range(4)], row["r"].alias("r")))
    fits = fits.withColumn("_sys", penalised).withColumn("_factor", _factored(F.col("_sys")))
    inner = F.slice("_factor", 4, m)
    explained = F.aggregate(inner, F.lit(0.0), lambda have, row: have + row["z"] * row["z"] / row["d"])
    log_det = F.aggregate(inner, F.lit(0.0), lambda have, row: have + F.ln(row["d"]))
    # What is left of the squares, penalty included; never below rounding.
    left = F.greatest(F.col("_ss") - explained, F.col("_ss") * 1e-12, F.lit(1e-300))
    fits = fits.withColumns({"_left": left, "_log_det": log_det})
    score = (F.col("_rowcount") - 2) * F.ln("_left") + F.col("_log_det") - (m - 2) * F.ln("_pen")
    kept = ["_factor", "_left", "_rowcount"]
    best = fits.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(score, -F.col("_power"))).alias("_best"))
    chosen = best.select(*keys, "_best.*").withColumn("_coef", _solved(F.col("_factor"), m))
    steps = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    curve = attach(sums.select(*keys, "_lo", "_hi", "_mean"), chosen, keys).withColumn("grid_index", steps)
    share = F.col("grid_index") / F.lit(max(grid - 1, 1))
    at, u = _placed(share, pieces)
    curve = curve.withColumns({"_at": at, "_u": u})
    basis = _basis(F.col("_u"))
    fit = F.col("_mean") + sum((F.get("_coef", F.col("_at") + k) * basis[k] for k in range(4)), F.lit(0.0))
    out = [*by, "grid_index", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias(x), fit.alias(y)]
    if se:
        scale = F.col("_left") / F.when(F.col("_rowcount") > 2, F.col("_rowcount") - 2)
        curve = curve.withColumn("_b", F.array(*basis))
        out.append(F.when(F.col("_coef").isNotNull(), F.sqrt(scale * _length(F.col("_factor"), F.col("_at"), F.col("_b"), m))).alias("se"))
    return curve.select(*out)
