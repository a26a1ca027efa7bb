"""Chi-square and exact tests on two-way tables, per stratum in one job.

Only collapsed counts reach the tests. Rows with a missing level are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators.skew import quoted

TIE_TOLERANCE = 1e-7  # fixed value: relative slack when comparing table probabilities
BLOCK = 4096  # fills of the smallest rows generated per row of the second expansion


def _strata(df: DataFrame, row: str, col: str, by: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Counts by stratum and cell; without strata a constant one is added."""
    by = list(by)
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    counts = (
        df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(*by, F.col(row).alias("_row"), F.col(col).alias("_col"))
        .agg(F.count(F.lit(1)).alias("_o"))
    )
    return counts, by


def _log_gamma_half(k: str) -> str:
    """SQL text for ln Gamma(k / 2 + 1) of a whole ``k``, by Stirling's series eight steps up."""
    x = f"({k} / 2D + 9)"
    up = " * ".join(f"({x} - {i})" for i in range(1, 9))
    series = f"1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)) - 1 / (1680 * pow({x}, 7)) + 1 / (1188 * pow({x}, 9))"
    return f"(({x} - 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + {series} - ln({up}))"


def chi2_tail(stat: str, dof: str) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom: the regularised incomplete gamma function.

    Below the mean its power series, above it its continued fraction, read from the far end; both are folds over a list of
    steps. The steps grow with the root of the argument, which is enough for doubles.
    """
    a, h = f"({dof} / 2D)", f"({stat} / 2D)"
    scale = f"exp({a} * ln({h}) - {h} - {_log_gamma_half(dof)})"
    steps = f"(200 + CAST(10 * sqrt({h} + {a}) AS INT))"
    series = f"aggregate(sequence(1, {steps}), named_struct('term', 1D, 'sum', 1D), (_f, _i) -> named_struct('term', _f.term * {h} / ({a} + _i), 'sum', _f.sum + _f.term * {h} / ({a} + _i))).sum"
    fraction = f"aggregate(sequence({steps}, 1, -1), {h} + 2 * {steps} + 3 - {a}, (_f, _i) -> {h} + 2 * _i - 1 - {a} - _i * (_i - {a}) / _f)"
    low, high = f"1 - {scale} * {series}", f"{scale} * {a} / ({fraction})"
    return F.expr(
        f"CASE WHEN {stat} IS NULL OR {dof} < 1 OR isnan({stat}) OR {stat} < 0 THEN CAST(null AS DOUBLE) WHEN {stat} = 0 THEN 1D "
        f"WHEN {h} < {a} + 1 THEN greatest(0D, least(1D, {low})) ELSE greatest(0D, least(1D, {high})) END"
    )


def chi_square(df: DataFrame, row: str, col: str, by: Iterable[str] = ()) -> DataFrame:
    """Pearson test of independence: n, stat, dof, p. Continuity correction for 2x2 tables only.

    ``sum((o-e)^2/e) = n (sum o^2 / (R C) - 1)``, so empty cells need no rows.
    A table with a single row or column level has no test. The input is read
    once; the windows run over the cells of one contingency table.
    """
    cells, keys = _strata(df, row, col, by)
    in_row, in_col = Window.partitionBy(*keys, "_row"), Window.partitionBy(*keys, "_col")
    cells = cells.withColumns(
        {
            "_r": F.sum("_o").over(in_row),
            "_c": F.sum("_o").over(in_col),
            "_n": F.sum("_o").over(Window.partitionBy(*keys)),
            "_new_row": F.row_number().over(in_row.orderBy("_col")) == 1,
            "_new_col": F.row_number().over(in_col.orderBy("_row")) == 1,
        }
    )
    o, r, c, n = (F.col(x).cast("double") for x in ("_o", "_r", "_c", "_n"))
    gap = F.abs(o - r * c / n)
    terms = cells.groupBy(*keys).agg(
        F.sum(o * o / (r * c)).alias("_s"),
        F.max(gap).alias("_gap"),
        F.first("_n").alias("_n"),
        F.count_if("_new_row").alias("_nr"),
        F.count_if("_new_col").alias("_nc"),
        # Logs of both row (column) totals add up to the log of their product in a 2x2 table.
        F.sum(F.when(F.col("_new_row"), F.log("_r"))).alias("_lr"),
        F.sum(F.when(F.col("_new_col"), F.log("_c"))).alias("_lc"),
    )
    plain = n * (F.col("_s") - 1)
    # In a 2x2 table every cell has the same gap, and sum(1/e) = n^3 / (R1 R2 C1 C2).
    held = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    yates = held * held * F.exp(3 * F.log(n) - F.col("_lr") - F.col("_lc"))
    two = (F.col("_nr") == 2) & (F.col("_nc") == 2)
    testable = (F.col("_nr") > 1) & (F.col("_nc") > 1)
    out = terms.select(
        *keys,
        F.col("_n").alias("n"),
        F.when(testable, F.when(two, yates).otherwise(F.greatest(plain, F.lit(0.0)))).alias("stat"),
        F.when(testable, (F.col("_nr") - 1) * (F.col("_nc") - 1)).alias("dof"),
    )
    return out.withColumn("p", chi2_tail("stat", "dof")).drop("_all")


def log_factorial(n: str) -> str:
    """SQL text for ln(n!): exact up to 20, Stirling's series beyond (error below 1e-14)."""
    x = f"(CAST({n} AS DOUBLE) + 1)"
    series = f"1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)) - 1 / (1680 * pow({x}, 7))"
    half_log_2pi = 0.5 * math.log(2 * math.pi)
    return (
        f"(CASE WHEN {n} <= 20 THEN ln(CAST(factorial(CAST(least({n}, 20) AS INT)) AS DOUBLE)) "
        f"ELSE ({x} - 0.5D) * ln({x}) - {x} + {half_log_2pi!r}D + {series} END)"
    )


def log_choose(n: str, k: str) -> str:
    """SQL text for the log of a binomial coefficient."""
    return f"({log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')})"


def _tables(df: DataFrame, row: str, col: str, by: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """One row per stratum: its table as (row total, count in the first column) pairs, smallest row first.

    Holds one pair per level of the row variable, whatever the number of rows.
    """
    cells, keys = _strata(df, row, col, by)
    stratum = Window.partitionBy(*keys)
    cells = cells.withColumns({"_lo": F.min("_col").over(stratum), "_hi": F.max("_col").over(stratum)})
    lines = cells.groupBy(*keys, "_row").agg(
        F.sum("_o").alias("total"),
        F.sum(F.when(F.col("_col") == F.col("_lo"), F.col("_o")).otherwise(0)).alias("a"),
        F.max((F.col("_col") != F.col("_lo")) & (F.col("_col") != F.col("_hi"))).alias("_third"),
        F.first(F.col("_lo") != F.col("_hi")).alias("_two"),
    )
    tables = lines.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("total", "a"))).alias("_lines"),
        F.sum("total").alias("_n"),
        F.sum("a").alias("_k"),
        (F.first("_two") & ~F.max("_third") & (F.count(F.lit(1)) > 1)).alias("_tested"),
        F.sum(F.expr(log_choose("total", "a"))).alias("_log_obs"),
    )
    return tables.withColumn("_log_obs", F.col("_log_obs") - F.expr(log_choose("_n", "_k"))), keys


STEPS = 2  # rows that are filled one by one, before the four largest ones
CHILDREN = 1 << 19  # fills that a task holds at a time
WIDTH = 64  # counts of the lower pair that make one row of work
HELD = 1 << 22  # entries of pair tables that a task keeps
TOTALS = [f"_t{i}" for i in range(STEPS + 4)]
NODE = {"_limit": "double", **dict.fromkeys(["_n", "_k", *TOTALS, "m"], "bigint"), "past": "double", "mass": "double"}
WORK = {**NODE, "c": "bigint", "width": "bigint"}


def _log_fact(n: np.ndarray) -> np.ndarray:
    """ln(n!) by Stirling's series eight steps up, where its error is below 1e-13."""
    x = n + 9.0
    y = (x - 4.5) ** 2
    up = (y - 0.25) * (y - 2.25) * (y - 6.25) * (y - 12.25)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - np.log(up)


def _log_ways(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _log_fact(n) - _log_fact(k) - _log_fact(n - k)


def _best_fill(totals: list[np.ndarray], m: np.ndarray) -> np.ndarray:
    """Upper bounds of the log weight of any fill of rows with these totals whose counts add up to ``m``.

    The sum of the best single terms at the multiplier that belongs to the share of ``m``; no fill weighs more.
    """
    whole = sum(totals)
    share = m / np.maximum(whole, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where((m > 0) & (m < whole), np.log(share / (1 - share)), 0.0)
    best = -m * slope
    for t in totals:
        b = np.minimum(t, np.floor((t + 1) * share))
        best = best + _log_ways(t, b) + b * slope
    return best


def _span(total: np.ndarray, rest: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last count that a row can take if ``m`` are left for it and the ``rest``.

    Counts more than 20 roots from the mean have a share below exp(-800) (Hoeffding), which is no double.
    """
    mean = total * (m / np.maximum(total + rest, 1))
    reach = 20 * np.sqrt(np.minimum(np.minimum(m, total), np.minimum(rest, total + rest - m))) + 2
    low = np.maximum(np.maximum(0, m - rest), np.floor(mean - reach))
    return low.astype(np.int64), np.minimum(np.minimum(total, m), np.ceil(mean + reach)).astype(np.int64)


def _parts(sizes: np.ndarray):
    """Slices of rows of which each makes ``CHILDREN`` fills or so."""
    group = (np.cumsum(sizes) - sizes) // CHILDREN
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(sizes) else []
    yield from (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True))


def _choices(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and count of every choice."""
    row = np.repeat(np.arange(len(size)), size)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _with(batch: pa.RecordBatch, rows: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    picked = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], picked.schema.field(n).type) if n in columns else picked.column(n) for n in picked.schema.names], picked.schema.names
    )


def _read(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _filled(step: int):
    """Fill row ``step`` of every open node; a node's closed children become one row with their ``mass``."""

    def run(batches):
        for whole in batches:
            is_open = whole.column("mass").is_null().to_numpy(zero_copy_only=False)
            yield whole.filter(pa.array(~is_open))
            batch = whole.filter(pa.array(is_open))
            n, k, limit, m, past = _read(batch, "_n", "_k", "_limit", "m", "past")
            totals = _read(batch, *TOTALS[step:])
            low, high = _span(totals[0], sum(totals[1:]), m)
            for part in _parts(high - low + 1):
                row, a = _choices(low[part], (high - low + 1)[part])
                row = row + part.start
                rest, left = [t[row] for t in totals[1:]], m[row] - a
                logw = past[row] + _log_ways(totals[0][row], a)
                closed = logw + _best_fill(rest, left) <= limit[row]
                share = np.exp(logw + _log_ways(sum(rest), left) - _log_ways(n[row], k[row])) * closed
                parents = np.arange(part.start, part.stop)
                mass = np.bincount(row - part.start, share, len(parents))
                yield _with(batch, parents, mass=mass)
                yield _with(batch, row[~closed], m=left[~closed], past=logw[~closed])

    return run


def _started(batches):
    """Fills of the rows beyond the ``STEPS + 4`` largest: ``_id`` counts through all of them in mixed radix."""
    for batch in batches:
        heads = batch.column("_head").to_pylist()
        rest, limit_k = (x.copy() for x in _read(batch, "_id", "_k"))
        past, left = np.zeros(len(rest)), limit_k
        for i in range(max(map(len, heads), default=0)):
            total = np.array([h[i] if i < len(h) else 0 for h in heads])
            digit = rest % (total + 1)
            rest, left, past = rest // (total + 1), left - digit, past + _log_ways(total, digit)
        size = sum(_read(batch, *TOTALS))
        names = [n for n in batch.schema.names if n not in ("_head", "_id")]
        out = pa.RecordBatch.from_arrays([batch.column(n) for n in names], names)
        yield _with(out, np.flatnonzero((left >= 0) & (left <= size)), **{
            c: v[(left >= 0) & (left <= size)] for c, v in (("m", left), ("past", past))
        })


def _sized(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Per table the totals of its six largest rows, ascending (zero where it has fewer), ``_head`` with those of any smaller
    rows, and the log weight ``_limit`` up to which tables count."""
    last = len(TOTALS)
    tail = f"slice(concat(array_repeat(0L, {last}), _lines.total), -{last}, {last})"
    return tables.selectExpr(
        *[quoted(k) for k in keys], f"_log_obs + {log_choose('_n', '_k')} + {math.log1p(TIE_TOLERANCE)!r}D AS _limit", "_n", "_k",
        *[f"{tail}[{i}] AS {t}" for i, t in enumerate(TOTALS)], "0L AS m", "0D AS past", "CAST(null AS DOUBLE) AS mass",
        f"slice(_lines.total, 1, greatest(size(_lines) - {last}, 0)) AS _head",
    )


def _schema(df: DataFrame, keys: list[str], more: dict[str, str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{quoted(n)} {t}" for n, t in {**{k: types[k] for k in keys}, **more}.items())


def _open_fills(sized: DataFrame, keys: list[str]) -> DataFrame:
    """Fills of all rows but the four largest: count ``m`` left for those, log weight ``past``, and ``mass``.

    Rows are filled one by one, smallest first. A partial fill is closed as soon as even its best completion is no likelier
    than the observed table: then all completions count, and ``mass`` is their share of all tables. Open fills (``mass``
    missing) go on. Of more than six rows the smallest are first filled in every way.
    """
    schema = _schema(sized, keys, NODE)
    space = "aggregate(_head, 1L, (acc, t) -> acc * (t + 1))"
    nodes = sized.selectExpr("*", f"explode(sequence(0L, floor(({space} - 1) / {BLOCK}))) AS _block", f"{space} AS _space")
    nodes = nodes.repartition(*keys, "_block").selectExpr("*", f"explode(sequence(_block * {BLOCK}, least((_block + 1) * {BLOCK}, _space) - 1)) AS _id")
    nodes = nodes.drop("_block", "_space").mapInArrow(_started, schema)
    for step in range(STEPS):
        nodes = nodes.mapInArrow(_filled(step), schema)
    return nodes


def _paired(batches):
    """Deal the count of an open fill to the lower and the upper pair of the four largest rows. Counts whose best completion is
    no likelier than the observed table are closed into ``mass``; runs of open counts of the lower pair, up to ``WIDTH``
    from ``c`` on, become rows of work."""
    for whole in batches:
        names = [*whole.schema.names, "c", "width"]

        def sent(rows, c, width, names=names):
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(c, pa.int64()), pa.array(width, pa.int64())], names)

        is_open = whole.column("mass").is_null().to_numpy(zero_copy_only=False)
        done, batch = whole.filter(pa.array(~is_open)), whole.filter(pa.array(is_open))
        yield sent(done, np.zeros(len(done), np.int64), np.zeros(len(done), np.int64))
        n, k, limit, m, past = _read(batch, "_n", "_k", "_limit", "m", "past")
        t = _read(batch, *TOTALS[-4:])
        lower, upper = t[0] + t[1], t[2] + t[3]
        low, high = _span(lower, upper, m)
        for part in _parts(high - low + 1):
            row, c = _choices(low[part], (high - low + 1)[part])
            row = row + part.start
            left = m[row] - c
            best = past[row] + _best_fill([x[row] for x in t[:2]], c) + _best_fill([x[row] for x in t[2:]], left)
            closed = best <= limit[row]
            share = np.exp(past[row] + _log_ways(lower[row], c) + _log_ways(upper[row], left) - _log_ways(n[row], k[row])) * closed
            parents = np.arange(part.start, part.stop)
            yield sent(_with(batch, parents, mass=np.bincount(row - part.start, share, len(parents))), 0 * parents, 0 * parents)
            row, c = row[~closed], c[~closed]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (c[1:] != c[:-1] + 1) | (c[1:] % WIDTH == 0)][: len(row)])
            yield sent(batch.take(pa.array(row[first])), c[first], np.diff(np.r_[first, len(row)]))


def _pair_table(one: int, two: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every fill of two rows with ``m`` between them: log weights, ascending, shares of all, and shares below each."""
    low, high = _span(np.array([one]), np.array([two]), np.array([m]))
    a = np.arange(low[0], high[0] + 1)
    at = _log_ways(np.full(len(a), one), a) + _log_ways(np.full(len(a), two), m - a)
    at = np.sort(at)
    share = np.exp(at - _log_ways(np.array([one + two]), np.array([m])))
    return at, share, np.r_[0.0, np.cumsum(share)]


def _weighed(batches):
    """Share ``_p`` of all tables that the rows' completions no likelier than the observed table have.

    For one count of either pair, a fill of the lower pair asks for the shares of all fills of the upper one that bring
    the table to no more than the observed weight: a running sum over the upper pair's weights in order.
    """
    tables, held = {}, 0
    for batch in batches:
        n, k, limit, m, past, first, width = _read(batch, "_n", "_k", "_limit", "m", "past", "c", "width")
        totals = np.column_stack(_read(batch, *TOTALS[-4:]))
        mass = np.array(_read(batch.select(["mass"]), "mass")[0], float)
        for i in np.flatnonzero(width).tolist():
            c = np.arange(first[i], first[i] + width[i])
            t = [np.full(len(c), x) for x in (totals[i, 0] + totals[i, 1], totals[i, 2] + totals[i, 3], n[i], k[i])]
            share = np.exp(past[i] + _log_ways(t[0], c) + _log_ways(t[1], m[i] - c) - _log_ways(t[2], t[3]))
            total, free = 0.0, limit[i] - past[i]
            for count, weight in zip(c.tolist(), share.tolist(), strict=True):
                sides = []
                for key in ((*totals[i, :2].tolist(), count), (*totals[i, 2:].tolist(), int(m[i]) - count)):
                    if key not in tables:
                        if held > HELD:
                            tables, held = {}, 0
                        tables[key] = _pair_table(*key)
                        held += len(tables[key][0])
                    sides.append(tables[key])
                (at, share_at, below_at), (upper, _, below) = sides
                shut = int(np.searchsorted(at, free - upper[-1], "right"))
                found = below[np.searchsorted(upper, free - at[shut:], "right")]
                total += weight * (below_at[shut] + float(share_at[shut:] @ found))
            mass[i] = total
        names = [x for x in batch.schema.names if x not in WORK or x == "_n"]
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(mass)], [*names, "_p"])


def _exact_part(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of probabilities of all tables no likelier than the observed one.

    Closed fills bring their share. The four largest rows are never filled per row of a frame: a row of work is an open
    fill of the others and a few counts of the lower pair, and tasks that share counts share the tables of both pairs.
    """
    sized = _sized(tables, keys)
    parts = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A few rows carry the work, so their number and not their bytes must spread it.
    nodes = _open_fills(sized, keys).repartition(parts, *keys, "m", "past")
    work = nodes.mapInArrow(_paired, _schema(sized, keys, WORK))
    place = [*keys, F.expr(f"c div {WIDTH}"), F.expr(f"m div {WIDTH}")]
    work = work.repartition(parts, *place).sortWithinPartitions(*place)
    found = work.mapInArrow(_weighed, _schema(sized, keys, {"_n": "bigint", "_p": "double"}))
    return found.groupBy(*keys).agg(F.first("_n").alias("n"), F.least(F.sum("_p"), F.lit(1.0)).alias("p")).withColumn("method", F.lit("exact"))


DRAWS_PER_TASK = 100


@F.pandas_udf(T.LongType())
def _hits(totals: pd.Series, k: pd.Series, log_obs: pd.Series, block: pd.Series, seed: pd.Series) -> pd.Series:
    """Random tables with the given margins that are no likelier than the observed one, out of one block of draws."""
    log_fact = np.vectorize(lambda v: math.lgamma(v + 1.0), otypes=[float])
    out = []
    for sizes, first, obs, b, s in zip(totals, k, log_obs, block, seed, strict=True):
        sizes = np.asarray(sizes, dtype="int64")
        rng = np.random.default_rng([int(s), int(b)])
        rest, left = int(sizes.sum()), np.full(DRAWS_PER_TASK, int(first))
        logp = np.full(DRAWS_PER_TASK, -math.lgamma(rest + 1) + math.lgamma(first + 1) + math.lgamma(rest - first + 1))
        for size in sizes:
            rest -= int(size)
            a = rng.hypergeometric(int(size), rest, left) if rest else left
            logp += math.lgamma(size + 1) - log_fact(a) - log_fact(size - a)
            left = left - a
        out.append(int((logp <= obs + TIE_TOLERANCE).sum()))
    return pd.Series(out, dtype="int64")


def _simulated_part(tables: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """Permutation estimate ``(1 + hits) / (1 + draws)`` from random tables with the same margins."""
    n_blocks = math.ceil(draws / DRAWS_PER_TASK)
    runs = tables.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    totals = F.transform("_lines", lambda x: x["total"])
    return (
        runs.repartition(*keys, "_block")
        .withColumn("_hits", _hits(totals, F.col("_k"), F.col("_log_obs"), F.col("_block"), F.lit(seed)))
        .groupBy(*keys)
        .agg(F.sum("_hits").alias("_hits"), F.first("_n").alias("n"))
        .select(
            *keys, "n",
            ((F.col("_hits") + 1) / F.lit(n_blocks * DRAWS_PER_TASK + 1.0)).alias("p"),
            F.lit("simulated").alias("method"),
        )
    )


def fisher_exact(
    df: DataFrame, row: str, col: str, by: Iterable[str] = (), method: str = "exact", draws: int = 2000, seed: int = 1
) -> DataFrame:
    """Exact test of an r x 2 table: n, p, method.

    ``exact`` fills the rows one by one and closes every partial fill that its bounds settle, so it visits the partial tables
    likelier than the observed one in all rows but two; ``simulate`` estimates p from random tables. The caller chooses; the
    size never does. A table that has not two column
    levels and at least two row levels has no p.
    """
    if method not in ("exact", "simulate"):
        raise ValueError(f"unknown method {method}")
    tables, keys = _tables(df, row, col, by)
    untested = tables.filter(~F.col("_tested")).select(
        *keys, F.col("_n").alias("n"), F.lit(None).cast("double").alias("p"), F.lit("none").alias("method")
    )
    tested = tables.filter(F.col("_tested"))
    found = _exact_part(tested, keys) if method == "exact" else _simulated_part(tested, keys, draws, seed)
    return found.unionByName(untested).drop("_all")
