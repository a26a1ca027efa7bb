"""Per-group values on every row, picks of one row per group, and score trajectories.

Orders are given as ``[name | (name, 'desc'), ...]`` with missing values last;
the last entry should be a unique id so that picks are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.classify import day_bins
from cohortloom.functions.scalars import answered, days_between, flag
from cohortloom.operators.ordered import ordered_rows
from cohortloom.operators.skew import attach, order_columns


HELPERS = ("_rn", "_prev", "_first", "_many")


def attach_group(df: DataFrame, keys: list[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Add aggregates of each row's group.

    Aggregates are combined map-side and looked up, instead of a window that
    would pull each whole group into one task.
    """
    return attach(df, df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggs.items()]), keys)


def group_size(df: DataFrame, keys: list[str], name: str = "group_size") -> DataFrame:
    """Rows in the group."""
    return attach_group(df, keys, {name: F.count(F.lit(1))})


def group_any_flag(df: DataFrame, keys: list[str], conds: Mapping[str, Column]) -> DataFrame:
    """1 if any row of the group meets the condition, else 0."""
    return attach_group(df, keys, {n: F.max(flag(c)) for n, c in conds.items()})


def group_cond_count(df: DataFrame, keys: list[str], conds: Mapping[str, Column]) -> DataFrame:
    """Rows of the group that meet the condition."""
    return attach_group(df, keys, {n: F.sum(flag(c)) for n, c in conds.items()})


def composite_group_flag(df: DataFrame, name: str, rules: Iterable[Column]) -> DataFrame:
    """1 if any rule over group flags holds, else 0."""
    out = None
    for rule in rules:
        out = F.when(rule, 1) if out is None else out.when(rule, 1)
    return df.withColumn(name, out.otherwise(0))


def priority_sort(df: DataFrame, keys: list[str], order: list, name: str = "position") -> DataFrame:
    """Row number within the group under a mixed-direction order with missing values last."""
    carry = [order[-1] if isinstance(order[-1], str) else order[-1][0]]
    out = ordered_rows(df, keys, order, carry)
    return out.withColumnRenamed("_rn", name).drop("_prev", "_first", "_many")


def first_per_group_priority(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per group. The rank filter is applied before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order_columns(order))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def latest_per_group(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Latest row per group, ties to the smallest id."""
    return first_per_group_priority(df, keys, [(ts, "desc"), tie])


def _keep_matching(df: DataFrame, best: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        one = df[k].eqNullSafe(best[f"_b_{k}"])
        cond = one if cond is None else cond & one
    for v in values:
        cond = cond & (df[v] == best[f"_b_{v}"])
    return df.join(best, cond, "left_semi")


def min_date_ties(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows at the group's earliest date, all ties kept.

    The join key includes the date, so a large group spreads over the cluster.
    """
    best = df.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys]).agg(F.min(ts).alias(f"_b_{ts}"))
    return _keep_matching(df, best, keys, [ts])


def max_value_min_date(df: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """Rows with the group's largest value and, among those, the earliest date; ties kept."""
    per_value = df.groupBy(*keys, value).agg(F.min(ts).alias("_ts"))
    best = (
        per_value.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys])
        .agg(F.max_by(F.struct(value, "_ts"), value).alias("_top"))
        .select(
            *[f"_b_{k}" for k in keys],
            F.col(f"_top.{value}").alias(f"_b_{value}"),
            F.col("_top._ts").alias(f"_b_{ts}"),
        )
    )
    return _keep_matching(df, best, keys, [value, ts])


def strict_group_max(df: DataFrame, keys: list[str], cond: Column, ts: str, name: str = "strict_max") -> DataFrame:
    """Latest date of the group if every row meets the condition, else missing."""
    return attach_group(df, keys, {name: F.when(F.min(flag(cond)) == 1, F.max(ts))})


def lag_days_expr(ts: str) -> Column:
    """Days since the previous row, 0 on the first; for use after ``ordered_rows``."""
    return F.when(F.col("_rn") == 1, 0).otherwise(days_between(F.col(ts), F.col(f"_prev.{ts}")))


def running_days_expr(ts: str) -> Column:
    """Running total of day gaps: gaps telescope to the days since the first row.

    Missing dates sort last and stay missing, as a running sum after a gap would.
    """
    return F.when(F.col("_rn") == 1, 0).otherwise(days_between(F.col(ts), F.col(f"_first.{ts}")))


def baseline_expr(score: str) -> Column:
    """First row's score as the group's base.

    In a group of several rows the base is at least 0; it is missing where the
    first score is.
    """
    first = F.col(f"_first.{score}")
    return F.when(F.col("_many") & first.isNotNull(), F.greatest(first, F.lit(0))).otherwise(first)


def lag_days(df: DataFrame, keys: list[str], order: list, ts: str, name: str = "lag_days") -> DataFrame:
    out = ordered_rows(df, keys, order, [ts])
    return out.withColumn(name, lag_days_expr(ts)).drop(*HELPERS)


def lag_score(df: DataFrame, keys: list[str], order: list, col: str, name: str = "lag_score") -> DataFrame:
    """Change of score from the previous row; missing on the first."""
    out = ordered_rows(df, keys, order, [col])
    return out.withColumn(name, F.col(col) - F.col(f"_prev.{col}")).drop(*HELPERS)


def running_days(df: DataFrame, keys: list[str], order: list, ts: str, name: str = "running_days") -> DataFrame:
    out = ordered_rows(df, keys, order, [ts])
    return out.withColumn(name, running_days_expr(ts)).drop(*HELPERS)


def session_number(df: DataFrame, keys: list[str], order: list, name: str = "session_number") -> DataFrame:
    out = ordered_rows(df, keys, order, [order[0] if isinstance(order[0], str) else order[0][0]])
    return out.withColumnRenamed("_rn", name).drop("_prev", "_first", "_many")


def baseline_diff(
    df: DataFrame, keys: list[str], order: list, cols: Iterable[str], pct: bool = False
) -> DataFrame:
    """Difference of each score from the group's first row, optionally also as a share of it."""
    cols = list(cols)
    out = ordered_rows(df, keys, order, cols)
    out = out.withColumns({f"{c}_base": baseline_expr(c) for c in cols})
    out = out.withColumns({f"{c}_bdiff": F.col(c) - F.col(f"{c}_base") for c in cols})
    if pct:
        out = out.withColumns(
            {f"{c}_pctdiff": F.try_divide(F.col(f"{c}_bdiff"), F.col(f"{c}_base")) for c in cols}
        )
    return out.drop(*HELPERS)


def regroup_sizes(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Number of rows sharing the row's value, ``{column: new name}``."""
    for col, name in names.items():
        df = attach_group(df, [col], {name: F.count(F.lit(1))})
    return df


def _trajectory(
    forms: DataFrame, key: str, ts: str, tie: str, name: str, scores: list[str],
    types: Iterable[str], baseline_types: Iterable[str], complete: Column | None, min_rows: int | None,
) -> DataFrame:
    """Rows of the wanted form types, for groups with a baseline form, with all per-row measures.

    One ordered pass per group; sizes per day and week come from one collapsed table.
    """
    baseline = (
        forms.filter(F.col(name).isin(list(baseline_types))).select(F.col(key).alias("_base_key")).distinct()
    )
    rows = forms.filter(F.col(name).isin(list(types)))
    if complete is not None:
        rows = rows.filter(complete)
    wanted = rows.join(baseline, rows[key].eqNullSafe(baseline["_base_key"]), "left_semi")
    rows = ordered_rows(wanted, [key], [ts, tie], [ts, *scores], min_rows)
    rows = rows.withColumns({"days_between": lag_days_expr(ts), "days_from_first": running_days_expr(ts)})
    rows = rows.withColumns(
        {
            "day_group": day_bins(F.col("days_from_first")),
            "weeks_from_first": _weeks(F.col("days_from_first")),
            **{f"{c}_base": baseline_expr(c) for c in scores},
        }
    )
    rows = rows.withColumns({f"{c}_bdiff": F.col(c) - F.col(f"{c}_base") for c in scores})
    # A week holds seven day offsets at most, so the week sum runs over tiny groups.
    sizes = _day_sizes(wanted, key, ts)
    by_week = Window.partitionBy(_weeks(F.col("_day")))
    sizes = sizes.withColumn("n_per_week", F.sum("n_per_day").over(by_week))
    # Day offsets are few, so Spark broadcasts the sizes; if ever not, it splits the crowded days.
    rows = rows.join(sizes, rows["days_from_first"].eqNullSafe(sizes["_day"]), "left").drop("_day")
    return rows.withColumnRenamed("_rn", "session_number")


def _day_sizes(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows per day offset from the group's first date, which is its smallest: no order is needed for the counts.

    Of a group without any date the first row is at day 0, the others have no offset.
    """
    first = rows.groupBy(key).agg(F.min(ts).alias("_ts0"))
    days = attach(rows.select(key, ts), first, [key]).select(days_between(F.col(ts), F.col("_ts0")).alias("_day"), F.lit(1).alias("_n"))
    moved = F.expr("inline(array(named_struct('_day', 0, '_n', 1), named_struct('_day', int(null), '_n', -1)))")
    counts = days.unionByName(first.filter(F.col("_ts0").isNull()).select(moved)).groupBy("_day").agg(F.sum("_n").alias("n_per_day"))
    return counts.filter("n_per_day > 0")


def _weeks(days: Column) -> Column:
    return F.ceil(days / 7).cast("int")


def trajectory_multi(
    forms: DataFrame, key: str, ts: str, ratings: list[str], types: Iterable[str], baseline_types: Iterable[str],
    name: str = "name", tie: str = "id", pct: Iterable[str] = (), min_rows: int | None = None,
) -> DataFrame:
    """Several ratings per session, each with its change from the first session."""
    rows = _trajectory(forms, key, ts, tie, name, list(ratings), types, baseline_types, None, min_rows)
    pct = list(pct)
    rows = rows.withColumns(
        {f"{c}_pctdiff": F.try_divide(F.col(f"{c}_bdiff"), F.col(f"{c}_base")) for c in pct}
    )
    return rows.select(
        key, tie, ts, name, "days_between", "days_from_first", "day_group", "n_per_day",
        "weeks_from_first", "n_per_week", "session_number", *ratings,
        *[f"{c}_bdiff" for c in ratings], *[f"{c}_pctdiff" for c in pct],
    )


def trajectory_score(
    forms: DataFrame, key: str, ts: str, items: list[str], types: Iterable[str], baseline_types: Iterable[str],
    name: str = "name", tie: str = "id", min_rows: int | None = None,
) -> DataFrame:
    """Sum score of complete questionnaires with change from the previous and the first one."""
    items = list(items)
    total = F.col(items[0])
    for c in items[1:]:
        total = total + F.col(c)
    scored = forms.withColumns({"n_answered": answered([F.col(c) for c in items]), "score": total})
    complete = F.col("n_answered") == len(items)
    rows = _trajectory(scored, key, ts, tie, name, ["score"], types, baseline_types, complete, min_rows)
    rows = rows.withColumn("score_change", F.col("score") - F.col("_prev.score"))
    return rows.select(
        key, tie, ts, name, "days_between", "days_from_first", "day_group", "n_per_day",
        "weeks_from_first", "n_per_week", "session_number", "score", "n_answered",
        "score_change", "score_bdiff",
    )
