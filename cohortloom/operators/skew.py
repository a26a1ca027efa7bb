"""Helpers that keep one crowded key from landing in one task, the same at every size.

Lookups are plain joins: the session lets Spark split the crowded partitions of a join at run time. Windows over ordered
rows can't be split that way, so ``with_ranges`` cuts all rows, in the order of keys and window, into ranges of about
``range_rows`` rows, a window runs per key and range, and one summary row per range is carried on for the keys that a cut
runs through. Cuts are compared in the window's own order. Results don't depend on where they lie.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000
RANGE_ROWS_CONF = "spark.cohortloom.rangeRows"
MAX_RANGES = 4096
SAMPLES_PER_RANGE = 20


def range_rows(df: DataFrame, given: int | None = None) -> int:
    """Rows per range: the argument, else the session setting, else the default."""
    return max(2, given or int(df.sparkSession.conf.get(RANGE_ROWS_CONF, str(RANGE_ROWS))))


def same_keys(left: DataFrame, right: DataFrame, pairs) -> Column:
    """Equality on key pairs where a missing key equals a missing key."""
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def lookup_join(
    df: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Inner or left join on shared key columns, which appear once; ``df`` may have any share of its rows in one key."""
    pairs = [(k, f"_r{i}") for i, k in enumerate(keys)]
    renamed = right.withColumnsRenamed(dict(pairs))
    on = same_keys(df, renamed, pairs) if null_safe else reduce(and_, [df[a] == renamed[b] for a, b in pairs])
    return df.join(renamed, on, how).drop(*[b for _, b in pairs])


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left join one row of ``stats`` per key to ``df``, missing keys included."""
    return lookup_join(df, stats, keys, "left", null_safe=True)


def order_columns(order: list) -> list[Column]:
    """An order given as names or ``(name, 'desc')`` as window expressions, missing values last."""
    return [
        F.col(o).asc_nulls_last() if isinstance(o, str) or o[1] != "desc" else F.col(o[0]).desc_nulls_last()
        for o in order
    ]


def order_names(order: list) -> list[str]:
    return [o if isinstance(o, str) else o[0] for o in order]


def quoted(name: str) -> str:
    """A column name for SQL text that ``spark.sql`` formats with DataFrames."""
    return ("`" + name.replace("`", "``") + "`").replace("{", "{{").replace("}", "}}")


def order_sql(order: list) -> str:
    """An order given as names or ``(name, 'desc')`` as SQL text, missing values last."""
    return ", ".join(
        f"{quoted(o)} ASC NULLS LAST" if isinstance(o, str) else f"{quoted(o[0])} {'DESC' if o[1] == 'desc' else 'ASC'} NULLS LAST"
        for o in order
    )


def after(cut: str, order: list) -> str:
    """SQL text: whether a row comes after ``cut``, a struct of the order's columns, in that order."""
    rule = "false"
    for item in reversed(order):
        name, desc = (item, False) if isinstance(item, str) else (item[0], item[1] == "desc")
        mine, its = quoted(name), f"{cut}.{quoted(name)}"
        beyond = f"coalesce({mine} {'<' if desc else '>'} {its}, {mine} IS NULL AND {its} IS NOT NULL)"
        rule = f"({beyond} OR ({mine} <=> {its} AND {rule}))"
    return rule


def with_ranges(df: DataFrame, keys: list[str], order: list, rows: int) -> DataFrame:
    """Add ``_range``, a struct of the row's keys and the number of its range, and ``_split``, whether the key has rows in
    other ranges too.

    Ranges cut the rows of all keys, in the order of keys and ``order``, into parts of about ``rows`` rows, ``MAX_RANGES``
    parts at most. The cuts are one scalar subquery over a random sample of ``SAMPLES_PER_RANGE`` rows a range: they reach
    the tasks with the plan, once, so no row carries them and no join attaches them, and a retried task has the same ones.
    """
    whole = [*keys, *order]
    names, key = ", ".join(quoted(n) for n in order_names(whole)), ", ".join(quoted(k) for k in keys)
    parts = f"least(floor(n / {rows}), {MAX_RANGES})"
    # The sample has SAMPLES_PER_RANGE * MAX_RANGES rows at most, give or take chance.
    sample = f"""
        SELECT struct({names}) AS cut, row_number() OVER (PARTITION BY 0 ORDER BY {order_sql(whole)}) AS at
        FROM (SELECT {names}, (SELECT greatest(count(1), 1) FROM {{df}}) AS n FROM {{df}})
        WHERE rand(17) < if({parts} < 2, 0D, {parts} * {SAMPLES_PER_RANGE} / n)"""
    found = f"""
        SELECT struct(cuts, step, filter(cuts, (x, i) -> (i + 1) % step = 0) AS coarse)
        FROM (SELECT cuts, greatest(int(ceil(sqrt(size(cuts)))), 1) AS step
              FROM (SELECT transform(array_sort(collect_list(struct(at, cut))), x -> x.cut) AS cuts
                    FROM ({sample}) WHERE at % {SAMPLES_PER_RANGE} = 0))"""
    # Two-level search: every step-th cut first, then the cuts in between. Cuts of a key are neighbours, so one of them lies
    # right before or right after each of its rows.
    in_key = [
        f"(get(_found.cuts, {at}) IS NOT NULL AND struct({key}) <=> struct({', '.join(f'get(_found.cuts, {at}).{quoted(k)}' for k in keys)}))"
        for at in ("_number - 1", "_number")
    ]
    jump = f"size(filter(_found.coarse, c -> {after('c', whole)})) * _found.step"
    near = f"size(filter(slice(_found.cuts, _jump + 1, _found.step), c -> {after('c', whole)}))"
    return df.sparkSession.sql(
        f"""
        SELECT * EXCEPT (_found, _jump, _number), struct(struct({key}) AS key, _number AS number) AS _range, {' OR '.join(in_key)} AS _split
        FROM (SELECT *, _jump + {near} AS _number
              FROM (SELECT *, {jump} AS _jump FROM (SELECT *, ({found}) AS _found FROM {{df}})))""",
        df=df,
    )
