"""Per-key ordered computations (previous row, first row, row number, running sums).

A group may be any share of the data: see ``skew.with_ranges``. All derived columns of one call share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortloom.operators.skew import order_names, order_sql, quoted, range_rows, with_ranges


def _per_range(
    df: DataFrame, keys: list[str], order: list, rows: int, local: dict[str, str], carried: dict[str, str],
    needs: list[str], out: dict[str, str],
) -> DataFrame:
    """Rows of ``df`` with the columns ``out``, which read ``local`` and ``carried``; all are SQL texts by name.

    ``local`` are window functions over a row's range (``w``; ``upto`` ends at the row), ``carried`` aggregates over the last
    row of each earlier range of the key (``w``), missing in the first range. ``_next`` and ``_later`` tell whether a row
    follows in the range and in a later one. ``needs`` are the columns that ``local`` reads. Only keys with a cut inside have
    summaries: one per range of theirs, so fewer than two per cut, whatever the number of keys and rows.
    """
    dealt = with_ranges(df, keys, order, rows)
    windows = f"""WINDOW w AS (PARTITION BY _range ORDER BY {order_sql(order)}),
        upto AS (PARTITION BY _range ORDER BY {order_sql(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    found = ", ".join([*[f"{sql} AS {name}" for name, sql in local.items()], "lead(true) OVER w AS _next"])
    wanted = ", ".join(quoted(n) for n in dict.fromkeys([*order_names(order), *needs]))
    before = "(PARTITION BY _range.key ORDER BY _range.number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = ", ".join(f"{sql} OVER {before} AS {name}" for name, sql in carried.items())
    final = {**{n: f"r.{quoted(n)}" for n in df.columns}, **out}
    return df.sparkSession.sql(
        f"""
        SELECT /*+ BROADCAST(s) */ {', '.join(f'{sql} AS {quoted(name)}' for name, sql in final.items())}
        FROM (SELECT * EXCEPT (_split), {found} FROM {{dealt}} {windows}) r
        LEFT JOIN (
          SELECT _range AS _of, lead(true) OVER (PARTITION BY _range.key ORDER BY _range.number) AS _later, {carry}
          FROM (SELECT *, {found} FROM (SELECT _range, {wanted} FROM {{dealt}} WHERE _split) {windows})
          WHERE _next IS NULL
        ) s ON r._range = s._of""",
        dealt=dealt,
    )


def ordered_rows(
    df: DataFrame, keys: list[str], order: list, carry: list[str], min_rows: int | None = None
) -> DataFrame:
    """Add ``_rn`` (row number), ``_prev`` and ``_first`` (structs of ``carry`` of those rows), ``_many``.

    ``_prev`` is missing on the first row of a group; ``_many`` tells whether the group has more than one row.
    ``min_rows`` sets the rows of a range.
    """
    row = f"struct({', '.join(quoted(c) for c in carry)})"
    return _per_range(
        df, keys, order, range_rows(df, min_rows),
        {"_rn": "row_number() OVER w", "_prev": f"lag({row}) OVER w", "_first": f"first({row}) OVER w"},
        {"_before": "sum(_rn)", "_range_prev": f"last({row})", "_range_first": "first(_first)"},
        carry,
        {
            "_rn": "bigint(_rn + coalesce(_before, 0))",
            "_prev": "if(_rn = 1 AND _before IS NOT NULL, _range_prev, _prev)",
            "_first": "if(_before IS NOT NULL, _range_first, _first)",
            "_many": "_before IS NOT NULL OR _rn > 1 OR _next IS NOT NULL OR _later IS NOT NULL",
        },
    )


def running_totals(
    df: DataFrame, keys: list[str], order: list, sums: dict[str, str], min_rows: int | None = None
) -> DataFrame:
    """Add running sums, ``{new column: summed column}``, up to and including each row."""
    numbered = list(enumerate(sums.items()))
    return _per_range(
        df, keys, order, range_rows(df, min_rows),
        {f"_sum_{i}": f"sum({quoted(col)}) OVER upto" for i, (_, col) in numbered},
        {f"_carry_{i}": f"sum(_sum_{i})" for i, _ in numbered},
        list(sums.values()),
        {name: f"_sum_{i} + coalesce(_carry_{i}, 0)" for i, (name, _) in numbered},
    )
