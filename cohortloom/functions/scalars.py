"""Scalar helpers with explicit missing-value rules. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (a missing condition counts as not held)."""
    return F.when(cond, 1).otherwise(0)


def contains0(c: Column, text: str) -> Column:
    """Literal substring test; a missing value does not contain anything."""
    return F.coalesce(F.contains(c, F.lit(text)), F.lit(False))


def isin0(c: Column, values: Iterable) -> Column:
    """Membership test; a missing value is no member."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole calendar days from ``earlier`` to ``later``."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def months30(later: Column, earlier: Column) -> Column:
    """Days divided by 30."""
    return days_between(later, earlier) / F.lit(30.0)


def relabel(c: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Replace listed values; anything else becomes ``default`` (missing if not given)."""
    (first, label), *rest = mapping.items()
    out = F.when(c == F.lit(first), F.lit(label))
    for value, label in rest:
        out = out.when(c == F.lit(value), F.lit(label))
    return out if default is None else out.otherwise(default)


def recode_value(c: Column, rules: Iterable[tuple[Column, object]]) -> Column:
    """Overwrite by the first rule whose condition holds; a missing condition changes nothing."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return c if out is None else out.otherwise(c)


def coalesce_levels(*cols: Column) -> Column:
    """First value present, in order of preference."""
    return F.coalesce(*cols)


def rowwise_extremes(cols: Iterable[Column], fn: str) -> Column:
    """Largest or smallest value across columns, skipping missing ones."""
    cols = list(cols)
    if len(cols) == 1:
        return cols[0]
    return {"max": F.greatest, "min": F.least}[fn](*cols)


def answered(cols: Iterable[Column]) -> Column:
    """Number of columns that hold a value."""
    return reduce(add, [c.isNotNull().cast("int") for c in cols])


def position(df: DataFrame, order: list) -> Column:
    """Struct that sorts like an order of names and ``(name, 'desc')``, missing values last, for ``min_by``."""
    parts = []
    for item in order:
        name, desc = (item, False) if isinstance(item, str) else (item[0], item[1] == "desc")
        c, kind = F.col(name), df.schema[name].dataType
        if desc and isinstance(kind, T.DateType):
            c = F.bitwise_not(F.datediff(c, F.lit("1970-01-01").cast("date")))
        elif desc and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.bitwise_not(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), c))
        elif desc and isinstance(kind, T.IntegralType):
            c = F.bitwise_not(c)
        elif desc:
            raise ValueError(f"no descending position for {name} ({kind.simpleString()})")
        parts += [F.col(name).isNull(), c]
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
