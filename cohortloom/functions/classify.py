"""Derived categorical columns.

Functions on a ``Column`` return a ``Column``; functions on a frame add several
columns at once, so a block of flags is one projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import contains0, flag, relabel
from cohortloom.params import DAY_BINS


def screen_flag(cols: Iterable[Column]) -> Column:
    """1 if every screener item is answered, else 0."""
    return reduce(and_, [c.isNotNull() for c in cols]).cast("int")


def tiered_risk(
    all_no: Iterable[Column], high: Iterable[Column], moderate: Iterable[Column], low: Iterable[Column]
) -> Column:
    """Risk 0-3 by the first tier that applies; missing if none does."""

    def any_yes(cols):
        return reduce(or_, [c == "Yes" for c in cols])

    return (
        F.when(reduce(and_, [c == "No" for c in all_no]), 0)
        .when(any_yes(high), 3)
        .when(any_yes(moderate), 2)
        .when(any_yes(low), 1)
    )


def bucket_unknown(
    c: Column, refused: Iterable | None = None, known: Iterable | None = None, unknown: str = "Unknown"
) -> Column:
    """Keep a value unless it is missing, refused, or outside the known list."""
    if known is not None:
        return F.when(c.isin(list(known)), c).otherwise(F.lit(unknown))
    gone = c.isNull()
    if refused is not None:
        gone = gone | c.isin(list(refused))
    return F.when(gone, F.lit(unknown)).otherwise(c)


def bucket_collapse(c: Column, rules: Mapping, other: str, unknown: str, refused: Iterable = ()) -> Column:
    """Map listed values, send missing and refused ones to ``unknown``, the rest to ``other``."""
    gone = c.isNull() | c.isin(list(refused)) if refused else c.isNull()
    return F.coalesce(relabel(c, rules), F.when(gone, F.lit(unknown)).otherwise(F.lit(other)))


def numeric_bands(c: Column, edges: Iterable[tuple], unknown: str, digits: int | None = 2) -> Column:
    """Label of the first inclusive ``(low, high, label)`` band; unreadable values are ``unknown``.

    Text is read from its first ``digits`` characters, as the written rule has it; None reads the whole leading number.
    """
    text = F.regexp_extract(c, r"^\s*(\d+)", 1) if digits is None else F.substring(c, 1, digits)
    number = text.try_cast("double")
    out = None
    for low, high, label in edges:
        cond = number >= low if high is None else (number >= low) & (number <= high)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(unknown))


def day_bins(c: Column, bins: Iterable[tuple] = DAY_BINS) -> Column:
    """Bin of a day offset: exactly the first bound, then half-open bins up to each bound.

    A negative or missing offset has no bin.
    """
    bins = list(bins)
    first, label = bins[0]
    out = F.when(c == first, F.lit(label))
    below = first
    for bound, label in bins[1:]:
        cond = c > below if bound is None else (c > below) & (c <= bound)
        out = out.when(cond, F.lit(label))
        below = bound
    return out


# Each block of flags comes as a dict of columns, so that callers can add many
# blocks in one projection, and as a frame function.


def one_hot_columns(c: Column, names: Mapping) -> dict[str, Column]:
    return {name: (c == F.lit(v)).cast("int") for v, name in names.items()}


def one_hot_flags(df: DataFrame, col: str, names: Mapping) -> DataFrame:
    """One 0/1 column per listed value; missing stays missing."""
    return df.withColumns(one_hot_columns(F.col(col), names))


def freetext_columns(c: Column, stem: str) -> dict[str, Column]:
    up = F.upper(c)
    denies = (c == "") | contains0(up, "NONE") | up.isin("NO", "NO MENTIONED")
    return {
        f"{stem}yes": F.when(c.isNull() | denies, 0).otherwise(1),
        f"{stem}no": flag(denies),
        f"{stem}missing": flag(c.isNull()),
    }


def freetext_yes_no(df: DataFrame, col: str, stem: str) -> DataFrame:
    """Yes/no/missing flags of a free-text problem field.

    Empty text, text containing "none", "no" and "no mentioned" (any case) mean no.
    """
    return df.withColumns(freetext_columns(F.col(col), stem))


def yes_no_columns(c: Column, stem: str, implied_no: Column | None = None) -> dict[str, Column]:
    no, missing = c == "No", c.isNull()
    if implied_no is not None:
        no, missing = no | (implied_no == "No"), missing & implied_no.isNull()
    return {f"{stem}yes": flag(c == "Yes"), f"{stem}no": flag(no), f"{stem}missing": flag(missing)}


def yes_no_missing(df: DataFrame, col: str, stem: str, implied_no: str | None = None) -> DataFrame:
    """Yes/no/missing flags of a yes-no field.

    With ``implied_no``, a "No" there also means no here, and the answer is
    missing only if both fields are.
    """
    other = F.col(implied_no) if implied_no is not None else None
    return df.withColumns(yes_no_columns(F.col(col), stem, other))


def multi_select_columns(
    c: Column, tokens: Mapping, count: str | None = None, missing: str | None = None
) -> dict[str, Column]:
    flags = {name: flag(contains0(c, token)) for token, name in tokens.items()}
    out = dict(flags)
    if count:
        out[count] = reduce(add, flags.values())
    if missing:
        out[missing] = flag(c.isNull())
    return out


def multi_select_flags(
    df: DataFrame, col: str, tokens: Mapping, count: str | None = None, missing: str | None = None
) -> DataFrame:
    """0/1 column per substring of a delimited multi-select, their number, and a missing flag."""
    return df.withColumns(multi_select_columns(F.col(col), tokens, count, missing))
