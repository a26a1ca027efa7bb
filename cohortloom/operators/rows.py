"""Projections and filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import contains0


def project(df: DataFrame, keep: Iterable[str] | None = None, drop: Iterable[str] | None = None) -> DataFrame:
    """Keep and/or drop columns by name; an unknown name fails."""
    unknown = sorted({*(keep or ()), *(drop or ())} - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    out = df.select(*keep) if keep is not None else df
    return out.drop(*drop) if drop is not None else out


def rename_labels(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns, display names with blanks and punctuation included."""
    return df.withColumnsRenamed(dict(mapping))


def derive_chain(df: DataFrame, steps: Iterable[tuple[str, Column]]) -> DataFrame:
    """Add columns in order, each able to use the ones before it.

    Steps that do not read each other could share one projection; the optimizer
    collapses the chain.
    """
    for name, expr in steps:
        df = df.withColumn(name, expr)
    return df


def conj_filter(df: DataFrame, *conds: Column) -> DataFrame:
    """Rows where every condition holds; a missing condition drops the row."""
    return df.filter(reduce(and_, conds))


def exclude_list(df: DataFrame, col: str, reasons: Iterable) -> DataFrame:
    """Drop listed values, keep missing ones."""
    c = F.col(col)
    return df.filter(c.isNull() | ~c.isin(list(reasons)))


def exclude_list_status(df: DataFrame, col: str, reasons: Iterable, status_col: str, active) -> DataFrame:
    """Drop listed values; keep missing ones only where the status is active."""
    c = F.col(col)
    return df.filter((c.isNull() & (F.col(status_col) == F.lit(active))) | ~c.isin(list(reasons)))


def drop_test_names(df: DataFrame, name: str, tokens: Iterable[str], flag_col: str | None = None) -> DataFrame:
    """Drop rows whose upper-cased name contains a token or whose test flag is not false."""
    conds = [~contains0(F.upper(F.col(name)), t) for t in tokens]
    if flag_col:
        conds.append(~F.col(flag_col))
    return conj_filter(df, *conds)


def na_subset(df: DataFrame, values: str | Iterable[str], cond: Column) -> DataFrame:
    """Subset by a condition where a missing condition keeps the row with its values blanked."""
    names = [values] if isinstance(values, str) else list(values)
    kept = df.withColumn("_cond", cond).filter(F.col("_cond") | F.col("_cond").isNull())
    return kept.withColumns({n: F.when(F.col("_cond"), F.col(n)) for n in names}).drop("_cond")
