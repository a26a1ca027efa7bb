"""Joins. Strategy and the splitting of crowded keys are left to Spark."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.skew import lookup_join


def _keys(key: str | Iterable[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def inner_join(left: DataFrame, right: DataFrame, key: str | Iterable[str]) -> DataFrame:
    """Equi-join on shared key columns; rows with a missing key never match.

    The side with many rows per key goes left.
    """
    return lookup_join(left, right, _keys(key), "inner")


def left_join_fill(
    left: DataFrame, right: DataFrame, key: str | Iterable[str], fill: Mapping[str, object]
) -> DataFrame:
    """Left join, then replace missing values of the named columns."""
    out = lookup_join(left, right, _keys(key), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def null_safe_join(left: DataFrame, right: DataFrame, key: str | Iterable[str], how: str = "inner") -> DataFrame:
    """Join where a missing key matches a missing key; key columns appear once."""
    keys = _keys(key)
    if how in ("inner", "left"):
        return lookup_join(left, right, keys, how, null_safe=True)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = one if cond is None else cond & one
    out = left.join(renamed, cond, how)
    if how in ("right", "right_outer", "full", "outer", "full_outer"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"_r_{k}")) for k in keys})
    return out.drop(*[f"_r_{k}" for k in keys])


def dim_join_exclude(df: DataFrame, dim: DataFrame, key: str, name_col: str, excluded) -> DataFrame:
    """Inner join to a dimension without one named member; its rows drop out of ``df``."""
    return lookup_join(df, dim.filter(F.col(name_col) != F.lit(excluded)), [key], "inner")


def note_detail_join(cohort: DataFrame, notes: DataFrame, key: str, cols: Iterable[str], level: str) -> DataFrame:
    """Notes of a cohort that carry a level, with the wanted columns of both sides.

    A cohort row without notes has no level, so the join is inner.
    """
    return lookup_join(notes.filter(F.col(level).isNotNull()), cohort, [key], "inner").select(*cols)


def call_text_join(notes: DataFrame, calls: DataFrame, call_col: str, id_col: str = "id") -> DataFrame:
    """Attach call transcripts to notes by the note's call id."""
    calls = calls.withColumnRenamed(id_col, call_col)
    return lookup_join(notes.filter(F.col(call_col).isNotNull()), calls, [call_col], "inner")
