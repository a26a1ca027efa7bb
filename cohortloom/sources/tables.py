"""Scans, scan-side filters and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.schema import entity_schema


def scan_project(spark: SparkSession, folder: str, table: str, cols: Iterable[str]) -> DataFrame:
    """Read named columns of one parquet table; the pruning reaches the scan."""
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*cols)


def read_entity(spark: SparkSession, path: str, entity: str, cols: Iterable[str] | None = None) -> DataFrame:
    """Read an entity with its declared schema; a missing or retyped column fails."""
    wanted = entity_schema(entity)
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    names = list(cols) if cols is not None else wanted.names
    drift = [n for n in names if found.get(n) != wanted[n].dataType]
    if drift:
        raise ValueError(f"{entity}: columns missing or of another type: {drift}")
    return spark.read.schema(wanted).parquet(path).select(*names)


def time_window(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows with ``start <= ts < end``."""
    kind = df.schema[ts].dataType
    low, high = (F.lit(v).cast(kind) for v in (start, end))
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def type_filter(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Rows whose column equals one of the values."""
    return df.filter(F.col(col).isin(list(values)))


def null_or_ne(c: Column, value) -> Column:
    """True where the column is missing or differs from the value."""
    return c.isNull() | (c != F.lit(value))


def key_semi_join(
    df: DataFrame, key: str, keys_df: DataFrame, keys_col: str | None = None, drop_null_keys: bool = True
) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys_df``; the key list never leaves the cluster.

    With ``drop_null_keys`` off, a missing key on both sides counts as a match.
    """
    keys = keys_df.select(F.col(keys_col or key).alias("_key")).distinct()
    if drop_null_keys:
        keys = keys.filter(F.col("_key").isNotNull())
        return df.join(keys, df[key] == keys["_key"], "left_semi")
    return df.join(keys, df[key].eqNullSafe(keys["_key"]), "left_semi")


def survey_scan(spark: SparkSession, path: str) -> DataFrame:
    """Survey percentages from CSV; dotted column names become underscored.

    The header must name the columns in this order, or the read fails.
    """
    schema = entity_schema("survey")
    dotted = T.StructType([T.StructField(f.name.replace("_", "."), f.dataType) for f in schema])
    read = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return read.schema(dotted).csv(path).toDF(*schema.names)


def write_csv(df: DataFrame, path: str, null: str = "NA", mode: str = "errorifexists") -> None:
    """Write with header, no row names, and missing values spelled out."""
    df.write.mode(mode).option("header", True).option("nullValue", null).option("emptyValue", "").csv(path)
