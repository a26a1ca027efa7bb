"""Small helpers shared by the operators: scratch tables, text defaults, word splitting and memory of Python workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="cohortloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, so that other columns of ``docs`` can't clash; a null text is empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def picked(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose long ``key`` is among the same column of ``wanted``; the rows with their texts stay where they are.

    The wanted keys are written as one bit each, 64 neighbouring keys to a row. Of keys that Spark numbered that is a
    table small enough to be sent to the rows where the keys themselves would not be; if it is not, Spark shuffles.
    """
    word, bits = free_name(df, "word"), free_name(df, "bits")
    place = F.col(f"`{key}`").bitwiseAND(F.lit(63)).cast("int")
    bit = F.expr(f"shiftleft(1L, CAST(`{key}` & 63 AS INT))")
    words = wanted.groupBy(F.shiftright(F.col(f"`{key}`"), 6).alias(word)).agg(F.bit_or(bit).alias(bits))
    words = written(words.where(f"{word} IS NOT NULL"), "wanted")
    return df.join(words, F.shiftright(df[f"`{key}`"], 6) == words[word]).where(F.getbit(F.col(bits), place) == 1).drop(word, bits)


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def release_memory() -> None:
    """Gives back to the system what this process holds and no longer uses. A Python worker outlives its tasks, so what
    one operator's largest batch took would stay with the executor through all later ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others give back on their own
    if trim:
        trim(0)


def releasing(batches: Iterable) -> Iterator:
    """``batches``, and ``release_memory`` after the last."""
    yield from batches
    release_memory()


def free_name(df: DataFrame, stem: str) -> str:
    """A helper column name that ``df`` does not have, whatever the case of its own names."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def shielded(df: DataFrame, reserved: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that bear a ``reserved`` name renamed, and the renaming that turns them back."""
    back = {}
    for name in df.columns:
        if name.lower() in reserved:
            back[free_name(df, f"kept_{name}")] = name
            df = df.withColumnRenamed(name, next(reversed(back)))
    return df, back
