"""Connected components by alternating large-star and small-star rounds over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node but the roots themselves.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; direction, loops, repeats and nulls don't matter.
    Each round joins on nodes and aggregates on the map side first; no list of neighbours is ever gathered.
    """
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept, before = written(kept, "edges"), None
    while True:
        both = kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = F.xxhash64("u", "v")
        now = kept.agg(F.count("*"), F.sum(F.shiftright(mark, 16)), F.bit_xor(mark)).first()
        if now == before:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
