"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Cut-offs are UTC instants, so dates must be taken in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Row-side joins on a hot key are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Call-site capture costs more than the planning of wide column lists.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "cohortloom", master: str | None = None, **extra: str) -> SparkSession:
    """Build or reuse a session with the settings above.

    Cluster sizing (shuffle partitions, memory, checkpoint folder) is left to
    the submitter; pass it through ``extra`` or the cluster's own defaults.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
