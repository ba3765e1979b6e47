"""Session settings that the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: fitting partition counts, skewed join partitions split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not compile methods above 8000 bytes. Where a query generates one,
    # let Spark fall back to split code instead of running it interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Out-of-range dates and bad casts fail instead of turning into nulls.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with these settings; set others, such as memory, as usual."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
