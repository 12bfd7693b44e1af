"""What a session needs so that results are right."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: This Spark takes the union of two sides with the same partitioning for partitioned, also where adaptive execution has coalesced their partitions
#: differently; an aggregate above it then returns a group twice.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with these settings; plans are to be made after it."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
