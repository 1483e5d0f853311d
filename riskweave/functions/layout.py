"""How rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt out over all cores if they are so few bytes that a scan would leave cores idle (a file of one row group is one
    task however large). At most one split's bytes for each core move; larger inputs stay where they are."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores * 2) if size <= cores * split and not rows.isStreaming else rows
