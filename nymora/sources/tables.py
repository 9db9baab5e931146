"""Text tables as input of the Arrow functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Tables in more partitions aren't dealt: DEALT * spark.sql.files.maxPartitionBytes is the most that is shuffled, however many cores there are.
DEALT = 64


def read(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``, its rows dealt over the session's cores if it is small and comes in fewer partitions than there are cores.

    A file of one row group is one task, however many cores there are, and text functions are bound by cores. A partition of a
    scan holds ``spark.sql.files.maxPartitionBytes`` at most, so the number of partitions bounds a table's size: one of more
    than ``DEALT`` isn't shuffled. Filters and column selection pass through to the scan.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, DEALT + 1) else df
