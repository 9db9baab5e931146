"""Tables as sources, and texts that detectors may leave out."""

import pytest
from pyspark.sql import functions as F

from nymora.functions import scan
from nymora.sources import tables as sources


def test_small_tables_are_dealt_over_the_cores(spark, tmp_path):
    path, cores = str(tmp_path / "t"), spark.sparkContext.defaultParallelism
    spark.range(5000).coalesce(1).write.parquet(path)
    df = sources.read(spark, path)
    assert df.select(F.spark_partition_id()).distinct().count() == cores
    assert df.agg(F.count("id"), F.count_distinct("id"), F.sum("id")).head() == (5000, 5000, 5000 * 4999 // 2)


def test_tables_of_many_partitions_are_not_dealt_however_many_cores(spark, tmp_path, monkeypatch):
    spark.range(1000).repartition(2).write.parquet(f"{tmp_path}/t")
    assert sources.read(spark, f"{tmp_path}/t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sources, "DEALT", 1)
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        assert sources.read(spark, f"{tmp_path}/t").rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_of_many_files_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    # Each of these files fills a partition of its own, as one costs 4 MB to open and a partition holds 4 MB at least.
    spark.range(5000).repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(path)
    df = sources.read(spark, path)
    shuffled = "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    assert shuffled == (spark.read.parquet(path).rdd.getNumPartitions() < spark.sparkContext.defaultParallelism)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0).write.parquet(path)
    assert sources.read(spark, path).count() == 0


VALUES = ["call +44 20 7946 0958", "born ٣/٤/1990", "fe80::abcd", "::ffff", "a:b:c", "192.0.2.44", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "SSN 123-45-6789",
          "ghp_" + "aB" * 20, "sk-" + "ab" * 12, "sk-proj-" + "xyz" * 9, "xoxb-" + "abcdefghij", "AKIA" + "ABCDEFGH" * 2, "12 Oak Street", "no value", ""]


@pytest.mark.parametrize("text", [*VALUES, " and ".join(VALUES)])
def test_left_out_detectors_would_find_nothing(text):
    assert scan.scan(text, list(scan.DETECTORS), resolved=False) == [h for find in scan.DETECTORS.values() for h in find(text)]


@pytest.mark.parametrize("value", ["ghp_" + "aB" * 20, "sk-" + "ab" * 12, "sk-proj-" + "xyz" * 9, "xoxb-abcdefghij", "AKIA" + "ABCDEFGH" * 2])
def test_keys_without_digits_are_found(value):
    assert [(h.start, h.end) for h in scan.scan(f"use {value} now")] == [(4, 4 + len(value))]
