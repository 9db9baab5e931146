"""Scores of found against labelled spans: exact matches by type, with a total row, and false alarms per 1,000 words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = ["id", "type", "start", "end"]


def scores(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) and a row TOTAL; both inputs have id, type, start, end."""
    both = found.select(*SPAN, F.lit(1).alias("f")).join(gold.select(*SPAN, F.lit(1).alias("g")), SPAN, "full")
    tp, fp, fn = (F.count_if(c) for c in (F.col("f").isNotNull() & F.col("g").isNotNull(), F.col("g").isNull(), F.col("f").isNull()))
    counted = both.rollup("type").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.grouping("type").alias("all"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = counted.withColumns({"precision": p, "recall": r}).withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rated.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("type")).alias("type"), "tp", "fp", "fn", "precision", "recall", "f1")


def false_alarms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(category, words, alarms, per_1000_words) of documents without labelled spans; docs: id, category, text."""
    words = docs.select("id", "category", F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).alias("words"))
    hits = found.groupBy("id").agg(F.count(F.lit(1)).alias("alarms"))
    joined = words.join(hits, "id", "left").groupBy("category").agg(F.sum("words").alias("words"), F.sum(F.coalesce("alarms", F.lit(0))).alias("alarms"))
    return joined.withColumn("per_1000_words", F.when(F.col("words") > 0, 1000 * F.col("alarms") / F.col("words")))
