"""Replay: what was restored for an application goes back as the model wrote it, not masked anew.

A cache is a table of (scope, occurrence, fingerprint, original, used): an occurrence is a turn's own name within its scope, such as a conversation and
a turn number. An unchanged occurrence gives its own original, whatever else has the same content; content without a known occurrence gives an original only if
all of its scope's entries agree on one and none was ever evicted. Each scope keeps its ``bound`` most recently used entries.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.vault import VaultError
from .tables import numbered, stored

ENTRIES = "scope string, occurrence string, fingerprint string, original string, used long"


class Cache(NamedTuple):
    entries: DataFrame
    forgotten: DataFrame  # scope: those from which an entry was evicted


def empty(spark: SparkSession) -> Cache:
    return Cache(spark.createDataFrame([], ENTRIES), spark.createDataFrame([], "scope string"))


def fingerprint(column: str):
    return F.sha2(F.col(column), 256)


def remember(cache: Cache, restored: DataFrame, shown: str, original: str, used: str, scope: str | None = None, occurrence: str | None = None, bound: int = 10_000) -> Cache:
    """The cache with ``restored`` rows: what was ``shown``, its ``original``, and ``used``, a number that grows with time.

    Rows are ranked by a range sort with summed offsets, so a scope with most of the rows is no one-task sort. Rows without content are left out.
    """
    if bound < 1:
        raise ValueError("the bound is 1 at least")
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    new = restored.where(F.col(shown).isNotNull() & F.col(original).isNotNull()).select(F.coalesce(text(scope), F.lit("")).alias("scope"), text(occurrence).alias("occurrence"), fingerprint(shown).alias("fingerprint"), F.col(original).alias("original"), F.col(used).cast("long").alias("used"))
    both = cache.entries.unionByName(new)
    # An occurrence that came again is the later one; contents without occurrence are kept once for each original.
    named = both.where("occurrence is not null").groupBy("scope", "occurrence").agg(F.max_by(F.struct("fingerprint", "original"), F.struct("used", "fingerprint", "original")).alias("last"), F.max("used").alias("used"))
    named = named.select("scope", "occurrence", "last.fingerprint", "last.original", "used")
    plain = both.where("occurrence is null").groupBy("scope", "occurrence", "fingerprint", "original").agg(F.max("used").alias("used"))
    ranked = stored(numbered(named.unionByName(plain), ["scope"], [F.desc("used"), F.col("occurrence"), F.col("fingerprint"), F.col("original")], "_rank"))
    gone = ranked.where(F.col("_rank") > bound).select("scope").distinct()
    return Cache(ranked.where(F.col("_rank") <= bound).drop("_rank"), stored(cache.forgotten.unionByName(gone).distinct()))


def replay(df: DataFrame, cache: Cache, text: str = "text", scope: str | None = None, occurrence: str | None = None, role: str | None = "role") -> DataFrame:
    """``df`` with ``replay``: the original of an assistant's content that was restored before, else null. VaultError if it can't be told which."""
    rows = df.withColumns({
        "_scope": F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit(""),
        "_occurrence": F.col(occurrence).cast("string") if occurrence else F.lit(None).cast("string"),
        "_print": F.when(F.col(role) == "assistant", fingerprint(text)) if role else fingerprint(text),
    })
    known = cache.entries.where("occurrence is not null").select(F.col("scope").alias("_scope"), F.col("occurrence").alias("_occurrence"), F.col("fingerprint").alias("_own"), F.col("original").alias("_original"))
    contents = cache.entries.groupBy(F.col("scope").alias("_scope"), F.col("fingerprint").alias("_print")).agg(F.min("original").alias("_least"), F.max("original").alias("_most"))
    lost = cache.forgotten.select(F.col("scope").alias("_scope"), F.lit(True).alias("_lost"))
    joined = rows.join(known, ["_scope", "_occurrence"], "left").join(contents, ["_scope", "_print"], "left").join(lost, "_scope", "left")
    by_content = F.col("_own").isNull() & F.col("_print").isNotNull()
    unsure = by_content & (F.col("_lost").isNotNull() | (F.col("_least") != F.col("_most")))
    told = stored(joined.withColumn("_unsure", F.coalesce(unsure, F.lit(False))))
    if n := told.where("_unsure").count():
        raise VaultError(f"{n} restored contents can't be told apart, or were evicted; name their occurrence, or send the original instead")
    # An edited occurrence is none: it is masked anew.
    found = F.when(F.col("_own").isNotNull(), F.when(F.col("_own") == F.col("_print"), F.col("_original"))).otherwise(F.col("_least"))
    return told.withColumn("replay", found).drop("_scope", "_occurrence", "_print", "_own", "_original", "_least", "_most", "_lost", "_unsure")
