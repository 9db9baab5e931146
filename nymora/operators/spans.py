"""Arrays of entities: overlap tests and the choice among overlapping ones, as array functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ENTITY = "struct<type:string,value:string,start:int,end:int,detector:string,confidence:double>"
ENTITIES = f"array<{ENTITY}>"


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def contains(spans: Column, start: Column, end: Column) -> Column:
    """Does one span hold all of start..end?"""
    return F.exists(spans, lambda s: (s["start"] <= start) & (end <= s["end"]))


def resolve(entities: Column) -> Column:
    """Disjoint entities: higher confidence first, then longer, then earlier, then the array's order; returned by start.

    For arrays of up to a few hundred; the scanner resolves longer ones by bisection before they become arrays.
    """
    ranked = F.array_sort(F.transform(entities, lambda e, i: F.struct((-e["confidence"]).alias("c"), (e["start"] - e["end"]).alias("l"), e["start"].alias("s"), i.alias("i"), e.alias("e"))))
    kept = F.aggregate(F.transform(ranked, lambda r: r["e"]), F.array().cast(ENTITIES), lambda acc, e: F.when(overlaps(acc, e["start"], e["end"]), acc).otherwise(F.concat(acc, F.array(e))))
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["start"].alias("s"), e.alias("e")))), lambda r: r["e"])


def in_bins(spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bin of ``width`` that a span touches."""
    return spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs of spans (start, end; not empty) of the same ``keys`` that overlap; columns of ``right`` are given as ``right_<name>``.

    An equality join on keys and bins: a key with many spans costs its neighbours, not their product. A pair that shares several bins is given by the
    one in which its overlap begins. ``width`` should be about the length of a span.
    """
    named = right.select(*(F.col(c) if c in keys else F.col(c).alias(f"right_{c}") for c in right.columns))
    a, b = in_bins(left, "start", "end", width), in_bins(named, "right_start", "right_end", width)
    both = a.join(b, [*keys, "_bin"]).where((F.col("start") < F.col("right_end")) & (F.col("right_start") < F.col("end")))
    return both.where(F.col("_bin") == F.floor(F.greatest("start", "right_start") / width)).drop("_bin")


def not_within(spans: DataFrame, outer: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """The ``spans`` that lie within none of ``outer`` (start, end) of the same ``keys``."""
    held = in_bins(outer.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b")), "_a", "_b", width)
    own = spans.withColumn("_bin", F.floor(F.col("start") / width)).alias("s")
    same = [F.col(f"s.{k}") == F.col(f"o.{k}") for k in (*keys, "_bin")]
    inside = (F.col("_a") <= F.col("s.start")) & (F.col("s.end") <= F.col("_b"))
    for one in same:
        inside = inside & one
    return own.join(held.alias("o"), inside, "left_anti").drop("_bin")


def _spliced(texts: pa.Array, changes: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), changes.to_pylist(), strict=True):
        if text is None or not own:
            out.append(text)
            continue
        parts, at = [], 0
        for c in own:
            parts += (text[at : c["start"]], c["surrogate"])
            at = c["end"]
        out.append("".join([*parts, text[at:]]))
    return pa.array(out, pa.string())


def rewrite(text: Column, changes: Column) -> Column:
    """``text`` with start..end of each of ``changes`` (array<struct<start, end, surrogate>>, disjoint, by start) replaced.

    An Arrow function splices texts that change, in time linear in the text and its changes; a substring in the JVM counts
    characters from the text's begin each time. Other texts stay in the JVM.
    """
    some = F.size(changes) > 0
    return F.when(some, F.arrow_udf(_spliced, StringType())(F.when(some, text), F.when(some, changes))).otherwise(text)
