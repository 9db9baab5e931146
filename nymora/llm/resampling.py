"""Importance resampling of documents towards the benchmark: hashed n-gram features, gains per bucket, and a draw by Gumbel keys.

Words come from bytes: a table of 256 bytes lower-cases A-Z and turns what can't be in a word into spaces, ``bytes.split`` does the rest; bytes from 0x80 on stay.
A feature is a run of 1 to ``most`` words joined by a space; its crc32 is chained from that of its first words, so longer runs cost one call each.
Counters of distinct features are made in each task, 10,000 sums a task at most travel; the bucket gains are broadcast (``buckets`` longs).
Documents are ranked by a range sort over (score, doc_id) with summed offsets, so no task ranks all of them.

Defined cases: a null text has no words; a null doc_id counts as the empty text in the draw's hash; repeated rows are drawn each, ties of one doc_id in
any order; empty tables give no rows, an empty target gains of the corpus alone; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import numbered
from .common import written

WORD_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(0x80, 0x100))
TABLE = bytes(b if (b := x + 32 if 65 <= x <= 90 else x) in WORD_BYTES else 32 for x in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def runs(own: list[bytes], most: int) -> Iterator[int]:
    """crc32 of every run of 1 to ``most`` words."""
    crc = zlib.crc32
    for i in range(len(own)):
        at = crc(own[i])
        yield at
        for w in own[i + 1 : i + most]:
            at = crc(w, crc(b" ", at))
            yield at


def hashed(of: Counter, buckets: int) -> Counter:
    """Counts of words as counts of buckets: each distinct word is hashed once."""
    out: Counter = Counter()
    for w, n in of.items():
        out[zlib.crc32(w) % buckets] += n
    return out


def counted(own: list[bytes], most: int, buckets: int) -> Counter:
    """Features of one text by bucket."""
    return hashed(Counter(own), buckets) if most == 1 else Counter(x % buckets for x in runs(own, most))


def feature_counts(docs: DataFrame, text: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, "int64")
        for batch in batches:
            if most == 1:  # words of the whole batch at once
                all_: Counter = Counter()
                for t in batch.column(0).cast(pa.binary()).to_pylist():
                    all_.update(words(t))
                own = hashed(all_, buckets)
            else:
                own = Counter()
                for t in batch.column(0).cast(pa.binary()).to_pylist():
                    own.update(counted(words(t), most, buckets))
            for b, n in own.items():
                sums[b] += n
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], ["bucket", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, "int64")
    for b, n in counts.collect():  # ``buckets`` rows at most
        out[b] = n
    return out


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the corpus's) of each bucket."""
    s, t = (_array(feature_counts(x, text, most, buckets), buckets).astype("float64") for x in (corpus, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype("int64")


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", most: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: the floored mean gain of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value.tolist(), {}
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                own = words(t)
                if most == 1:
                    n, total = len(own), 0
                    for w, c in Counter(own).items():
                        g = known.get(w)
                        if g is None:
                            if len(known) > 200_000:
                                known.clear()
                            g = known[w] = table[zlib.crc32(w) % buckets]
                        total += g * c
                else:
                    each = counted(own, most, buckets)
                    n, total = each.total(), sum(table[b] * c for b, c in each.items())
                n_words.append(len(own))
                n_features.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, most: int = 1, buckets: int = 10_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document; ``percent`` of those with ``least_words`` words are drawn."""
    own = written(weighed(docs, gains(docs, target, text, most, buckets), text, doc_id, most), "weights")  # the range sort reads it twice
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((head + 0.5) / 4294967296.0)))
    scored = own.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("_out", F.when(F.col("n_words") >= least_words, 0).otherwise(1))
    placed = numbered(scored, ["_out"], [F.desc("score"), F.col("doc_id")], "_n")
    drawn = percent * placed.where("_out = 0").count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when((F.col("_out") == 0) & (F.col("_n") <= drawn), F.col("_n")).cast("long").alias("rank"))
