"""Shards of near-equal bytes by histogram sort: probes between rows are counted exactly in all partitions at once, refined until each splitter
is near enough to its target, and rows are exchanged once.

Rows are ordered by text's hash, then doc_id, then place in the table, so equal texts are neighbours. A splitter is taken once it is within ``row_share`` of
a shard from its target. Where the target lies in a group of equal texts, the group stays whole if one of its edges is within ``group_share``; else
it is split, at the row boundary next to the target at worst. Each round counts the bytes and rows between all probes with one job over a table
of keys (no texts); only the buckets that hold a target are probed again, between the least and the greatest key found there. A shard is cut
by further splitters of the same kind into parts of about ``part_bytes``, the unit of the exchange; the driver holds ``probes`` counts for each
part, never keys of all documents. ``docs`` is read twice and must give the same rows each time; rows that are equal in text and doc_id must come in the
same order too, as from a table, if a splitter falls among them.

Defined cases: a null text has no bytes and counts as empty; sizes are UTF-8 bytes plus 1; repeated rows are told apart by their place; a null doc_id
is ordered before all others; a row larger than a shard fills one by itself, and shards may stay empty; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KEYS = ("_h", "_d", "_i")
HISTOGRAM = "bucket int, bytes long, rows long, least binary, most binary"
WORD = 1 << 64


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with the three parts of a row's key, and its size."""
    lowest = F.lit(-(1 << 63)).cast("long")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    return docs.withColumns({"_h": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "_d": F.coalesce(F.col(doc_id).cast("long"), lowest), "_i": F.monotonically_increasing_id(), "_size": size.cast("long")})


def packed_keys(parts: list[np.ndarray]) -> np.ndarray:
    """24 bytes a key that sort as the parts do."""
    flipped = np.stack([p.astype("int64") ^ np.int64(-(1 << 63)) for p in parts], 1)
    return np.ascontiguousarray(flipped.astype(">i8")).view("S24").ravel() if len(flipped) else np.zeros(0, "S24")


def as_int(key: bytes) -> int:
    return int.from_bytes(key.ljust(24, b"\0"), "big")


def as_array(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(24, "big") for k in keys], "S24")


class Splitter:
    """The search for a key with ``target`` bytes below; it lies between ``least`` and ``most``, keys of rows after the first round."""

    def __init__(self, target: float):
        self.target, self.key, self.bytes, self.rows = target, None, 0, 0
        self.least, self.most = 0, WORD**3 - 1
        self.level = 0  # probes lie between texts, then between documents of one text, then between repeated rows

    def chosen(self, key: int, below_bytes: int, below_rows: int) -> None:
        self.key, self.bytes, self.rows = key, below_bytes, below_rows

    def unit(self) -> int:
        return WORD ** (2 - self.level)

    def probes(self, n: int) -> list[int]:
        """About ``n`` keys from the bucket's least key to above its greatest."""
        low, high = self.least // self.unit(), self.most // self.unit() + 1
        return [k * self.unit() for k in (*range(low, high, max(1, -(-(high - low) // n))), high)]

    def refine(self, edges: list[tuple[int, int, int]], spans: list[tuple[int, int]], group: float, row: float) -> None:
        """edges: (key, bytes below, rows below) of this splitter's probes; spans: (least, most) key between each two."""
        off = lambda e: abs(e[1] - self.target)
        near = min(edges, key=off)
        if off(near) <= row:
            return self.chosen(*near)
        at = min(max(i for i, e in enumerate(edges) if e[1] <= self.target or i == 0), len(spans) - 1)
        self.least, self.most = spans[at]
        if self.least // self.unit() == self.most // self.unit():  # one text (document, row), whose edges are known
            near = min(edges[at : at + 2], key=off)
            if self.least == self.most or self.level == 0 and off(near) <= group:
                return self.chosen(*near)
            self.level += 1


def histogram(keys: DataFrame, probes: np.ndarray) -> pd.DataFrame:
    """Bytes, rows, least and greatest key between neighbouring ``probes``: each partition counts its own rows, then one sum a bucket."""
    shared = keys.sparkSession.sparkContext.broadcast(probes)
    ddl = HISTOGRAM

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            own = packed_keys([batch.column(i).to_numpy() for i in range(3)])
            sizes = batch.column(3).to_numpy()
            order = np.argsort(own, kind="stable")
            own, sizes = own[order], sizes[order]
            bucket = np.searchsorted(shared.value, own, "right")
            begins = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(begins[1:], len(own))[: len(begins)]
            total = np.concatenate([[0], np.cumsum(sizes)])
            for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                one = [int(total[e] - total[b]), e - b, own[b], own[e - 1]]
                if had := sums.get(int(bucket[b])):
                    one = [had[0] + one[0], had[1] + one[1], min(had[2], one[2]), max(had[3], one[3])]
                sums[int(bucket[b])] = one
        if sums:
            cells = list(zip(*sums.values(), strict=True))
            keys_ = [pa.array([bytes(k).ljust(24, b"\0") for k in c], pa.binary()) for c in cells[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), *keys_], ["bucket", "bytes", "rows", "least", "most"])

    counted = keys.select(*KEYS, "_size").mapInArrow(count, ddl)
    sums = counted.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    return sums.orderBy("bucket").toPandas()


def splitters(keys: DataFrame, shards: int, parts: int, probes: int = 64, group_share: float = 0.01, row_share: float = 0.001) -> list[Splitter]:
    """``shards * parts - 1`` splitters in order; the targets are equal parts of all bytes. At most 64 bits a key word are narrowed ``probes`` times a
    round, and buckets shrink to the keys that occur, so a few rounds are enough whatever the keys."""
    total = keys.agg(F.sum("_size")).head()[0] or 0
    n = shards * parts
    found = [Splitter(total * k / n) for k in range(1, n)]
    group, row = total / n * group_share, total / n * row_share
    while open_ := [s for s in found if s.key is None]:
        own = [s.probes(probes) for s in open_]
        edges = sorted({k for p in own for k in p})
        held = histogram(keys, as_array([k for k in edges if k < WORD**3]))
        by = {int(b): (int(x), int(r), as_int(lo), as_int(hi)) for b, x, r, lo, hi in held.itertuples(index=False)}
        below, at = [(0, 0)], {}
        for i in range(len(edges) + 1):
            x, r, *_ = by.get(i, (0, 0))
            below.append((below[-1][0] + x, below[-1][1] + r))
        for i, k in enumerate(edges):
            at[k] = i
        for s, p in zip(open_, own, strict=True):
            span = []
            for a, b in zip(p, p[1:], strict=False):
                inner = [by[i][2:] for i in range(at[a] + 1, at[b] + 1) if i in by]
                span.append((min((x[0] for x in inner), default=a), max((x[1] for x in inner), default=a)))
            s.refine([(k, *below[at[k] + 1]) for k in p], span, group, row)
    for a, b in zip(found, found[1:], strict=False):  # a row larger than a part: neighbours may have chosen the same boundary
        if b.key < a.key:
            b.chosen(a.key, a.bytes, a.rows)
    return found


def shard(docs: DataFrame, shards: int = 16, part_bytes: int = 256 << 20, text: str = "text", doc_id: str = "doc_id", probes: int = 64, group_share: float = 0.01, row_share: float = 0.001) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard)."""
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    rows = keyed(plain, f"_c{names.index(text)}", f"_c{names.index(doc_id)}")
    keys = written(rows.select(*KEYS, "_size"), "keys")
    total = keys.agg(F.sum("_size")).head()[0] or 0
    parts = max(1, -(-total // (shards * part_bytes)))
    found = splitters(keys, shards, parts, probes, group_share, row_share)
    shared = docs.sparkSession.sparkContext.broadcast(as_array([min(s.key, WORD**3 - 1) for s in found]))

    below = [0, *(s.rows for s in found)]
    first = docs.sparkSession.sparkContext.broadcast(np.array([below[p] - below[p - p % parts] for p in range(len(below))]))

    @F.arrow_udf("struct<part:int,first:long>")
    def part(h: pa.Array, d: pa.Array, i: pa.Array) -> pa.Array:
        """The part of each key, and the rows of its shard that stand before this part."""
        at = np.searchsorted(shared.value, packed_keys([x.to_numpy() for x in (h, d, i)]), "right")
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(first.value[at], pa.int64())], ["part", "first"])

    dealt = rows.withColumn("_p", part(*KEYS)).withColumns({"_part": F.col("_p.part"), "_first": F.col("_p.first")}).drop("_p").repartition(shards * parts, "_part")
    slot = F.col("_first") + F.row_number().over(Window.partitionBy("_part").orderBy(*KEYS)) - 1
    columns = [F.col(f"_c{i}").alias(name) for i, name in enumerate(names)]
    return dealt.select(*columns, F.col("_size").alias("size"), F.floor(F.col("_part") / parts).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard (``shard=0``, ...), its rows in slot order within each file."""
    sharded.write.partitionBy("shard").parquet(path)
