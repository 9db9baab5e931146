"""Substrings of texts that may equal one of many given values, found without a row for each character.

The values' hashes set bits of a map of 2**``bits`` bits, which Spark aggregates and every task receives (16 MB at most by default, however
many values there are). A text's windows of the values' lengths become rows only where their bit is set; a join on equality decides
afterwards. With v values about v / 2**bits of all windows pass without need.

One pass over a text sums ``code * MULTIPLIER**place`` (modulo 2**64); the hash of any window is a difference of two sums, shifted to place 0. So a length more
costs one subtraction for each place where a value may begin, whatever the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 27
#: Characters of short texts that are read as one array: a numpy call costs as much as some hundred characters.
TOGETHER = 1 << 18
MULTIPLIER, MIXER = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept, at the longest size that was asked for."""
    had = _powers.get(base)
    if had is None or len(had) < n:
        row = np.full(max(1024, 1 << (n - 1).bit_length()), base, "uint64")
        row[0] = 1
        had = _powers[base] = np.cumprod(row, dtype="uint64")
    return had[:n]


class Sums:
    """The prefix sums of a text."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.sums = np.zeros(len(self.codes) + 1, "uint64")
        np.cumsum(self.codes.astype("uint64") * powers(MULTIPLIER, len(self.codes)), out=self.sums[1:], dtype="uint64")

    def buckets(self, at: np.ndarray, size: int, bits: int) -> np.ndarray:
        """The bit numbers of the windows of ``size`` characters that begin at ``at``."""
        found = (self.sums[at + size] - self.sums[at]) * powers(INVERSE, len(self.sums))[at] + np.uint64(size)
        found = (found ^ (found >> np.uint64(32))) * MIXER
        return (found >> np.uint64(64 - bits)).astype("int64")


class Nominator:
    """What every task receives: the map, and by first character the values' lengths."""

    def __init__(self, held: np.ndarray, sizes: list[int], firsts: str, bits: int):
        self.held, self.sizes, self.firsts, self.bits = held, sizes, firsts, bits
        self._begins: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_begins": None}

    def find(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the windows that may equal a value, by length, then by start."""
        return [(a, b) for _, a, b in self.find_all([text])]

    def find_all(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, start, end) of the windows of each text that may equal a value. Short texts are read together, as one array."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > TOGETHER:
                yield from self._among(texts, first, i)
                first, size = i, 0
            size += len(t)
        yield from self._among(texts, first, len(texts))

    def _among(self, texts: list[str], first: int, last: int) -> Iterator[tuple[int, int, int]]:
        if not self.sizes or first == last:
            return
        if self._begins is None:
            self._begins = np.zeros(0x110000, "bool")
            self._begins[[ord(c) for c in self.firsts]] = True
        sums = Sums("".join(texts[first:last]))
        begins = np.flatnonzero(self._begins[sums.codes])
        if not len(begins):
            return
        ends = np.cumsum([len(t) for t in texts[first:last]])
        number = np.searchsorted(ends, begins, "right")
        base, left = (ends - [len(t) for t in texts[first:last]])[number], ends[number] - begins
        for size in self.sizes:
            fits = np.flatnonzero(left >= size)
            at = begins[fits]
            bit = sums.buckets(at, size, self.bits)
            hit = fits[(self.held[bit >> 3] >> (bit & 7).astype("uint8") & 1).astype("bool")]
            start = begins[hit] - base[hit]
            yield from zip((number[hit] + first).tolist(), start.tolist(), (start + size).tolist(), strict=True)


def whole_buckets(pieces: list[str], bits: int) -> np.ndarray:
    """The bit number of each piece as a whole."""
    out = np.zeros(len(pieces), "int64")
    sizes = np.fromiter(map(len, pieces), "int64", len(pieces))
    groups = np.cumsum(sizes) // TOGETHER
    for group in np.unique(groups):
        own = np.flatnonzero(groups == group)
        sums, starts = Sums("".join(pieces[i] for i in own)), np.cumsum(sizes[own]) - sizes[own]
        for size in np.unique(sizes[own]):
            same = sizes[own] == size
            out[own[same]] = sums.buckets(starts[same], int(size), bits)
    return out


def bit_map(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A map of 2**``bits`` bits (15 or more) with those of the ``values`` set, as bytes."""

    @F.arrow_udf("long")
    def bucket(pieces: pa.Array) -> pa.Array:
        return pa.array(whole_buckets(pieces.to_pylist(), bits), pa.int64())

    held = values.select((bucket(F.col(column)) + 1).alias("bit"))  # Spark's bitmap functions count bits from 1
    part = F.expr("bitmap_bucket_number(bit)").alias("part")
    parts = held.groupBy(part).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("held"))
    out = np.zeros((1 << bits) // 8, "uint8")
    for number, held_bytes in parts.collect():  # 4,096 bytes each, 2**bits / 32,768 of them at most
        begin = (number - 1) * 4096
        out[begin : begin + len(held_bytes)] = np.frombuffer(held_bytes, "uint8")
    return out


def nominator(values: DataFrame, column: str, bits: int = BITS) -> Nominator:
    """For the ``values`` that aren't empty. The driver holds the map, the distinct lengths and the distinct first characters."""
    values = values.where(F.length(column) > 0)
    kinds = values.agg(F.collect_set(F.length(column)), F.collect_set(F.substring(column, 1, 1))).head()
    return Nominator(bit_map(values, column, bits), sorted(kinds[0]), "".join(kinds[1]), bits)


def nominated(df: DataFrame, text: str, keep: list[str], values: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``keep``, at (from 0) and piece for all windows of ``text`` that equal one of the ``values``, and for few others."""
    shared = df.sparkSession.sparkContext.broadcast(nominator(values, column, bits))

    @F.arrow_udf("array<struct<at:int,piece:string>>")
    def look(texts: pa.Array) -> pa.Array:
        texts = [t or "" for t in texts.to_pylist()]
        own = [[] for _ in texts]
        for i, a, b in shared.value.find_all(texts):
            own[i].append((a, texts[i][a:b]))
        out, ends = [x for xs in own for x in xs], [0, *accumulate(map(len, own))]
        rows = pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], ["at", "piece"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return df.select(*keep, F.explode(look(F.col(text))).alias("_w")).select(*keep, "_w.at", "_w.piece")
