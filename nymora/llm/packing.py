"""Packing token ids into sequences: first-fit decreasing with a tournament tree of bin capacities, in random groups of documents.

A document is cut at multiples of the sequence length; its pieces are placed by length, longest first, each in the first
sequence with room. Groups are drawn by a hash of the row's number, so that each is a fair sample of lengths, holds
``docs_per_group`` documents on average at any size of the input, and is packed by itself: only (document, start, length,
checksum) rows are shuffled, never ids. Rows are numbered before, so that repeated ones fall into different groups. ``sequence_id`` is ``group * 2**31 + number in the group``.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives no rows; other
columns are ignored; a null doc_id is kept as null. Ties in length are taken by document, start and checksum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import default_path, encoder

PIECES = "doc_id long, _row long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free room of bins 0, 1, 2, ...; the winner of each match is the larger room, so the first bin with enough is found in log steps."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with at least ``need``; the room is taken."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        had = room[at]
        room[at] = had - need
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths are taken longest first, equal ones in the order given."""
    bins, offsets = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    tree = Tournament(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], had = tree.place(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of each document."""

    def cut(batches):
        encode = encoder(tokenizer_path)
        for batch in batches:
            out = []
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encode.each(batch.column(2)), strict=True):
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append((doc, row, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            names = ["doc_id", "_row", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6, names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, docs_per_group: int = 4096, seed: int = 7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of ``docs`` with their sequence and offset there."""
    cut = written(pieces(docs, tokenizer_path or default_path(), capacity, text, doc_id), "pieces")
    n_docs = cut.where("start = 0").count()
    groups = max(1, -(-n_docs // docs_per_group))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = frame["_group"].astype("int64") * 2**31 + bins
        frame["offset"] = offsets
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(packed, PACKED)
