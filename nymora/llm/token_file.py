"""Token ids in a binary file of independent blocks, coded by a static range asymmetric numeral system.

Format. One frequency table for the whole file: counts of all ids, scaled to 2**18 with each id that occurs at 1 or more.
A block holds consecutive ids of whole documents in ascending doc_id order. Its ids are dealt in turn to ``LANES`` coders
(interleaving); every coder has a 64-bit state in [2**31, 2**63) and all share one stream of 32-bit words. A block:

    magic "NYR1", n_ids u64, n_words u64, n_checkpoints u32, crc32 of all ids u32, crc32 of the words u32,
    per checkpoint: step u64, word position u64, LANES states u64; then the words

A checkpoint restarts decoding at its step, so that the parts of a block can be decoded in parallel; the first is at step 0.
Blocks lie in Parquet files of the shared folder beside the lengths of their documents, one row a block.

Defined cases: a null or empty text is its end id alone; rows with the same doc_id are ordered by a hash of the text; null
doc_ids come first; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written
from .tokens import default_path, encoder

SCALE, LANES, LOW, EVERY = 18, 1024, 1 << 31, 128
MAGIC, HEAD = b"NYR1", struct.Struct("<4sQQIII")
BLOCKS = "part int, block int, doc_ids array<long>, lengths array<int>, payload binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 where the count is positive; whole numbers only, so equal on every machine."""
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), "uint64")
    if int((counts > 0).sum()) > size:
        raise ValueError("more ids occur than the table has room for")
    freq = np.array([max(1, int(c) * size // total) if c else 0 for c in counts.tolist()], "int64")
    order = np.argsort(-freq, kind="stable")
    rest, i = size - int(freq.sum()), 0
    if rest > 0:
        freq[order[0]] += rest
    while rest < 0:
        take = min(-rest, int(freq[order[i]]) - 1)
        freq[order[i]] -= take
        rest, i = rest + take, i + 1
    return freq.astype("uint64")


class Table:
    def __init__(self, counts: np.ndarray):
        self.freq = scaled(counts)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype("uint64")
        #: States from here on give a word away first.
        self.most = self.freq << np.uint64(63 - SCALE)
        # By the low bits of a state: its id, and that one's frequency and the place among its slots.
        self.symbol = np.repeat(np.arange(len(counts), dtype="uint32"), self.freq.astype("int64"))
        self.of_slot = self.freq[self.symbol]
        self.within = np.arange(len(self.symbol), dtype="uint64") - self.start[self.symbol]


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One block; ids are an array of unsigned 32-bit integers."""
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, LOW, "uint64")
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    n_words = 0
    freq, most, start = table.freq[ids], table.most[ids], table.start[ids]
    for step in range(steps - 1, -1, -1):
        part = slice(step * LANES, min(len(ids), (step + 1) * LANES))
        f, x = freq[part], state[: part.stop - part.start]
        over = np.flatnonzero(x >= most[part])
        if len(over):
            full = x[over]
            words.append(full.astype("<u4"))  # their low 32 bits
            n_words += len(over)
            x[over] = full >> np.uint64(32)
        # x // f * 2**SCALE + x % f + start
        q = x // f
        x += q * (np.uint64(1 << SCALE) - f)
        x += start[part]
        if step % EVERY == 0:
            marks.append((step, n_words, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    head = HEAD.pack(MAGIC, len(ids), n_words, len(marks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(stream.tobytes()))
    points = b"".join(struct.pack("<QQ", step, n_words - at) + s.astype("<u8").tobytes() for step, at, s in marks[::-1])
    return head + points + stream.tobytes()


def checkpoints(block: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(step, word position, states) of each checkpoint."""
    n = HEAD.unpack_from(block)[3]
    size = 16 + 8 * LANES
    at = [HEAD.size + i * size for i in range(n)]
    return [(*struct.unpack_from("<QQ", block, p), np.frombuffer(block, "<u8", LANES, p + 16)) for p in at]


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of checkpoints ``first`` up to ``last`` (all by default); a whole block is checked against its checksums."""
    magic, n, n_words, n_marks, crc, words_crc = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    stream = np.frombuffer(block, "<u4", n_words, len(block) - 4 * n_words)
    if zlib.crc32(stream.tobytes()) != words_crc:
        raise ValueError("the words of a block don't match their checksum")
    out = np.zeros(n, "<u4")
    if not n:
        return out
    marks = checkpoints(block)
    begin, pos, state = marks[first]
    last = n_marks if last is None else last
    steps = marks[last][0] if last < n_marks else -(-n // LANES)
    state, mask, scale = state.astype("uint64"), np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for step in range(begin, steps):
        width = min(LANES, n - step * LANES)
        x = state[:width]
        slot = x & mask
        out[step * LANES : step * LANES + width] = table.symbol[slot]
        x = table.of_slot[slot] * (x >> scale) + table.within[slot]
        low = np.flatnonzero(x < np.uint64(LOW))
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | stream[pos : pos + len(low)]
            pos += len(low)
        state[:width] = x
    out = out[begin * LANES : min(n, steps * LANES)]
    if len(out) == n and zlib.crc32(out.tobytes()) != crc:
        raise ValueError("the ids of a block don't match their checksum")
    return out


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, block_ids: int = 1 << 19, text: str = "text", doc_id: str = "doc_id", part_bytes: int = 256 << 20) -> None:
    """Write ``docs`` to ``path``: blocks/ and table/ (the counts of ids).

    Texts are dealt into ranges of doc_id, of about ``part_bytes`` of text at most (their place in the table parts equal rows), and encoded once; the ids wait in a spool of blocks (compressed, 16 bits each where
    they fit) until all have been counted, and are coded block by block from there. The count table has as many rows as
    the vocabulary at most.
    """
    tokenizer_path = tokenizer_path or default_path()
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("_tie"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("text"))

    def spooled(batches):
        from pyspark import TaskContext

        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        held, size, n = [], 0, 0

        def flush():
            ids = np.concatenate([x for _, x in held])
            narrow = ids.astype("<u2") if ids.max() < 1 << 16 else ids
            rows = [part], [n], [[d for d, _ in held]], [[len(x) for _, x in held]], [zstandard.compress(narrow.tobytes(), 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), encode.each(batch.column(1)), strict=True):
                held.append((doc, x))
                size += len(x)
                if size >= block_ids:
                    yield flush()
                    held, size, n = [], 0, n + 1
        if held:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    spool = written(dealt.select("doc_id", "text").mapInArrow(spooled, BLOCKS), "spool")

    def unspooled(lengths, payload) -> np.ndarray:
        raw, n = zstandard.decompress(payload), int(np.sum(lengths))
        return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")

    def count(batches):
        total = np.zeros(1 << 16, "int64")
        for batch in batches:
            for lengths, payload in zip(batch["lengths"], batch["payload"], strict=True):
                got = np.bincount(unspooled(lengths, payload))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        found = np.flatnonzero(total)
        yield pd.DataFrame({"id": found, "n": total[found]})

    spool.select("lengths", "payload").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(read_counts(spark, path))

    def coded(batches):
        made = Table(table.value)
        for batch in batches:
            batch["payload"] = [encode_block(unspooled(n, x).astype("uint32"), made) for n, x in zip(batch["lengths"], batch["payload"], strict=True)]
            yield batch

    spool.mapInPandas(coded, BLOCKS).write.parquet(f"{path}/blocks")


def read_counts(spark: SparkSession, path: str) -> np.ndarray:
    """The counts of the file's table by id."""
    rows = spark.read.parquet(f"{path}/table").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, "int64")
    counts[rows["id"].to_numpy(dtype="int64")] = rows["n"].to_numpy(dtype="int64")
    return counts


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of a written file, decoded block by block."""
    table = spark.sparkContext.broadcast(read_counts(spark, path))

    def decode(batches):
        made = Table(table.value)
        for batch in batches:
            for docs, lengths, payload in zip(batch["doc_ids"], batch["lengths"], batch["payload"], strict=True):
                cuts = np.split(decode_block(bytes(payload), made).astype("int64"), np.cumsum(lengths)[:-1])
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], "Int64"), "ids": cuts})

    return spark.read.parquet(f"{path}/blocks").select("doc_ids", "lengths", "payload").mapInPandas(decode, "doc_id long, ids array<long>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the file alone.

    Ids before a block are summed from the lengths; there is one row a block, and only one number for each of the
    file's parts is gathered on the driver.
    """
    table = spark.sparkContext.broadcast(read_counts(spark, path))
    stored = spark.read.parquet(f"{path}/blocks")
    sizes = stored.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n

    def decode(batches):
        made = Table(table.value)
        for batch in batches:
            for part, block, docs, lengths, payload in zip(batch["part"], batch["block"], batch["doc_ids"], batch["lengths"], batch["payload"], strict=True):
                ids = decode_block(bytes(payload), made)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(x.tobytes()) for x in np.split(ids, ends[:-1])]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], "Int64"), "part": part, "block": block, "start": ends - lengths, "n_tokens": lengths, "ids_crc32": crc, "block_ids": len(ids)})

    got = stored.mapInPandas(decode, "doc_id long, part int, block int, start long, n_tokens long, ids_crc32 long, block_ids long")
    blocks = stored.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = spark.createDataFrame(list(before.items()), "part int, _first long")
    ahead = blocks.select("part", "block", ahead.alias("_ahead")).join(F.broadcast(firsts), "part").select("part", "block", (F.col("_ahead") + F.col("_first")).alias("_before"))
    return got.join(ahead, ["part", "block"]).select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` to a file in the shared folder and digest it."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/nymora-tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path)
    return digest(spark, path)
