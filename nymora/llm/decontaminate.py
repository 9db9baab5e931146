"""Benchmark decontamination as a prefix-filtered set join of shingles.

Items and documents are word sequences. A window is 13 consecutive words of an item (all its words, if fewer). A window's
shingles (5 words, or all of a shorter window) are ordered by rarity, counted over all documents. As a window must be contained
whole, its rarest shingle alone is the necessary prefix: documents are joined on it. The shingle's place in the window and
the document's ends bound where the window can lie, and the words there are compared exactly.

The benchmark is broadcast in blocks of ``block_bytes`` of text; beyond one block the documents pass by the blocks in turn,
and what each has found is written to the shared folder between. Documents are never shuffled.

Defined cases: a null or wordless text has no words and isn't contaminated; a null or wordless item has no window; items with a
null id are called ``null``; items of the same id count once; repeated document rows are judged each; with an empty
benchmark nothing is hit; columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import slices

WINDOW, SHINGLE = 13, 5
#: Lower-cases A-Z and makes a space of every ASCII character that isn't a letter or digit.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NOTHING = hashlib.sha256(b"").hexdigest()
RESULT = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")]
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of words of each)."""
    if not len(texts):
        return pa.array([], pa.large_binary()), np.zeros(0, "int64")
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = data[int(at[0]) : int(at[-1])].to_pybytes().translate(WORDS) if data is not None else b""
    clean = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at - at[0]), pa.py_buffer(raw)])
    parts = pc.split_pattern(clean, b" ")
    ends = parts.offsets.to_numpy()
    words = parts.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(kept[ends - ends[0]])


def shingle_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive codes; 0 where one of them is 0."""
    n = max(0, len(codes) - k + 1)
    h, good = np.zeros(n, "uint64"), np.ones(n, bool)
    for i in range(k):
        c = codes[i : i + n]
        h = (h + c.astype("uint64")) * FACTOR
        h ^= h >> np.uint64(29)
        good &= c > 0
    return np.where(good, h | np.uint64(1), np.uint64(0))


class Index:
    """The windows of some items, by length; ``order`` picks each window's prefix shingle by the counts over all documents."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        names = sorted({"null" if i is None else str(i) for i, _ in items})
        rank = {name: n for n, name in enumerate(names)}
        words, counts = split_words(pa.array([t for _, t in items], pa.large_string()))
        coded = words.dictionary_encode()
        self.names, self.vocabulary = names, coded.dictionary
        codes = coded.indices.to_numpy().astype("int64") + 1 if len(words) else np.zeros(0, "int64")
        found: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        ends = np.cumsum(counts)
        for (name, _), n, end in zip(items, counts.tolist(), ends.tolist(), strict=True):
            own = codes[end - n : end].tolist()
            size = min(n, WINDOW)
            for i in range(n - size + 1 if n else 0):
                found[size][tuple(own[i : i + size])].add(rank["null" if name is None else str(name)])
        self.windows = {size: np.array(list(by), "int32") for size, by in found.items()}
        self.items = {size: [sorted(x) for x in by.values()] for size, by in found.items()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def shingles(self) -> dict[int, np.ndarray]:
        """The distinct shingle hashes by shingle length."""
        out: dict[int, list[np.ndarray]] = defaultdict(list)
        for size, w in self.windows.items():
            k = min(size, SHINGLE)
            out[k].append(self._hashes(w, k).ravel())
        return {k: np.unique(np.concatenate(x)) for k, x in out.items()}

    @staticmethod
    def _hashes(w: np.ndarray, k: int) -> np.ndarray:
        flat = shingle_hashes(np.pad(w, ((0, 0), (0, 1))).ravel(), k)
        width = w.shape[1] + 1
        return np.pad(flat, (0, k - 1)).reshape(len(w), width)[:, : w.shape[1] - k + 1]

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """counts: by shingle length and hash."""
        for size, w in self.windows.items():
            k = min(size, SHINGLE)
            own, back = np.unique(h := self._hashes(w, k), return_inverse=True)
            n = np.array([counts.get((k, int(x)), 0) for x in own.tolist()], "int64")
            offset = np.argmin(n[back.reshape(h.shape)], axis=1)  # the first of equally rare ones
            token = h[np.arange(len(w)), offset]
            by = np.argsort(token, kind="stable")
            tokens, first = np.unique(token[by], return_index=True)
            self.prefix[size] = (tokens, np.append(first, len(by)), by, offset[by])

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes with a 0 after each text, start and number of words of each text)."""
        words, n = split_words(texts)
        codes = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy().astype("int32") + 1
        starts = np.cumsum(n + 1) - (n + 1)
        return np.insert(codes, np.cumsum(n), 0), starts, n

    def find(self, codes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(text, start, end in the text) of each occurrence of a window, and the (text, item) pairs."""
        out, pairs = [], set()
        hashes: dict[int, np.ndarray] = {}
        for size, (tokens, first, window, offset) in self.prefix.items():
            k = min(size, SHINGLE)
            if k not in hashes:
                h = shingle_hashes(codes, k)
                some = np.flatnonzero(h)
                hashes[k] = np.stack([some.astype("uint64"), h[some]]) if len(some) else np.zeros((2, 0), "uint64")
            places, h = hashes[k]
            at = np.searchsorted(tokens, h)
            same = tokens[np.minimum(at, len(tokens) - 1)] == h
            places, at = places[same].astype("int64"), at[same]
            count = first[at + 1] - first[at]
            entry = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            start = np.repeat(places, count) - offset[entry]
            text = np.searchsorted(starts, np.repeat(places, count), "right") - 1
            fits = (start >= starts[text]) & (start + size <= starts[text] + n[text])
            start, text, win = start[fits], text[fits], window[entry[fits]]
            for i in range(0, len(start), 1 << 18):
                some = slice(i, i + (1 << 18))
                equal = (codes[start[some, None] + np.arange(size)] == self.windows[size][win[some]]).all(1)
                t, s = text[some][equal], (start[some] - starts[text[some]])[equal]
                out.append((t, s, s + size))
                for x, w in set(zip(t.tolist(), win[some][equal].tolist(), strict=True)):
                    pairs.update((x, item) for item in self.items[size][w])
        t, s, e = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, "int64"),) * 3
        return t, s, e, sorted(pairs)


def _covered(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans that cover the same words, in order; spans has a row (start, end) each."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)))).head()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        yield b == n - 1, [tuple(r) for r in benchmark.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == b).select(F.col(item_id).cast("string"), text).collect()]


def judge(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The ``keep`` columns of each document with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit at least a twentieth of n_words)."""
    spark = docs.sparkSession
    names = {name for name, _ in RESULT}
    kept = [c for c in keep if c not in names]
    rows = docs.select(*kept, F.col(text).alias("_text"))
    passed: DataFrame | None = None
    for last, items in _blocks(benchmark, item_id, item_text, block_bytes):
        index = Index(items)
        wanted = spark.sparkContext.broadcast((index, index.shingles()))

        def count(batches, wanted=wanted):
            index, shingles = wanted.value
            total = {k: np.zeros(len(x), "int64") for k, x in shingles.items()}
            for batch in batches:
                for _, part in slices(batch.column(0)):
                    codes = index.coded(part)[0]
                    for k, x in shingles.items():
                        h = shingle_hashes(codes, k)
                        h = h[h > 0]
                        at = np.minimum(np.searchsorted(x, h), len(x) - 1)
                        total[k] += np.bincount(at[x[at] == h], minlength=len(x))
            for k, n in total.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, "int32")), pa.array(shingles[k][some].view("int64")), pa.array(n[some])], ["k", "h", "n"])

        counted = rows.select("_text").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()
        index.order({(k, h & 0xFFFFFFFFFFFFFFFF): n for k, h, n in counted})
        passed = _pass(rows if passed is None else passed, index, kept, last, passed is not None)
        if not last:
            passed = written(passed, "hits")
    return passed


def _pass(rows: DataFrame, index: Index, kept: list[str], last: bool, carried: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)
    fields = [f for f in rows.schema.fields if f.name in kept]
    if last:
        fields += [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in RESULT]
    else:
        fields += [T.StructField("_text", T.StringType()), T.StructField("_spans", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.StringType()))]

    def find(batches):
        index = shared.value
        for batch in batches:
            for first, part in slices(batch.column("_text")):
                codes, starts, n = index.coded(part)
                t, s, e, pairs = index.find(codes, starts, n)
                spans: dict[int, list] = defaultdict(list)
                items: dict[int, list[str]] = defaultdict(list)
                for x, a, b in zip(t.tolist(), s.tolist(), e.tolist(), strict=True):
                    spans[x].append((a, b))
                for x, item in pairs:
                    items[x].append(index.names[item])
                if carried:
                    for x, (flat, names) in enumerate(zip(batch.column("_spans").slice(first, len(part)).to_pylist(), batch.column("_items").slice(first, len(part)).to_pylist(), strict=True)):
                        if flat:
                            spans[x] += zip(flat[::2], flat[1::2], strict=True)
                            items[x] += names
                cover = {x: _covered(np.array(v)) for x, v in spans.items()}
                own = [batch.column(c).slice(first, len(part)) for c in kept]
                if not last:
                    made = [part, pa.array([cover[x].ravel().tolist() if x in cover else [] for x in range(len(part))], pa.list_(pa.int64())), pa.array([sorted(set(items.get(x, ()))) for x in range(len(part))], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*own, *made], [*kept, "_text", "_spans", "_items"])
                    continue
                hit, n_items, digest = np.zeros(len(part), "int64"), np.zeros(len(part), "int64"), [NOTHING] * len(part)
                for x, c in cover.items():
                    ids = sorted(set(items[x]))
                    hit[x], n_items[x], digest[x] = int((c[:, 1] - c[:, 0]).sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype("int64")), pa.array(hit), pa.array(n_items), pa.array(digest), pa.array((hit > 0) & (20 * hit >= n))], [*kept, *(name for name, _ in RESULT)])

    return rows.mapInArrow(find, T.StructType(fields))
