"""SimHash near-duplicates by pivot distance tables.

Fingerprints of 64 bits come from word shingles. Equal fingerprints are one point, so copies never make pairs. Each point gets
a row of the pivot table: its Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle inequality two points within
``distance`` bits differ by that much at most in every coordinate, so pairs with a larger coordinate difference are discarded
and only the survivors are compared bit by bit.

So that not all pairs meet, points are dealt into cells: the 64 bits are cut into 6 blocks, of which at most 3 can hold the 3
differing bits, so two linked points agree on some 3 whole blocks; each of the 20 choices makes a cell from the 3 blocks'
bits. A cell is sorted by the first coordinate, and neighbours in that order are taken until it differs by more than
``distance``. Cells with more than ``cell_points`` points are cut into chunks and each pair of chunks is a task of its own: bounded
memory, but n * n / cell_points rows for a cell of n points. A task gives links that connect what is linked in it (a spanning
forest), not all its pairs.

``deduplicated`` is the same filter for texts of a given similarity: wider distances, other cells, and whole sets of shingles compared.

Defined cases: a null or wordless text has the fingerprint zero, linked like any other; rows with a null doc_id take part and get
the smallest id of their component (null, if all are null); repeated rows are kept each; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected, written

PIVOTS = 24
BLOCKS = (11, 11, 11, 11, 10, 10)
CHOICES = tuple(combinations(range(len(BLOCKS)), 3))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed sequence of well-mixed 64-bit numbers."""
    x = np.arange(1, n + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of a text: words between ASCII white space, A-Z lower-cased, shingles of ``size`` words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        h = np.array([digest(joined, 42)], "uint64")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[: -size] + 1])
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins.tolist(), ends[size - 1 :].tolist(), strict=True)), "uint64", len(begins))
    ones = np.zeros(64, "int64")
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """The ``keep`` columns of each row and ``_fp``, the fingerprint as a signed long."""

    def made(batches):
        from .tokens import slices

        for batch in batches:
            fp = np.fromiter([fingerprint(t, size) for _, part in slices(batch.column("_text")) for t in part.to_pylist()], "uint64", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view("int64"))], [*keep, "_fp"])

    schema = T.StructType([*(f for f in docs.select(*keep).schema.fields), T.StructField("_fp", T.LongType())])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(made, schema)


def _cells(points: DataFrame) -> DataFrame:
    """(node, fp, cell): a row for each choice of three blocks."""
    starts = np.cumsum((0, *BLOCKS))[:-1].tolist()
    part = [F.shiftrightunsigned("fp", starts[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1)) for i in range(len(BLOCKS))]
    keys = []
    for n, chosen in enumerate(CHOICES):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(part[i])
        keys.append(key)
    return points.select(F.col("fp").alias("node"), "fp", F.explode(F.array(*keys)).alias("cell"))


class Sets:
    """Disjoint sets of 0, 1, 2, ..."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        """False if they were together before."""
        p, q = self.find(i), self.find(j)
        self.root[max(p, q)] = min(p, q)
        return p != q

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        while (self.root != (up := self.root[self.root])).any():
            self.root = up
        return self.root[i] != self.root[j]


def near_pairs(fp: np.ndarray, task: np.ndarray, side: np.ndarray, distance: int, n_pivots: int = PIVOTS, sets: Sets | None = None):
    """Arrays (i, j) of rows of the same task within ``distance`` bits, a few at a time.

    ``side`` is 0 where all pairs of a task count; of 1 and 2, only pairs of both. Pairs that ``sets`` hold together by then are left out.
    """
    table = np.stack([np.bitwise_count(fp ^ p) for p in pivots(n_pivots)]).astype("int8")
    order = np.lexsort((table[0], task))
    table, ofp, otask, oside = table[:, order], fp[order], task[order], side[order]
    live, step = np.arange(len(fp) - 1), 1
    while len(live):
        live = live[live + step < len(fp)]
        there = live + step
        near = (otask[live] == otask[there]) & (table[0][there] - table[0][live] <= distance)
        live = live[near]  # later neighbours lie further away
        i, j = live, live + step
        alone = (oside[i] == 0) | (oside[i] != oside[j])
        i, j = i[alone], j[alone]
        if sets is not None:
            apart = sets.apart(order[i], order[j])
            i, j = i[apart], j[apart]
        for row in table[1:]:
            fits = np.abs(row[i] - row[j]) <= distance
            i, j = i[fits], j[fits]
        close = np.bitwise_count(ofp[i] ^ ofp[j]) <= distance
        if close.any():
            yield order[i[close]], order[j[close]]
        step += 1


def forest(fp: np.ndarray, task: np.ndarray, side: np.ndarray, distance: int, n_pivots: int = PIVOTS) -> tuple[list[int], list[int]]:
    """Rows (a, b) that connect the points of each task as far as they are within ``distance``."""
    sets = Sets(len(fp))
    a, b = [], []
    for i, j in near_pairs(fp, task, side, distance, n_pivots, sets):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if sets.join(x, y):
                a.append(x)
                b.append(y)
    return a, b


def _dealt(cells: DataFrame, chunks, chunked: bool) -> DataFrame:
    """``cells`` with i, j and side: tasks of pairs of chunks, so that a large cell is no single task."""
    if not chunked:
        return cells.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    out = cells.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("pair", F.explode(pairs))
    side = F.when(F.col("pair.i") == F.col("pair.j"), 0).when(F.col("mine") == F.col("pair.i"), 1).otherwise(2).cast("int")
    return out.withColumns({"i": F.col("pair.i"), "j": F.col("pair.j"), "side": side}).drop("pair", "mine", "chunks")


def _by_task(rows: DataFrame, key: str, done, at_once: int, result: str, weigh=len) -> DataFrame:
    """``done(frame, task)`` of the rows, all rows of a task (key, i, j) in the same call; small tasks share calls of about ``at_once``, as ``weigh`` counts a frame."""
    keys = [key, "i", "j"]

    def run(batches):
        held: list[pd.DataFrame] = []
        size = 0

        def call(frame: pd.DataFrame) -> pd.DataFrame:
            return done(frame, (frame[keys].diff() != 0).any(axis=1).cumsum().to_numpy())

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += weigh(batch)
            if size >= at_once and (held[0][keys].iloc[0] != batch[keys].iloc[-1]).any():  # else all are of one task, which goes on
                frame = pd.concat(held, ignore_index=True)
                same = (frame[keys] == frame[keys].iloc[-1]).all(axis=1)
                yield call(frame[~same].reset_index(drop=True))
                held = [frame[same]]
                size = weigh(held[0])
        if held:
            yield call(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, result)


def links(cells: DataFrame, distance: int, cell_points: int = 2048, n_pivots: int = PIVOTS) -> DataFrame:
    """(a, b) nodes that connect the points of each cell as far as they are within ``distance`` bits; cells: node, fp, cell."""
    sizes = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "cells")
    large = sizes.where(F.col("n") > cell_points).limit(1).count() > 0
    rows = _dealt(cells.join(sizes, "cell"), F.ceil(F.col("n") / cell_points).cast("int"), large)

    def linked(frame: pd.DataFrame, task: np.ndarray) -> pd.DataFrame:
        a, b = forest(frame["fp"].to_numpy("int64").view("uint64"), task, frame["side"].to_numpy(), distance, n_pivots)
        node = frame["node"].to_numpy("int64")
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return _by_task(rows.select("node", "fp", "cell", "i", "j", "side"), "cell", linked, 50_000, "a long, b long").distinct()


def components(fps: DataFrame, distance: int = 3, cell_points: int = 2048) -> DataFrame:
    """(fp, component_id): for each distinct ``_fp`` of ``fps`` (with doc_id), the smallest doc_id of its component."""
    first = F.min("doc_id")
    if not 0 <= distance <= 3:
        raise ValueError("cells are made for at most 3 differing bits")
    points = written(fps.groupBy(F.col("_fp").alias("fp")).agg(first.alias("first")), "points")
    rooted = connected(links(_cells(points.select("fp")), distance, cell_points))
    all_ = points.join(rooted, points["fp"] == rooted["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = all_.groupBy("root").agg(F.min("first").alias("component_id"))
    return all_.join(best, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 3, size: int = 3, cell_points: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    fps = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", size), "fps")
    groups = components(fps, distance, cell_points)
    joined = fps.join(groups, fps["_fp"] == groups["fp"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similar texts ---------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingled(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all texts, number of words of each, shingle hashes of all texts, number of shingles of each).

    Words are those of ``fingerprint``; a text of fewer than ``size`` words, but not none, has one shingle.
    """
    import xxhash

    words = [(t or "").encode().lower().split() for t in texts.to_pylist()]
    n = np.fromiter(map(len, words), "int64", len(words))
    own = {w: xxhash.xxh64_intdigest(w, 42) for w in {w for x in words for w in x}}
    h = np.fromiter((own[w] for x in words for w in x), "uint64", int(n.sum()))
    m = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = np.cumsum(n) - n
    begin = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    left = np.repeat(first + n, m) - begin
    out = np.zeros(len(begin), "uint64")
    for i in range(size):
        here = h[np.minimum(begin + i, len(h) - 1)] if len(h) else out
        out = np.where(left > i, _mixed(out * np.uint64(0x9E3779B97F4A7C15) + here + np.uint64(i + 1)), out)
    return h, n, out, m


def sketches(texts: pa.Array, size: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of the words, ``bands`` keys) of each text; a key is made of the least values of ``rows`` hashes of its shingles."""
    h, n, shingle, m = shingled(texts, size)
    ones = np.zeros((len(n), 64), "int64")
    first = np.cumsum(n) - n
    for t in np.flatnonzero(n).tolist():
        own = h[first[t] : first[t] + n[t]]
        for i in range(0, len(own), 1 << 14):
            ones[t] += np.unpackbits(own[i : i + (1 << 14)].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    fp = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    keys = np.zeros((len(n), bands), "uint64")
    some, begin = np.flatnonzero(m), (np.cumsum(m) - m)[m > 0]
    for band in range(bands if len(some) else 0):
        key = np.full(len(some), band, "uint64")
        for row in range(rows):
            least = np.minimum.reduceat(_mixed(shingle ^ np.uint64(0xD1B54A32D192ED03 * (band * rows + row + 1) % 2**64)), begin)
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[some, band] = key
    return fp, keys


def _sketched(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tie, a, b, fp, cells) of each row of docs (doc_id, tie, text); a and b identify the sequence of words."""
    import xxhash

    from .tokens import slices

    def made(batches):
        for batch in batches:
            for start, part in slices(batch.column("text")):
                fp, keys = sketches(part, size, bands, rows)
                whole = [xxhash.xxh3_128_intdigest(b" ".join((t or "").encode().lower().split())) for t in part.to_pylist()]
                a, b = (np.fromiter((x >> shift & (2**64 - 1) for x in whole), "uint64", len(part)) for shift in (64, 0))
                cells = pa.FixedSizeListArray.from_arrays(pa.array(keys.view("int64").ravel()), bands).cast(pa.list_(pa.int64()))
                own = [batch.column(c).slice(start, len(part)) for c in ("doc_id", "tie")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.view("int64")) for x in (a, b, fp)), cells], ["doc_id", "tie", "a", "b", "fp", "cells"])

    schema = T.StructType([*docs.select("doc_id", "tie").schema.fields, *(T.StructField(c, T.LongType()) for c in ("a", "b", "fp")), T.StructField("cells", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "tie", "text").mapInArrow(made, schema)


def parities(shingles: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of ``bits`` bits (a power of two, 64 or more) for each set, as 64-bit words: a bit is 1 if an odd number of shingles fall on it.

    Two rows differ in at most as many bits as there are shingles in one of the two sets alone.
    """
    out = np.zeros((len(shingles), bits // 64), "uint64")
    step = max(1, (1 << 20) // bits)
    for first in range(0, len(shingles), step):
        part = shingles[first : first + step]
        at = np.concatenate(part) & (bits - 1)
        at = at.astype("int64") + np.repeat(np.arange(len(part)), [len(x) for x in part]) * bits
        odd = (np.bincount(at, minlength=len(part) * bits) & 1).astype("uint8")
        out[first : first + step] = np.packbits(odd.reshape(len(part), bits), axis=1).view("uint64")
    return out


def similar_in(
    fp: np.ndarray, task: np.ndarray, side: np.ndarray, shingles: list[np.ndarray], similarity: float, distance: int, n_pivots: int, pairs_at_once: int = 1 << 18
) -> tuple[list[int], list[int]]:
    """Rows (a, b) that connect the points of each task as far as they have at least ``similarity``; ``shingles`` are sorted and distinct.

    Of n points there may be n * n / 2 pairs, so no more than about ``pairs_at_once`` are held. They are judged nearest first, as those connected by then
    needn't be. Two sets of that similarity differ in (1 - similarity) / (1 + similarity) of their shingles at most; where ``parities`` differ in more, the sets
    aren't compared.
    """
    n = np.fromiter(map(len, shingles), "int64", len(shingles))
    sets, a, b = Sets(len(fp)), [], []
    bits = 1 << max(6, min(15, int(4 * n.mean()).bit_length())) if len(n) else 64
    parity = parities(shingles, bits)

    def judge(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        apart = sets.apart(i, j)
        i, j = i[apart], j[apart]
        order = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if sets.find(x) != sets.find(y):
                both = np.concatenate([shingles[x], shingles[y]])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if same >= similarity * (len(both) - same):
                    sets.join(x, y)
                    a.append(x)
                    b.append(y)

    held, size = [], 0
    for i, j in near_pairs(fp, task, side, distance, n_pivots, sets):
        fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        fits = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype="int64") <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6
        held.append((i[fits], j[fits]))
        size += len(held[-1][0])
        if size >= pairs_at_once:
            judge(held)
            held, size = [], 0
    if held:
        judge(held)
    return a, b


def deduplicated(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = 5,
    similarity: float = 0.8,
    distance: int = 10,
    bands: int = 8,
    rows: int = 3,
    cell_points: int = 2048,
    task_shingles: int = 4_000_000,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """``docs`` with the first row (smallest doc_id, then a hash of the text) of each group of texts that are linked by a Jaccard
    similarity of ``similarity`` or more between their sets of ``size``-word shingles.

    Texts with the same words are one point. Candidates are points whose words' fingerprints differ by at most ``distance`` bits (pivot
    tables discard the rest) and that share a cell; cells are keys of ``rows`` least shingle hashes, ``bands`` of them, as bit blocks
    for so many bits would need hundreds of cells a point. Two texts at the similarity itself share no cell with a
    probability of (1 - similarity**rows)**bands. Candidates are compared by their whole sets of shingles, in tasks of about
    ``task_shingles`` shingles for each connected block of candidates. Texts without words, null ones too, are one group.
    """
    n_pivots = 2 * PIVOTS
    columns, hashed = docs.columns, F.xxhash64(text)
    keys = docs.select(F.col(doc_id).alias("doc_id"), hashed.alias("tie"), F.col(text).alias("text"))
    made = written(_sketched(keys, size, bands, rows), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    points = made.groupBy("a", "b").agg(first.alias("first"), F.any_value("fp").alias("fp"), F.any_value("cells").alias("cells"))
    points = written(points.withColumn("node", F.monotonically_increasing_id()), "points")
    blocks = connected(links(points.select("node", "fp", F.explode("cells").alias("cell")).where("cell <> 0"), distance, cell_points, n_pivots))
    members = written(points.join(blocks, "node").select("node", "root", "fp", F.col("first.doc_id").alias("_d"), F.col("first.tie").alias("_t")), "members")
    verified = connected(_verified(keys, members, size, similarity, distance, n_pivots, task_shingles, broadcast_rows))
    best = points.join(verified, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("keeper"))
    keepers = best.select(F.col("keeper.doc_id").alias("_k"), F.col("keeper.tie").alias("_t"))
    marked = docs.withColumns({"_hashed": hashed}) if "_hashed" not in columns else docs.withColumns({"_hashed_": hashed})
    own = marked.columns[-1]
    kept = marked.join(keepers, marked[doc_id].eqNullSafe(keepers["_k"]) & (marked[own] == keepers["_t"]), "left_semi")
    # Rows of the same doc_id and text are rare; where there are none, texts needn't be shuffled once more.
    twice = made.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return (kept.dropDuplicates([doc_id, own]) if twice else kept).select(*columns)


def _verified(keys: DataFrame, members: DataFrame, size: int, similarity: float, distance: int, n_pivots: int, task_shingles: int, broadcast_rows: int) -> DataFrame:
    """(a, b) nodes that connect each block's members as far as their texts are similar."""
    few = members.limit(broadcast_rows + 1).count() <= broadcast_rows
    wanted = F.broadcast(members) if few else members
    texts = keys.join(wanted, keys["doc_id"].eqNullSafe(members["_d"]) & (keys["tie"] == members["_t"])).select("node", "root", "fp", "text")

    def sets(batches):
        from .tokens import slices

        for batch in batches:
            for start, part in slices(batch.column("text")):
                _, _, h, m = shingled(part, size)
                lists = [np.unique(x).view("int64") for x in np.split(h, np.cumsum(m)[:-1])]
                own = [batch.column(c).slice(start, len(part)) for c in ("node", "root", "fp")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lists, pa.list_(pa.int64()))], ["node", "root", "fp", "shingles"])

    held = written(texts.mapInArrow(sets, "node long, root long, fp long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    sizes = written(held.groupBy("root").agg(F.sum(F.size("shingles")).alias("n")), "blocks")
    large = sizes.where(F.col("n") > task_shingles).limit(1).count() > 0
    rows = _dealt(held.join(sizes, "root"), F.ceil(F.col("n") / task_shingles).cast("int"), large)

    def compared(frame: pd.DataFrame, task: np.ndarray) -> pd.DataFrame:
        fp, node = frame["fp"].to_numpy("int64").view("uint64"), frame["node"].to_numpy("int64")
        a, b = similar_in(fp, task, frame["side"].to_numpy(), list(frame["shingles"]), similarity, distance, n_pivots)
        return pd.DataFrame({"a": node[a], "b": node[b]})

    rows = rows.select("node", "fp", "shingles", "root", "i", "j", "side")
    return _by_task(rows, "root", compared, task_shingles // 4, "a long, b long", lambda frame: int(frame["shingles"].map(len).sum()))
