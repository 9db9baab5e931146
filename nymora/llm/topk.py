"""Exact top-k search by inner product: ball-tree branch and bound in every shard, and over the shards.

Vectors are scaled to whole numbers. A router, a ball tree of a bounded sample (about ``fit_values`` vector components), splits space
by planes into cells; every vector is routed to its cell, and a cell of more than ``shard_rows`` vectors is salted into several shards
by vec_id, so that equal or hot vectors don't make one task. A cell's centre is the router's, its radius is the largest distance
of all of its vectors. In a shard, a ball tree bounds the inner product of a query with any vector of a node by q . centre + |q| * radius;
nodes are taken in descending order of that bound, and a search ends when the bound is below the kth score.

Queries go in three waves: to one shard of the cell whose centre scores highest; to the rest of the ``near_cells`` cells of the highest
bounds; to all other cells. After each wave the kth score of all shards seen so far goes along, and (query, shard) pairs whose cell's bound
is below it are dropped before any vector is shuffled. A shard is copied once per ``query_block`` queries that come to it.

Defined cases: vectors that are null or hold a null or non-finite component take no part; only vectors of the same length are
compared, and lengths that the sample lacks share one cell without a bound; rows with the same vec_id count once (the smallest vector);
the query's own vec_id is no candidate; equal scores go to the smaller vec_id; fewer candidates give fewer rows; a null vec_id takes no part.
Scores are exact wherever they fit 64 bits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def upper(centres: np.ndarray, radii: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Bounds of the inner product of ``query`` with any vector of each ball, raised above rounding errors."""
    length = np.sqrt(query @ query)
    return centres @ query + length * radii + 1e-9 * (1 + length * (np.sqrt((centres * centres).sum(1)) + radii))


class BallTree:
    """Nodes by number: centre, radius, and either two children with the plane between them or a range of rows."""

    def __init__(self, vectors: np.ndarray, leaf: int = 128):
        self.rows = np.arange(len(vectors))
        self.vectors = vectors.astype("float64")
        self.largest = float(np.sqrt((self.vectors**2).sum(1).max(initial=0.0)))
        self.centres, self.radii, self.spans, self.children, self.planes = [], [], [], [], {}
        self._build(0, len(vectors), leaf)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.ordered = self.vectors[self.rows]
        self.whole = vectors[self.rows]

    def _build(self, begin: int, end: int, leaf: int) -> int:
        stack = [(begin, end, -1, 0)]
        while stack:
            begin, end, parent, side = stack.pop()
            own = self.vectors[self.rows[begin:end]]
            centre = own.mean(0)
            gap = own - centre
            radius = float(np.sqrt((gap * gap).sum(1).max(initial=0.0)))
            number = len(self.centres)
            self.centres.append(centre)
            self.radii.append(radius)
            self.spans.append((begin, end))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = number
            if end - begin <= leaf or radius == 0:
                continue
            far = own[np.argmax((gap * gap).sum(1))]
            other = own[np.argmax(((own - far) ** 2).sum(1))]
            along = own @ (far - other)
            order = np.argsort(along, kind="stable")
            self.rows[begin:end] = self.rows[begin:end][order]
            middle = (begin + end) // 2
            self.planes[number] = (far - other, along[order[middle - begin]])
            stack += [(begin, middle, number, 0), (middle, end, number, 1)]
        return 0

    def leaves(self) -> list[int]:
        return [i for i, (a, _) in enumerate(self.children) if a < 0]

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all planes each vector lies."""
        out, stack = np.zeros(len(vectors), "int64"), [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if node not in self.planes:
                out[rows] = node
                continue
            direction, cut = self.planes[node]
            right = vectors[rows] @ direction >= cut
            stack += [(child, part) for child, part in zip(self.children[node], (rows[~right], rows[right]), strict=True) if len(part)]
        return out

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int, least: float) -> list[tuple[int, int]]:
        """(score, id) of the best k with a score of ``least`` or more, best first; ``ids`` are those of the tree's vectors."""
        whole, query = query, query.astype("float64")
        reach = upper(self.centres, self.radii, query)
        exact = np.sqrt(query @ query) * self.largest < 2.0**52  # sums of doubles are then whole numbers without rounding
        queue, best = [(-reach[0], 0)], []
        while queue:
            bound, node = heapq.heappop(queue)
            floor = max(least, best[0][0]) if len(best) == k else least
            if -bound < floor:
                break
            a, b = self.children[node]
            if a >= 0:
                for c in (a, b):
                    if reach[c] >= floor:
                        heapq.heappush(queue, (-reach[c], c))
                continue
            begin, end = self.spans[node]
            scores = self.ordered[begin:end] @ query if exact else self.whole[begin:end] @ whole
            fits = np.flatnonzero(scores >= floor)
            if len(fits) > 2 * k + 2:
                # all that tie with the best k of the leaf are kept, so ids decide among equals
                cut = np.partition(scores[fits], len(fits) - k - 1)[len(fits) - k - 1]
                fits = fits[scores[fits] >= cut]
            for i in fits.tolist():
                one = int(ids[self.rows[begin + i]])
                if one == own:
                    continue
                found = (int(scores[i]), -one)
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _search(shard: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    columns = ["query_id", "vec_id", "score"]
    if not len(shard) or not len(queries):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    ids = shard["vec_id"].to_numpy("int64")
    tree = BallTree(np.array(shard["v"].tolist(), "int64").reshape(len(shard), -1))
    out = []
    for q, v, least in zip(queries["query_id"].tolist(), queries["v"], queries["least"], strict=True):
        found = tree.search(np.asarray(v, "int64"), k, ids, q, -np.inf if pd.isna(least) else float(least))
        out += [(q, i, s) for s, i in found]
    return pd.DataFrame(out, columns=columns).astype("int64")


def scaled(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """``df`` where the vector is whole, with ``v``: floor(scale * x) of each component."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & ~bad).withColumn("v", F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


class Router:
    """Cells of space by vector length: ``trees`` by length; cells of all trees are numbered on, after cell 0 of all other lengths."""

    def __init__(self, trees: dict[int, BallTree]):
        self.trees, self.cells, after = {}, {}, 1
        for dim, tree in sorted(trees.items()):
            leaves = tree.leaves()
            number = np.zeros(len(tree.children), "int64")
            number[leaves] = np.arange(after, after + len(leaves))
            self.trees[dim], self.cells[dim] = (tree, number), (np.arange(after, after + len(leaves)), tree.centres[leaves])
            after += len(leaves)
            tree.rows = tree.vectors = tree.ordered = tree.whole = None  # planes and centres are enough

    def place(self, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance to that cell's centre."""
        cell, gap = np.zeros(len(vectors), "int64"), np.zeros(len(vectors))
        sizes = np.array([len(v) for v in vectors])
        for dim in set(sizes.tolist()) & set(self.trees):
            rows = np.flatnonzero(sizes == dim)
            own = np.array([vectors[i] for i in rows], "float64").reshape(len(rows), dim)
            tree, number = self.trees[dim]
            leaf = tree.route(own)
            cell[rows], gap[rows] = number[leaf], np.sqrt(((own - tree.centres[leaf]) ** 2).sum(1))
        return cell, gap

    def reach(self, query: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cells with vectors as long as the query in descending order of their bounds, those bounds, and the cell whose centre scores highest."""
        cells, centres = self.cells.get(len(query), (np.array([0]), np.zeros((1, len(query)))))
        there = radii[cells] >= 0
        cells, centres = cells[there], centres[there]
        if not len(cells):
            return cells, np.zeros(0), -1
        bounds = upper(centres, radii[cells], query)
        order = np.argsort(-bounds, kind="stable")
        return cells[order], bounds[order], int(cells[np.argmax(centres @ query)])


def fit_router(rows: DataFrame, shard_rows: int, fit_values: int) -> Router:
    """A router for ``rows`` from about ``fit_values`` vector components drawn by hash."""
    values = rows.agg(F.sum(F.size("v"))).head()[0] or 0
    share = min(1.0, fit_values / max(1, values))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30)) < F.lit(share * (1 << 30))).select("v").toPandas()["v"]
    by: dict[int, list] = {}
    for v in drawn:
        by.setdefault(len(v), []).append(v)
    leaf = max(8, int(shard_rows * share))
    return Router({dim: BallTree(np.array(sorted(map(tuple, own)), "int64").reshape(len(own), dim), leaf) for dim, own in by.items()})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, vector: str = "embedding", vec_id: str = "vec_id", shard_rows: int = 8192, query_block: int = 4096, near_cells: int = 8, fit_values: int = 1 << 22) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    rows = scaled(vectors, vector, scale).select(F.col(vec_id).cast("long").alias("vec_id"), "v").where("vec_id is not null")
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    asked = scaled(queries, vector, scale).select(F.col(vec_id).cast("long").alias("query_id"), "v").where("query_id is not null")
    asked = written(asked.groupBy("query_id").agg(F.min("v").alias("v")), "queries")
    router = spark.sparkContext.broadcast(fit_router(rows, shard_rows, fit_values))

    def place(frames):
        for frame in frames:
            cell, gap = router.value.place(frame["v"].tolist())
            yield frame.assign(cell=cell, gap=gap)

    placed = written(rows.mapInPandas(place, "vec_id long, v array<bigint>, cell long, gap double"), "placed")
    cells = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("salts"), F.max("gap").alias("radius"))
    cells = written(cells, "cells")  # no more rows than the router's sample
    stats = cells.collect()
    radii, salts = np.full(1 + sum(len(numbers) for numbers, _ in router.value.cells.values()), -1.0), {}
    for r in stats:
        radii[r["cell"]], salts[r["cell"]] = (np.inf if r["cell"] == 0 else r["radius"]), r["salts"]
    bounds = spark.sparkContext.broadcast((radii, salts))

    columns = ["query_id", "v", "dim", "cell", "salt", "least"]

    def pairs(wave: int):
        def made(frames):
            radii, salts = bounds.value
            for frame in frames:
                out: list[tuple] = []
                for q, v, least in zip(frame["query_id"].tolist(), frame["v"], frame["least"].tolist(), strict=True):
                    cells, reach, home = router.value.reach(np.asarray(v, "float64"), radii)
                    for place, (cell, bound) in enumerate(zip(cells.tolist(), reach.tolist(), strict=True)):
                        if bound < least:
                            break
                        first = q % salts[cell] if cell == home else -1
                        near = place < near_cells or cell == home
                        if wave == 0:
                            chosen = [first] if cell == home else []
                        else:
                            chosen = [s for s in range(salts[cell]) if s != first] if near == (wave == 1) else []
                        out += [(q, v, len(v), cell, salt, least) for salt in chosen]
                        if len(out) >= 4096:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                yield pd.DataFrame(out, columns=columns)

        return made

    keys = ["dim", "cell", "salt", "block"]
    dealt = placed.join(F.broadcast(cells.select("cell", "salts")), "cell")
    dealt = dealt.select("vec_id", "v", F.size("v").cast("long").alias("dim"), "cell", F.pmod(F.xxhash64("vec_id"), "salts").alias("salt"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame, wave: int) -> DataFrame:
        sent = written(asked.mapInPandas(pairs(wave), "query_id long, v array<bigint>, dim long, cell long, salt long, least double"), "pairs")
        load = sent.groupBy("dim", "cell", "salt").agg(F.count(F.lit(1)).alias("load"))
        load = load.select("dim", "cell", "salt", F.ceil(F.col("load") / query_block).cast("long").alias("blocks"))
        ours = dealt.join(load, ["dim", "cell", "salt"]).select("vec_id", "v", "dim", "cell", "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        theirs = sent.join(load, ["dim", "cell", "salt"]).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("blocks")))
        return ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long")

    def best(near: DataFrame) -> DataFrame:
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = written(searched(asked.withColumn("least", F.lit(float("-inf"))), 0), "near")
    for wave, left in ((1, sum(salts.values()) > 1), (2, len(salts) > near_cells)):
        if not left:  # no pair is of this wave
            continue
        kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("least"))
        going = asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        found = written(best(found.union(searched(going, wave))).drop("rank"), "near")
    return best(found).select("query_id", "rank", "vec_id", "score")
