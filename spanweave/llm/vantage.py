"""Centroid clustering through a vantage-point tree over the centroids.

Vectors become integers floor(1024 * x). Each round builds a tree over the centroids on the driver (k rows), sends it
to the tasks, and every vector looks for its nearest centroid best first: of the tree nodes a vector has still open it
visits the one with the smallest lower bound, and stops when that bound exceeds its best distance. The
bound of a child is the gap between the vector's distance to the vantage point and the range of distances of
the child's centroids; a bound equal to the best distance is still visited, as an equally near centroid of a
smaller number wins. Distances at vantage points and leaves are exact integers; only bounds are floating
point, and are lowered by more than their rounding error.

The integers are written once and scanned in each round; a scan returns one row of exact sums per cluster
and task, so nothing larger than (centroids x dimensions) reaches the driver.

Defined results: vectors that are null, have another length than ``size`` or hold null or non-finite components take no
part, nor do those with a component of absolute 131072 or more, whose squared distances do not fit a long;
rows without id take part (their hash is that of the bare prefix); repeated rows count each; with fewer rows than
``k`` there are as many centroids as rows; an empty table gives an empty table. Other columns are not read.
Sums of distances that do not fit a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize

SCALE = 1024
#: components stay below this, so that squared distances of up to 64 dimensions fit a long
MOST = 1 << 27
#: products of 64 components below this are exact in double precision
EXACT = 1 << 20
LEAF = 4
#: vectors searched together times nodes of the tree
CELLS = 1 << 21
SLACK = 1e-9


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64) -> DataFrame:
    """(id, v) of the vectors that take part: v is floor(1024 * x) of each component x."""
    v = F.col(vector_col)

    def bad(x: Column) -> Column:
        d = x.cast("double")
        return d.isNull() | F.isnan(d) | (F.abs(d) * SCALE >= MOST)

    kept = vectors.where(v.isNotNull() & (F.size(v) == size) & ~F.coalesce(F.exists(v, bad), F.lit(True)))
    return kept.select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))


class Node(NamedTuple):
    """A leaf (members) or a vantage point with two children and the ranges of their distances to it."""

    members: np.ndarray
    children: tuple[int, ...] = ()
    ranges: tuple[tuple[float, float], ...] = ()


class Tree:
    """Vantage-point tree over centroids; nodes are numbered, the root is 0."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = np.asarray(centroids, np.int64)
        self.nodes: list[Node] = []
        self._build(np.arange(len(self.centroids)))

    def _build(self, members: np.ndarray) -> int:
        number = len(self.nodes)
        self.nodes.append(Node(members))
        if len(members) > LEAF:
            point, rest = members[0], members[1:]
            far = np.sqrt(distances(self.centroids[rest], self.centroids[point : point + 1])[:, 0].astype(float))
            order = np.argsort(far, kind="stable")
            halves = [h for h in np.array_split(order, 2) if len(h)]
            ranges = tuple((float(far[h].min()), float(far[h].max())) for h in halves)
            children = tuple(self._build(np.sort(rest[h])) for h in halves)
            self.nodes[number] = Node(members[:1], children, ranges)
        return number

    def nearest(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each integer vector."""
        step = max(1, CELLS // len(self.nodes))
        parts = [self._search(block[at : at + step]) for at in range(0, len(block), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(block)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        open_ = np.full((n, len(self.nodes)), np.inf)
        open_[:, 0] = 0
        active = np.arange(n)
        while len(active):
            chosen = open_[active].argmin(axis=1)
            inside = open_[active, chosen] <= np.sqrt(best[active].astype(float))
            active, chosen = active[inside], chosen[inside]
            bound = open_[active, chosen]
            open_[active, chosen] = np.inf
            order = np.argsort(chosen, kind="stable")
            starts = np.flatnonzero(np.diff(chosen[order], prepend=-1))
            for mine in np.split(order, starts[1:]) if len(order) else ():
                rows, node = active[mine], self.nodes[chosen[mine[0]]]
                far = distances(block[rows], self.centroids[node.members])
                at = far.argmin(axis=1)  # members are sorted, the first of equals is the smallest number
                near, number = far[np.arange(len(rows)), at], node.members[at]
                better = (near < best[rows]) | ((near == best[rows]) & (number < who[rows]))
                best[rows[better]], who[rows[better]] = near[better], number[better]
                for child, (low, high) in zip(node.children, node.ranges):
                    d = np.sqrt(far[:, 0].astype(float))
                    gap = np.maximum(np.maximum(d - high, low - d), 0) - SLACK * (1 + d + high)
                    open_[rows, child] = np.maximum(gap, bound[mine])
        return who, best


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors."""
    if not left.size or max(np.abs(left).max(), np.abs(right).max()) < EXACT and left.shape[1] <= 64:
        a, b = left.astype(float), right.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((left - c) ** 2).sum(1) for c in right], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0), batch.column(1).flatten().to_numpy().reshape(-1, size).astype(np.int64)


def _sums(rows: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, rows, exact sums) of the assignment to these centroids, non-empty clusters only."""
    tree, size = Tree(centroids), centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        sums, counts = np.zeros(tree.centroids.shape, np.int64), np.zeros(len(tree.centroids), np.int64)
        for _, block in _blocks(batches, size):
            who, _ = tree.nearest(block)
            order = np.argsort(who, kind="stable")
            starts = np.flatnonzero(np.diff(who[order], prepend=-1))
            sums[who[order[starts]]] += np.add.reduceat(block[order], starts)
            counts += np.bincount(who, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    parts = rows.select("id", "v").mapInArrow(add, "cluster int, n bigint, sums array<bigint>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    totals = cells.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in totals.collect():
        found.setdefault(r["cluster"], (r["n"], [0] * size))[1][r["at"]] = int(r["x"])
    return [(c, n, sums) for c, (n, sums) in sorted(found.items())]


def first_centroids(rows: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of prefix and id (equal ones by their components)."""
    mark = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.orderBy(mark, "v").limit(k).select("v").collect()], np.int64)


def fit(rows: DataFrame, k: int = 8, rounds: int = 10, prefix: str = "3:") -> np.ndarray:
    """Centroids after so many rounds over the integer vectors ``rows`` (id, v), which every round reads again."""
    centroids = first_centroids(rows, k, prefix)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for cluster, n, sums in _sums(rows, centroids):
            centroids[cluster] = [s // n for s in sums]
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every integer vector."""
    shared = rows.sparkSession.sparkContext.broadcast(Tree(centroids))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for ids, block in _blocks(batches, tree.centroids.shape[1]):
            who, far = tree.nearest(block)
            yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(far)], ["id", "cluster", "distance"])

    return rows.select("id", "v").mapInArrow(look, "id bigint, cluster int, distance bigint")


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, prefix: str = "3:", size: int = 64,
) -> DataFrame:
    """One row (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that takes part."""
    rows = materialize(integers(vectors, id_col, vector_col, size), "cluster-integers")
    centroids = fit(rows, k, rounds, prefix)
    assigned = materialize(assign(rows, centroids.reshape(-1, size)), "clusters") if len(centroids) else rows.selectExpr("id", "0 AS cluster", "0L AS distance")
    of = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    facts = [(c, fits(d), fits(sum(of.values())), digest(centroids[c])) for c, d in of.items()]
    # k rows
    table = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
