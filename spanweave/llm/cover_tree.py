"""Exact top-k inner products with cover trees on both sides.

Data vectors become cover trees, one per shard of a partition; queries become one tree per block,
sent to every task (a block has at most ``block`` queries). A search walks pairs of nodes: the
best score of any query below one with any vector below the other is at most
``<q, d> + rq |d| + rd |q| + rq rd`` for centres q, d and covering radii rq, rd. A pair is dropped if that is
below the worst k-th score of the query group; leaves meet in one matrix product. Spark then merges the k
best of each shard per query.

A shard holds its equal vectors once, with as many of their smallest ids as k best can need, so a
vector that a third of the rows share costs one point.

Scores are whole numbers, exact: products of norms below 2^53 are computed in doubles, larger ones in Python
integers (cut to the range of a long).

Defined results: vectors that are null or empty, hold a null, NaN or infinity, or have a null id take no part; a vector
meets only vectors of its own length; ties go to the smaller id; repeated rows are candidates each, and a
repeated query is answered once per distinct vector; fewer candidates than k give fewer rows; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.session import materialize

BASE = 1.5
LEAF = 64
SHARD_ROWS = 8192
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Node:
    """A centre, the distance to its farthest point, and children or (in a leaf) point numbers."""

    __slots__ = ("centre", "radius", "norm", "children", "points")

    def __init__(self, centre: np.ndarray, radius: float, children: list[Node], points: np.ndarray) -> None:
        self.centre, self.radius, self.children, self.points = centre, radius, children, points
        self.norm = float(np.linalg.norm(centre))


def _leaf(rows: np.ndarray, points: np.ndarray) -> Node:
    centre = rows[points[0]]
    return Node(centre, float(np.linalg.norm(rows[points] - centre, axis=1).max()), [], points)


def build(rows: np.ndarray, leaf: int = LEAF) -> Node | None:
    """Cover tree of the rows: each level's centres lie farther apart than the radius that their
    children keep to, a ``BASE``-th of the parent's. Centres with fewer than ``leaf`` points share a leaf."""
    if not len(rows):
        return None

    def grow(points: np.ndarray) -> Node:
        centre = rows[points[0]]
        away = np.linalg.norm(rows[points] - centre, axis=1)
        radius = float(away.max())
        if len(points) <= leaf or radius == 0:
            return Node(centre, radius, [], points)
        children, few, rest = [], [], points
        while len(rest):
            near = np.linalg.norm(rows[rest] - rows[rest[0]], axis=1) <= radius / BASE
            group, rest = rest[near], rest[~near]
            if len(group) == len(points):
                return Node(centre, radius, [], points)
            if len(group) < leaf:
                few.append(group)
            else:
                children.append(grow(group))
        if few:
            children.append(_leaf(rows, np.concatenate(few)))
        return Node(centre, radius, children, np.empty(0, np.int64))

    return grow(np.arange(len(rows)))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as longs."""
    if len(a) and len(b) and np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max() < EXACT:
        return (a @ b.T).astype(np.int64)
    left, right = ([[int(v) for v in row] for row in rows] for rows in (a, b))
    return np.array(
        [[min(max(sum(x * y for x, y in zip(p, q)), LEAST), MOST) for q in right] for p in left], np.int64
    ).reshape(len(a), len(b))


class Search:
    """The k best of one shard for every query of a block."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int) -> None:
        self.queries, self.query_ids, self.rows, self.ids, self.k = queries, query_ids, rows, ids, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]
        self.worst = np.full(len(queries), -np.inf)

    def meet(self, queries: np.ndarray, points: np.ndarray) -> None:
        scores = exact_scores(self.queries[queries], self.rows[points])
        for i, query in enumerate(queries.tolist()):
            row, own = scores[i], int(self.query_ids[query])
            # points whose scores reach the k-th; longs are compared as doubles with room to spare
            places = np.flatnonzero(row >= self.worst[query]) if self.worst[query] > -np.inf else np.arange(len(row))
            if len(places) > 2 * self.k:
                top = np.partition(row[places], len(places) - self.k - 1)[len(places) - self.k - 1]
                places = places[row[places] >= top]
            if not len(places):
                continue
            found = [(-int(row[p]), x) for p in places.tolist() for x in self.ids[int(points[p])] if x != own]
            merged = sorted(self.best[query] + found)[: self.k]
            self.best[query] = merged
            if len(merged) == self.k:
                self.worst[query] = np.nextafter(float(-merged[-1][0]), -np.inf) if abs(merged[-1][0]) >= EXACT else float(-merged[-1][0])

    def walk(self, group: Node, members: dict[int, np.ndarray], node: Node) -> None:
        stack = [(group, node)]
        while stack:
            q, d = stack.pop()
            bound = float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
            if bound + 1 + 1e-9 * abs(bound) < self.worst[members[id(q)]].min():
                continue
            if not q.children and not d.children:
                self.meet(q.points, d.points)
            elif q.children and (not d.children or q.radius >= d.radius):
                stack.extend((child, d) for child in q.children)
            else:
                # the most promising child is taken from the stack first
                stack.extend((q, child) for child in sorted(d.children, key=lambda c: float(q.centre @ c.centre) + c.radius * q.norm))

    def run(self, group: Node, node: Node) -> None:
        members: dict[int, np.ndarray] = {}

        def collect(n: Node) -> np.ndarray:
            members[id(n)] = n.points if not n.children else np.concatenate([collect(c) for c in n.children])
            return members[id(n)]

        collect(group)
        self.walk(group, members, node)


def _shard_rows(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by length."""
    by_length: dict[int, list[tuple[int, list[float]]]] = defaultdict(list)
    for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by_length[len(values)].append((key, values))
    return {n: (np.array([k for k, _ in rows]), np.array([v for _, v in rows], np.float64)) for n, rows in by_length.items()}


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {
            n: (ids, rows, build(rows)) for n, (ids, rows) in shared.value.items()
        }

        def solve(n: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            query_ids, queries, group = blocks[n]
            distinct, back = np.unique(rows, axis=0, return_inverse=True)
            order = np.lexsort((ids, back.ravel()))
            cuts = np.searchsorted(back.ravel()[order], np.arange(len(distinct) + 1))
            listed = ids[order].tolist()
            spare = k + int(np.unique(ids, return_counts=True)[1].max())  # enough when one id's rows fall away
            folded = [listed[a : min(b, a + spare)] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            search = Search(queries, query_ids, distinct, folded, k)
            search.run(group, build(distinct))
            out = [(q, key, -score) for q, best in enumerate(search.best) for score, key in best]
            return pa.RecordBatch.from_arrays([
                pa.array([int(query_ids[q]) for q, _, _ in out], pa.int64()), pa.array([q for q, _, _ in out], pa.int32()),
                pa.array([n] * len(out), pa.int32()), pa.array([key for _, key, _ in out], pa.int64()),
                pa.array([s for _, _, s in out], pa.int64()),
            ], ["query_id", "query_row", "length", "vec_id", "score"])

        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            for n, part in _shard_rows(batch).items():
                if n in blocks:
                    held[n].append(part)
                    if sum(len(ids) for ids, _ in held[n]) >= SHARD_ROWS:
                        yield solve(n, *(np.concatenate(x) for x in zip(*held.pop(n))))
        for n, parts in held.items():
            yield solve(n, *(np.concatenate(x) for x in zip(*parts)))

    return run


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, vector): finite vectors with each component turned into floor(scale * x)."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    # floor in doubles: x - pmod(x, 1) keeps components beyond the range of a long
    scaled = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite).select("vec_id", scaled.alias("vector"))


def topk(
    table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
    block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``table`` for every row of ``queries``.

    Queries are taken in blocks of ``block``; each block is one pass over the table."""
    spark = table.sparkSession
    vectors = whole_vectors(table, id_col, vector_col, scale)
    asked = materialize(whole_vectors(queries, id_col, vector_col, scale).distinct(), "queries")
    blocks = max(1, -(-asked.count() // block))
    found = []
    for at in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == at) if blocks > 1 else asked
        rows: dict[int, list] = defaultdict(list)
        for r in part.orderBy("vec_id", "vector").toLocalIterator():
            rows[len(r["vector"])].append((r["vec_id"], r["vector"]))
        sent = {n: (np.array([i for i, _ in own]), np.array([v for _, v in own], np.float64)) for n, own in rows.items()}
        shared = spark.sparkContext.broadcast(sent)
        best = vectors.mapInArrow(_search(shared, k), "query_id bigint, query_row int, length int, vec_id bigint, score bigint")
        order = Window.partitionBy("query_id", "query_row", "length").orderBy(F.desc("score"), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.select("query_id", "rank", "vec_id", "score")
        found.append(materialize(ranked, "topk") if blocks > 1 else ranked)
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionAll(other)
    return whole
