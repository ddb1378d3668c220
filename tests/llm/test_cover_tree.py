import math

import numpy as np
import pytest
from cases import SF

from spanweave.llm import cover_tree


def slow(rows, queries, k=10, scale=1024):
    def whole(v):
        return [math.floor(scale * x) for x in v]

    def fit(r):
        return r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])

    out = set()
    for q, v in filter(fit, queries):
        scores = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), d) for d, w in filter(fit, rows) if d != q and len(w) == len(v))
        out |= {(q, n, d, -s) for n, (s, d) in enumerate(scores[:k], 1)}
    return out


def run(spark, rows, queries, **options):
    kind = "vec_id bigint, embedding array<double>, score int"
    frames = [spark.createDataFrame([(*r, 0) for r in x], kind).repartition(3) for x in (rows, queries)]
    return set(map(tuple, cover_tree.topk(*frames, **options).collect()))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_matches_brute_force(spark, monkeypatch, spread):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + spread * draw.normal(size=8)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # one vector that a quarter of the rows share
    monkeypatch.setattr(cover_tree, "SHARD_ROWS", 250)
    queries = rows[::40] + [(5000, [0.0] * 8)]
    assert run(spark, rows, queries) == slow(rows, queries)
    assert run(spark, rows, queries, block=7) == slow(rows, queries)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, float("inf")]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0]),
        (8, [-1.0, -2.0]), (9, [3.0, 1.0, 1.0]), (10, [0.3, -0.0004]), (11, [1e6, 1e6]),
    ]
    assert run(spark, rows, rows) == slow(rows, rows)
    assert run(spark, rows[:5], rows) == set() and run(spark, rows, rows[:2]) == set() and run(spark, [], []) == set()
    same = [(i, [1.0, 1.0]) for i in range(40)]
    assert run(spark, same, same[5:7], k=3) == slow(same, same[5:7], k=3)


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-(1 << 19), 1 << 19, 4)]) for i in range(60)]
    assert run(spark, rows, rows[:6]) == slow(rows, rows[:6])


def test_tree_covers_and_separates():
    rows = np.random.default_rng(0).normal(size=(700, 3))
    stack, seen = [cover_tree.build(rows, 16)], []

    def under(n):
        return np.concatenate([under(c) for c in n.children]) if n.children else n.points

    while stack:
        node = stack.pop()
        points = under(node)
        assert np.linalg.norm(rows[points] - node.centre, axis=1).max() <= node.radius + 1e-9
        seen += [] if node.children else points.tolist()
        stack += node.children
    assert sorted(seen) == list(range(700))


def test_pairs_are_pruned(spark):
    draw = np.random.default_rng(4)
    rows = np.floor(1024 * (np.repeat(draw.normal(size=(10, 4)) * 5, 200, axis=0) + 0.01 * draw.normal(size=(2000, 4))))
    search = cover_tree.Search(rows[:1], np.array([0]), rows, [[i] for i in range(len(rows))], 5)
    met = []
    meet = search.meet
    search.meet = lambda q, p: (met.append(len(p)), meet(q, p))
    search.run(cover_tree.build(rows[:1]), cover_tree.build(rows))
    assert sum(met) < len(rows) / 2


def test_supplied_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = set(map(tuple, cover_tree.topk(table, table.where("vec_id % 100 = 0")).collect()))
    assert got == slow(rows, [r for r in rows if r[0] % 100 == 0])
