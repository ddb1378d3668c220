import hashlib

import numpy as np
import pytest
from cases import SF
from pyspark.sql import functions as F

from spanweave.llm import catalog, vantage


def slow(rows, k=8, rounds=10):
    """rows: (id, integers). Every vector against every centroid."""
    if not rows:
        return {}
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assigned():
        found = []
        for key, v in rows:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centroids))
            found.append((key, v, c, d))
        return found

    for _ in range(rounds):
        found = assigned()
        for c in range(len(centroids)):
            mine = [v for _, v, own, _ in found if own == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assigned()
    total = sum(d for *_, d in found)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    return sorted(((key, c, d, sum(e for *_, o, e in found if o == c), total, digest[c]) for key, _, c, d in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id bigint, embedding array<float>, id int, cluster int, v string")


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_finds_the_nearest_with_ties():
    draw = np.random.default_rng(0)
    for k in (1, 3, 8, 60):
        centroids = draw.integers(-4, 5, (k, 8))
        for these in (centroids, np.concatenate([centroids, centroids]), centroids << 22):
            block = np.concatenate([draw.integers(-5, 6, (300, 8)), these, (1 << 24) * draw.integers(-1, 2, (50, 8))])
            who, far = vantage.Tree(these).nearest(block)
            every = ((block[:, None] - these[None]) ** 2).sum(2)
            assert (who == every.argmin(1)).all() and (far == every.min(1)).all()


def test_search_visits_few_nodes_of_a_large_tree(monkeypatch):
    draw = np.random.default_rng(1)
    centroids = draw.integers(-1000, 1000, (4096, 2))
    seen = []
    real = vantage.distances
    monkeypatch.setattr(vantage, "distances", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    tree = vantage.Tree(centroids)
    seen.clear()
    tree.nearest(draw.integers(-1000, 1000, (200, 2)))
    assert sum(seen) < 200 * 4096 / 20


def test_query_matches_brute_force(spark):
    rows = [(r["id"], list(r["v"])) for r in vantage.integers(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()]
    got = catalog.QUERIES["op11_kmeans"](spark, SF).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert result(got) == slow(rows)


@pytest.mark.parametrize("copies", [0, 40])
def test_odd_rows(spark, copies):
    draw = np.random.default_rng(2)
    some = [(i, draw.normal(size=4).astype(np.float32).tolist()) for i in range(20)]
    odd = [
        (100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 3.0, 4.0]), (104, [1.0, float("nan"), 3.0, 4.0]),
        (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [2e5, 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (3, some[3][1]), (3, some[4][1]),
        (107, [130_000.0, -130_000.0, 130_000.0, -130_000.0]),
    ] + [(200 + i, some[0][1]) for i in range(copies)]  # with copies, one vector holds more than half of the rows
    rows = some + odd
    whole = [(i, v) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) and abs(x) < 131_072 for x in v)]
    kept = [(i, [int(x) for x in np.floor(1024 * np.array(v, np.float32).astype(float))]) for i, v in whole]
    got = vantage.cluster(vectors(spark, rows).repartition(5), k=3, rounds=4, size=4)
    assert result(got) == slow(kept, 3, 4)


def test_few_and_no_rows(spark):
    two = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert {(r["id"], r["distance"]) for r in vantage.cluster(two, size=2).collect()} == {(1, 0), (2, 0)}
    assert vantage.cluster(two.where(F.lit(False)), size=2).collect() == []
    assert vantage.cluster(two).collect() == []
