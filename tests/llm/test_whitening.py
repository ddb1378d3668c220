import numpy as np
import pytest
from cases import SF
from pyspark.sql import functions as F

from spanweave.llm import catalog, whitening


def slow(kept, components=8):
    """Plain double precision, deviations in whole numbers."""
    x = np.array([v for _, v in kept], float)
    n, size = x.shape
    sums = [sum(int(v[d]) for _, v in kept) for d in range(size)]
    centered = x - np.array(sums) / n
    v = centered.T @ centered / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviations = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for _, row in kept]
    return n, deviations, centered @ vectors / np.sqrt(values), values / np.trace(v)


def integers(rows, size):
    return [(i, [int(c) + 100_000 for c in np.floor(1024 * np.array(v, np.float32).astype(float))]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]


def check(got, kept, components=8):
    n, deviations, white, explained = slow(kept, components)
    assert len(got) == len(kept) * min(components, len(kept[0][1]))
    of = {}
    for r in got:
        of.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    for c in of:
        sign = None
        for (key, _), deviation, want in zip(kept, deviations, white[:, c - 1]):
            row = next(r for r in of[c][key] if r["deviation_text"] == str(deviation))
            assert row["n"] == n and row["deviation"] == (deviation if deviation < 1 << 63 else None)
            assert row["explained"] == pytest.approx(explained[c - 1], rel=1e-9) and row["identity_error"] < 1e-9
            sign = sign or (1 if row["whitened"] * want > 0 else -1)
            assert sign * row["whitened"] == pytest.approx(want, abs=1e-8)


def test_eigenvectors_of_clustered_values():
    draw = np.random.default_rng(0)
    turn = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    for values in (
        np.geomspace(1, 1e6, 40), np.r_[np.full(20, 5.0), 7 + 1e-9 * np.arange(20)], np.r_[np.zeros(39), 3.0], np.r_[3 + 1e-6 * np.arange(39), 9], np.zeros(40),
    ):
        a = (turn * values) @ turn.T
        a = (a + a.T) / 2
        e, x = whitening.eigen(a)
        scale = max(values.max(), 1)
        assert np.abs(a @ x - x * e).max() < 2e-15 * scale * 10 and np.abs(x.T @ x - np.eye(40)).max() < 2e-15
        assert np.abs(e - np.sort(values)[::-1]).max() < 2e-15 * scale * 10


def test_refinement_beats_single_precision():
    draw = np.random.default_rng(3)
    turn = np.linalg.qr(draw.normal(size=(64, 64)))[0]
    a = (turn * np.linspace(1, 2, 64)) @ turn.T
    a = (a + a.T) / 2
    x = whitening.eigen(a)[1][:, ::-1]
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    off = lambda u: np.abs(u.T @ a @ u - np.diag(np.diag(u.T @ a @ u))).max()
    assert off(x) < 1e-14 < 1e-8 < off(single)


def test_query_matches_plain_double_precision(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = catalog.QUERIES["op12_whitening"](spark, SF)
    assert [f.dataType.simpleString() for f in got.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").schema] == [
        "bigint", "int", "bigint", "bigint", "double", "double", "double"]
    check(got.collect(), integers(rows, 64))


def test_odd_rows(spark):
    draw = np.random.default_rng(1)
    some = [(i, draw.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    odd = [
        (100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 3.0, 4.0, 5.0]), (104, [float("nan")] * 5), (105, [float("inf")] + [0.0] * 4),
        (3, some[3][1]), (3, some[4][1]), (None, some[5][1]),
    ] + [(200 + i, some[0][1]) for i in range(30)]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in some + odd], "vec_id bigint, embedding array<float>, id int, whitened double")
    got = whitening.whitened(frame.repartition(4), components=3, size=5).withColumnRenamed("id", "vec_id").collect()
    check(got, integers(some + odd, 5), 3)
    assert whitening.whitened(frame.where(F.lit(False)), size=5).collect() == []


def test_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(4)], "vec_id bigint, embedding array<double>")
    got = whitening.whitened(same, size=3).collect()
    assert len(got) == 12 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in got} == {(None, None, None, 0)}
    flat = spark.createDataFrame([(i, [float(i), float(i), 1.0]) for i in range(6)], "vec_id bigint, embedding array<double>")
    got = whitening.whitened(flat, size=3).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and got[0]["identity_error"] < 1e-12
    assert sorted(abs(r["whitened"]) for r in got if r["component"] == 1)[-1] == pytest.approx(2.5 / np.sqrt(35 / 12))


def test_wide_numbers(spark):
    far = [(i, [130_000.0 * (-1) ** i, float(i)]) for i in range(50)]
    got = whitening.whitened(spark.createDataFrame(far, "vec_id bigint, embedding array<float>"), size=2).withColumnRenamed("id", "vec_id").collect()
    check(got, integers(far, 2))
