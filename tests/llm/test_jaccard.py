import random

import corpus_pipeline
import numpy as np
from cases import SF, no_rows, odd_rows, texts

from spanweave.llm import jaccard


def slow_set(text, width=5):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def slow_classes(rows):
    """rows: (id, text), ids not null."""
    sets = {k: slow_set(t) for k, t in rows}
    names = sorted(sets)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in names}


def found(docs):
    return {r["id"]: r["component"] for r in jaccard.near_duplicates(docs).collect()}


def test_documents_match_brute_force(spark):
    want = slow_classes(texts(spark).items())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == want
    kept = corpus_pipeline.near_copies(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, root in want.items() if k == root}


def test_edited_copies_chains_and_common_lines(spark, monkeypatch):
    """Similarities on both sides of 0.8, chains, and a line that most texts hold, whatever counts as common."""
    draw = random.Random(3)
    rows = []
    for size in (6, 14, 30, 60, 90, 120, 200, 400):
        now = [f"w{draw.randrange(10**6)}" for _ in range(size)]
        for step in range(12):
            line = ["a", "line", "that", "most", "texts", "hold", "at", "the", "end"]
            rows.append((len(rows), " ".join(now + (line if size % 4 else []))))
            now = list(now)
            for _ in range(draw.randrange(size // 40 + 2)):
                now[draw.randrange(size)] = f"w{draw.randrange(10**6)}"
    exact = [f"x{i}" for i in range(13)]  # nine shingles: 8 of 10 together is 0.8 itself
    rows += [(1000, " ".join(exact)), (1001, " ".join([*exact[:-1], "y"])), (1002, " ".join(["z", *exact[:-1]]))]
    want = slow_classes(rows)
    assert want[1000] == want[1001] and 20 < len(set(want.values())) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(docs) == want
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "COMMON", 2)
    assert found(docs) == want


def test_bound_of_shared_members():
    draw = np.random.default_rng(0)
    pool = draw.integers(0, 1 << 63, 30_000).astype(np.uint64)
    for n, m in ((1, 1), (3, 4), (40, 45), (500, 700), (900, 1100), (20_000, 17_000)):
        a, b = (np.unique(draw.choice(pool[: 2 * max(n, m)], k)) for k in (n, m))
        common = len(np.intersect1d(a, b))
        bound = jaccard.most_common_members(jaccard._sketch(a), jaccard._sketch(b))
        assert common <= bound <= min(len(a), len(b))
    same = np.full(600, 8, np.uint64) * np.arange(1, 601).astype(np.uint64) << np.uint64(20)
    assert jaccard._sketch(same) == b"" and jaccard.most_common_members(b"", jaccard._sketch(pool[:50])) is None


def test_dense_groups_around_the_limit(spark, monkeypatch):
    """Hundreds of copies of one text with as many edits as bring most pairs just under or over 0.8, so that hubs settle little."""
    draw = random.Random(5)
    rows = []
    for size, edits, copies in ((120, 3, 150), (120, 2, 150), (60, 1, 80)):
        text = [f"g{size}{edits}w{i}" for i in range(size)]
        for _ in range(copies):
            now = list(text)
            for place in draw.sample(range(size), edits):
                now[place] = f"e{draw.randrange(10**9)}"
            rows.append((len(rows), " ".join(now)))
    want = slow_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert 3 < len(set(want.values())) < len(rows)
    assert found(docs) == want
    monkeypatch.setattr(jaccard, "SLICE", 7)
    monkeypatch.setattr(jaccard._across, "__defaults__", (7,))
    assert found(docs) == want


def test_pairs_of_a_dense_group_grow_with_its_members(spark, monkeypatch):
    """Copies with no to many edits: the least edited ones are hubs, so few members are left that meet all others."""
    draw = random.Random(9)
    rows = []
    for i in range(600):
        now = [f"w{j}" for j in range(200)]
        for place in draw.sample(range(200), draw.randrange(7)):
            now[place] = f"e{draw.randrange(10**9)}"
        rows.append((i, " ".join(now)))
    asked, bounded = [], jaccard._bounded
    monkeypatch.setattr(jaccard, "_bounded", lambda pairs, *rest: (asked.append(pairs.count()), bounded(pairs, *rest))[1])
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)) == slow_classes(rows)
    assert sum(asked) < 10 * len(rows), asked


def test_hubs_and_members_of_a_bucket(spark):
    rows = [(s, k, 10, k % 3) for s in range(5) for k in range(s * 3)] * 2 + [(99, 1, 10, 0)] * 3
    placed = spark.createDataFrame(rows, "shingle bigint, key bigint, n int, at int").selectExpr("*", "key AS root")
    for size in (1, 4, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = jaccard._with_hubs(placed, 0).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r["shingle"], r["key"]) for r in got) == sorted({(s, k) for s, k, *_ in rows if s != 99})
        hubs = {(r["shingle"], r["hub_key"]) for r in got}
        assert len(hubs) == 4 and all((r["at"], r["hub_at"]) == (r["key"] % 3, r["hub_key"] % 3) for r in got)


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "the same text in a third of all rows " * 3) for i in range(200)] + [(1000 + i, " ".join(f"t{i}w{j}" for j in range(20))) for i in range(400)]
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    assert got == {k: 0 if k < 200 else k for k, _ in rows}


def test_names_of_the_input_are_free(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (3, "other", 7, 8, 9)], "doc_id bigint, text string, __keeper int, __at int, __bits int")
    assert sorted(map(tuple, corpus_pipeline.near_copies(spark, docs, SF).collect())) == [(1, "a b c d e f", 1, 2, 3), (3, "other", 7, 8, 9)]


def test_odd_rows(spark):
    got = sorted(((r["id"], r["component"]) for r in jaccard.near_duplicates(odd_rows(spark)).collect()), key=repr)
    assert len(got) == 11
    named = dict(got)
    assert named[1] == named[2] == named[3] == 1 and named[4] == named[5] == named[6] == 4 and named[None] is None
    kept = corpus_pipeline.near_copies(spark, odd_rows(spark), SF)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "7", "8", "9", "None"]
    assert found(no_rows(spark)) == {}
