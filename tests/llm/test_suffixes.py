import re

import numpy as np
from cases import SF, no_rows, odd_rows, texts

from spanweave.llm import suffixes

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, window=13):
    holders = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            holders.setdefault(tuple(own[i : i + window]), set()).add(item)
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in holders}:
            for i in range(len(own) - size + 1):
                if (at := holders.get(tuple(own[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= at
        out.append((key, len(own), len(hit), sorted(found, key=lambda x: (x is not None, x)), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def judged(docs, benchmark, **options):
    rows = suffixes.judge(docs, benchmark, keep=["doc_id"], **options).select("doc_id", "__found.*").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows), key=repr)


def test_matches_brute_force(spark):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = slow(texts(spark).items(), [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert any(r[-1] for r in want)
    assert judged(docs, benchmark) == want
    assert judged(docs, benchmark, block_words=3000, shard_words=5000) == want


def test_odd_rows(spark):
    items = [(1, "two three"), (2, "two three"), (3, ""), (4, None), (5, "word " * 20), (6, "Four five six ONE"), (None, "one"), (5, "word word"), (7, "é" * 5000)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_rows(spark).collect()]
    want = slow(rows, items)
    assert judged(odd_rows(spark), benchmark) == want
    kept = suffixes.judge(odd_rows(spark), benchmark)
    assert kept.columns == [*odd_rows(spark).columns, "__found"] and kept.count() == 11
    assert judged(no_rows(spark), benchmark) == []
    assert judged(odd_rows(spark), benchmark.where("1 = 0")) == slow(rows, [])


def test_suffix_array_order():
    windows = suffixes.build_windows([(1, (b"a", b"b", b"c"))])
    ids = np.array([1, 2, 3, 0, 3, 1, 2, 3, 1, 2, 3, 3, 0], np.int32)
    places, _ = suffixes.suffix_array(ids, windows)
    tails = [tuple(ids[p : p + 3]) for p in places]
    assert tails == sorted(tails) and set(places.tolist()) == {0, 4, 5, 6, 7, 8, 9}
    assert sorted(suffixes.occurrences(ids, windows)[0].tolist()) == [0, 5, 8]


def test_items_without_id(spark):
    """Their windows hit; together they are one item, first in the list."""
    items = [(None, "one two three"), (None, "nine"), (-3, "two three"), (0, "three"), (None, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "one two three four"), (2, "eight nine ten"), (3, "four three"), (4, "five")], "doc_id bigint, text string")
    want = [(1, 4, 3, [None, -3, 0], True), (2, 3, 1, [None], True), (3, 2, 1, [0], True), (4, 1, 0, [], False)]
    assert judged(docs, benchmark) == want
    assert judged(docs, benchmark, block_words=13) == want
