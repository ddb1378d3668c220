import random

import xxhash
from cases import SF, no_rows, odd_rows, texts

from spanweave.llm import catalog, simhash
from spanweave.llm.components import components


def slow_print(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, radius=2):
    names = sorted(prints)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in names}


def test_query_matches_brute_force(spark):
    prints = {k: slow_print(t) for k, t in texts(spark).items()}
    classes = slow_classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalog.QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == {k: (f"{prints[k]:016x}", classes[k]) for k in prints}


def test_dense_groups_and_slices(spark):
    """Chains and clouds around a few centres, with buckets cut into many slices."""
    draw = random.Random(5)
    prints = {}
    for _ in range(6):
        now = draw.getrandbits(64)
        for _ in range(60):
            prints[len(prints)] = now
            now ^= 1 << draw.randrange(64) | 1 << draw.randrange(64) | (1 << draw.randrange(64) if draw.random() < 0.2 else 0)
    signed = [(x - (x >> 63 << 64),) for x in set(prints.values())]
    nodes = spark.createDataFrame(signed, "fp bigint")
    for size in (2048, 7):
        links = components(simhash.near_links(nodes, 2, size)).collect()
        roots = {r["node"]: r["root"] for r in links}
        want = {}
        for name, root in slow_classes({x: x for x in set(prints.values())}).items():
            want.setdefault(root, set()).add(name - (name >> 63 << 64))
        for members in want.values():
            assert len({roots.get(m, m) for m in members}) == 1
        assert len({roots.get(x, x) for (x,) in signed}) == len(want)


def test_tree_search_is_exact():
    draw = random.Random(1)
    values = list({draw.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for probe in range(0, 4096, 37):
        assert sorted(tree.near(probe, 2)) == sorted(v for v in values if (v ^ probe).bit_count() <= 2)


def test_odd_rows(spark):
    got = sorted(((r["id"], r["fp"], r["component"]) for r in simhash.near_duplicates(odd_rows(spark)).collect()), key=repr)
    assert len(got) == 11
    named = {i: c for i, _, c in got}
    assert named[1] == named[2] == named[3] == 1 and named[4] == named[5] == named[6] == 4 and named[None] is None
    kept = simhash.keep_one(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "7", "8", "9", "None"]
    twice = odd_rows(spark).where("doc_id = 5")
    assert [r["doc_id"] for r in simhash.keep_one(twice).collect()] == [5]
    assert simhash.near_duplicates(no_rows(spark)).collect() == [] and simhash.keep_one(no_rows(spark)).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
