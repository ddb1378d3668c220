import numpy as np

from spanweave.llm import catalog, url_filter

URLS = [
    None, "", "no sign", "http://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://notexample.com/en/",
    "https://x.net/es/1", "https://net/fr/", "https://x.net/fr", "https://netx/fr/", "ftp://a.com", "ftp://a.com?/en/", "x://example.com/EN/", "a://b://example.com/en/",
    "http:///en/", "http://.com/", "http://a..com/", "http://example.com/en/" + "p" * 50_000, "http://" + "a." * 20_000 + "net/es/", "http://ÉXAMPLE.com/é",
]


def slow(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def rows(spark, urls):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")


def test_rules(spark):
    index = url_filter.build_index(spark.createDataFrame(catalog.RULES, "host string, path string, verdict string"))
    got = {r["id"]: tuple(r)[1:] for r in url_filter.judge(rows(spark, URLS + URLS[:5]), index).collect()}
    assert got == {i: slow(u, catalog.RULES) for i, u in enumerate(URLS + URLS[:5])}
    assert url_filter.judge(rows(spark, URLS).where("1 = 0"), index).collect() == []


def test_no_rules_and_double_rules(spark):
    none = url_filter.build_index(spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in url_filter.judge(rows(spark, URLS), none, default="block").collect()} == {"block"}
    both = url_filter.build_index(spark.createDataFrame([("Com", "", "allow"), ("com", "", "block"), (None, "/", "block")], "host string, path string, verdict string"))
    assert [r["verdict"] for r in url_filter.judge(rows(spark, ["http://a.com"]), both).collect()] == ["block"]


def test_rules_of_many_lengths(spark):
    """A hundred host lengths times sixty path lengths."""
    rules = [("h" * h + ".org", "/" + "p" * p, "block" if (h + p) % 3 else "allow") for h in range(1, 101) for p in range(60)]
    rules += [("org", "/p", "block"), ("", "/x", "block")]
    index = url_filter.build_index(spark.createDataFrame(rules, "host string, path string, verdict string"))
    urls = [f"http://{'a.' * (i % 3)}{'h' * (i % 103 + 1)}.org/{'p' * (i * 7 % 64)}{'q' * (i % 2)}" for i in range(700)] + ["http:///xy", "http://a./xy", "http://h.org"]
    got = {r["id"]: tuple(r)[1:] for r in url_filter.judge(rows(spark, urls), index).collect()}
    assert got == {i: slow(u, rules) for i, u in enumerate(urls)}


def test_equal_digests_are_confirmed(spark, monkeypatch):
    """With every key equal, the stored strings alone decide."""
    index = url_filter.build_index(spark.createDataFrame(catalog.RULES, "host string, path string, verdict string"))
    keys = url_filter._mapped(index.keys, np.int64)
    mapped = url_filter._mapped
    monkeypatch.setattr(url_filter, "_mapped", lambda name, kind: np.zeros(len(keys), np.int64) if name == index.keys else mapped(name, kind))
    real = url_filter.xxhash.xxh64_intdigest
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text, seed: 0 if b"/" in text else real(text, seed))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(len(URLS))), "url": URLS})
    out = next(url_filter._judge(index, "allow")(iter([batch]))).to_pylist()
    assert [tuple(r.values())[1:] for r in out] == [slow(u, catalog.RULES) for u in URLS]
