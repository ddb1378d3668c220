import hashlib
import itertools
import re
import time

from cases import SF, no_rows, odd_rows, texts
from pyspark.sql import functions as F

from spanweave.llm import catalog, pii

#: the base patterns as the contract gives them
BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def slow(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15]
            if fits[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def named(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


TRICKY = [
    "a@b.c%d@e.f x@y", "@a.b a@-.- a.b@c..d", "aé😀a@b.co 1.2.3.4.5.6.7.8 0001.0.0.0255 256.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111",
    "4111111111111111 4111111111111111", "12345678901234567890 +4111111111111111", "+1 (017) 555-7713 +33 1 23 45 67 89. +123456789012345678 ++1 2 3 4 5 6 7 8 9",
    "x" * 20_000 + "@" + "y" * 20_000, "1" * 30_000, "1." * 10_000, "+1" + "(" * 20_000, "a" * 30_000 + " b@c.de", "a@b" + ".c" * 20_000,
    "https://u:p@h.example/1.1.1.1/?q=+49 (30) 1234-5678", "1-1-1 2 3 4-4 5 5 6 6 7-8", "",
]


def test_base_spans(spark):
    rows = spark.createDataFrame(list(enumerate([*TRICKY, *texts(spark).values(), None])), "doc_id bigint, text string")
    for r in pii.spans(rows, {}).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["__spans"] if s["base"]] == slow(r["text"]), r["text"][:80]


def test_query(spark):
    for r in catalog.QUERIES["op6_pii"](spark, SF).collect():
        want = slow(texts_once(spark)[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(named(want).encode()).hexdigest()
        assert set(named(want).split(",")) <= set(r["spans"].split(","))


_texts = {}


def texts_once(spark):
    if not _texts:
        _texts.update(texts(spark))
    return _texts


def test_learned_spans(spark):
    """Spelled-out addresses and national numbers are added where the votes and their form speak for them."""
    many = [(i, f"please contact me by mail: name{i}@mail{i % 7}.com or phone +1 (555) 555-{1000 + i}") for i in range(60)]
    many += [(100 + i, f"write to person{i} [at] host{i % 5} [dot] com or call (555) 555-{2000 + i} today") for i in range(20)]
    many += [(200 + i, f"order {4000000000000000 + 7 * i} shipped") for i in range(40)]
    docs = spark.createDataFrame(many, "doc_id bigint, text string")
    weights = pii.train(docs)
    found = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["__spans"] if not s["base"]] for r in pii.spans(docs, weights).collect()}
    assert found[103] == [(0, "person3 [at] host3 [dot] com"), (3, "(555) 555-2003")]
    assert not any(found[k] for k in found if k < 100 or k >= 200)


def test_estimates_follow_the_votes(spark):
    counts = spark.createDataFrame([(0, "+++", 90), (0, "++0", 30), (0, "---", 80), (0, "--0", 20), (0, "0+0", 5), (0, "0-0", 5)], "kind int, votes string, n bigint")
    worth = {r["votes"]: r["chance"] for r in pii.vote_worth(counts).collect()}
    assert worth["+++"] > 0.99 and worth["---"] < 0.01 and worth["0+0"] > 0.9 > 0.1 > worth["0-0"]


def plain_redaction(text, spans):
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{pii.KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_context_and_redaction_match_a_plain_walk(spark):
    rows = spark.createDataFrame(list(enumerate([*TRICKY, *list(texts(spark).values())[:60]])), "doc_id bigint, text string")
    found = pii.spans(rows, {"0|+00": 1.0, "3|+00": 1.0}).withColumn("redacted", pii.redact(F.col("text"), F.col("__spans")))
    for r in found.collect():
        assert r["redacted"] == plain_redaction(r["text"], [(s["start"], s["end"], s["kind"]) for s in r["__spans"]])
    before = rows.select("text", F.explode(pii._found(F.col("text"), pii.PHONE, pii.PHONE_SIGN)).alias("f")).unionAll(
        rows.select("text", F.explode(pii._found(F.col("text"), pii.EMAIL, pii.EMAIL_SIGN)).alias("f")))
    seen = before.collect()
    assert len(seen) > 10
    for r in seen:
        start, end, match, context = r["f"]
        assert r["text"][start:end] == match and context == r["text"][max(0, start - pii.NEAR) : start]


def test_running_sums_and_maxima(spark):
    lists = [[], [5], [3, 1, 2], list(range(100, 0, -1)), [7] * 1000]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    got = rows.select("i", pii._running(F.col("v"), lambda a, b: a + b).alias("s"), pii._running(F.col("v"), F.greatest).alias("m")).collect()
    for r in got:
        own = lists[r["i"]]
        assert r["s"] == list(itertools.accumulate(own)) and r["m"] == list(itertools.accumulate(own, max))


def test_a_text_with_a_hundred_thousand_addresses(spark):
    n = 100_000
    text = " ".join(f"someone{i}@mail.example.com" for i in range(n))
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    begun = time.time()
    found = pii.spans(rows, {}).select(F.col("__spans").alias("s"), pii.redact(F.col("text"), F.col("__spans")).alias("t")).collect()[0]
    assert time.time() - begun < 120
    assert len(found["s"]) == n and found["t"] == " ".join(["[EMAIL]"] * n)
    assert all(text[s["start"] : s["end"]] == f"someone{i}@mail.example.com" for i, s in enumerate(found["s"]))


def test_redaction_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "é a@b.de, +41 11 111 11 11 11 11 and 1.2.3.4!"), (2, "none")], "doc_id bigint, text string")
    found = pii.spans(docs, {}).select("doc_id", pii.redact(F.col("text"), F.col("__spans")).alias("text"))
    assert dict(map(tuple, found.collect())) == {1: "é [EMAIL], [PHONE] and [IP]!", 2: "none"}
    odd = pii.spans(odd_rows(spark), pii.train(odd_rows(spark)))
    assert odd.columns == [*odd_rows(spark).columns, "__spans"] and all(r["__spans"] == [] for r in odd.collect()) and odd.count() == 11
    assert pii.spans(no_rows(spark), pii.train(no_rows(spark))).collect() == []
