import math
import zlib
from collections import Counter

import numpy as np
from cases import no_rows, odd_rows
from pyspark.sql import functions as F

from spanweave.llm import catalog, language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op4_language"](spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys() and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[k]["lang_pred"] == v for k, v in truth.items() if got[k]["held_out"]]) > 0.99


def test_held_out_languages_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    one, two = language.fit(docs), language.fit(changed)
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights) and one.temperature == two.temperature


def test_codewords_lie_apart():
    for n in (2, 3, 4, 5, 12, 60):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(n)
        assert apart.min() >= max(1, code.shape[1] // 4) and (np.abs(code.sum(axis=0)) < n).all()


def test_odd_rows(spark):
    docs = odd_rows(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    got = language.predict(docs, language.fit(docs))
    assert got.columns == [*docs.columns, "__lang"] and got.count() == 11
    names = {r["doc_id"]: r["__lang"] for r in got.collect()}
    assert all(names[k]["name"] == "und" and names[k]["score"] == 0 for k in (1, 2, 3, 9))
    assert {names[k]["name"] for k in (4, 5, 6, 7, 8)} <= {"a", "b"}
    assert language.predict(no_rows(spark), language.fit(docs)).collect() == []
    untaught = language.predict(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["__lang"]["name"] for r in untaught.collect()} == {"und"}
    one = language.predict(docs, language.fit(docs.withColumn("lang", F.lit("q"))))
    assert {r["__lang"]["name"] for r in one.collect()} == {"und", "q"}


def test_letters():
    assert [language.has_letter(t.encode()) for t in ("a", "é", "日", "12 ½ !", "", "·")] == [True, True, True, False, False, False]
    assert not language.has_letter(None)


def plain_grams(raw):
    letters = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in raw)
    text = b" " + b" ".join(letters.split()) + b" "
    for i, c in enumerate(text):
        yield c
        if i:
            yield 256 + ((text[i - 1] * 256 + c) * 2654435761 % 2**32 >> 19)
        if i > 1:
            yield 256 + 2**13 + (((text[i - 2] * 256 + text[i - 1]) * 256 + c) * 2654435761 % 2**32 >> 18)


def test_scores_match_a_plain_twin(spark):
    """Counts, bit weights, worth, temperature and decoding once more, text by text in plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    taught = [(t.encode(), lang) for k, t, lang in docs if zlib.crc32(str(k).encode()) % 3 != 1 and lang is not None and t is not None]
    names = sorted({lang for _, lang in taught})
    counts = {lang: Counter() for lang in names}
    for raw, lang in taught:
        counts[lang].update(plain_grams(raw))
    size = 256 + 2**13 + 2**14
    share = {lang: [(c[f] + 0.5) / (sum(c.values()) + 0.5 * size) for f in range(size)] for lang, c in counts.items()}
    code = {lang: row for lang, row in zip(names, language.codewords(len(names)).tolist())}
    bits = range(len(code[names[0]]))
    weights = []
    for b in bits:
        one, two = ([share[x] for x in names if (code[x][b] > 0) == side] for side in (True, False))
        weights.append([math.log(sum(p) / len(one) / (sum(q) / len(two))) for p, q in zip(zip(*one), zip(*two))])

    def margins(raw):
        own = list(plain_grams(raw))
        return [sum(w[f] for f in own) / len(own) * 3 for w in weights]

    known = [(margins(raw), lang) for raw, lang in taught]
    worth = [max(2 * sum(m[b] * code[lang][b] > 0 for m, lang in known) / len(known) - 1, 0.05) for b in bits]
    losses = lambda m: {x: sum(w * math.log1p(math.exp(-4 * v * c)) for w, v, c in zip(worth, m, code[x])) for x in names}

    def shares(m, temperature):
        own = losses(m)
        total = sum(math.exp((min(own.values()) - v) / temperature) for v in own.values())
        return {x: math.exp((min(own.values()) - v) / temperature) / total for x, v in own.items()}

    miss = lambda t: -sum(math.log(max(shares(m, t)[lang], 1e-300)) for m, lang in known)
    temperature = min(np.geomspace(0.02, 5, 60).tolist(), key=miss)
    got = {r["doc_id"]: r for r in catalog.QUERIES["op4_language"](spark, sf).collect()}
    for k, text, _ in docs:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0)
            continue
        own = sorted(((-v, x) for x, v in shares(margins(text.encode()), temperature).items()))
        assert got[k]["lang_pred"] == own[0][1] and abs(got[k]["score"] + own[0][0]) < 1e-4
        assert got[k]["ambiguous"] == (own[1][0] - own[0][0] < 0.2)
