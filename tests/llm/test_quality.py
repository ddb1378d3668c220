import math
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from cases import no_rows, odd_rows
from pyspark.sql import functions as F

from spanweave.llm import catalog, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op10_quality"](spark, SF).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    kept = [(q, got[k]) for k, q in labels if got[k]["held_out"]]
    assert len(kept) > 100 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert np.mean([r["predicted"] == q for q, r in kept]) > 0.97
    assert np.mean([r["predicted"] for q, r in kept if q == 1]) > 0.98


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    one, two = (quality.fit(docs, x)[1] for x in (labels, turned))
    assert all(np.array_equal(a, b) for a, b in zip(one, two))


def test_word_vectors_do_not_depend_on_the_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert np.array_equal(quality.word_vectors(docs.coalesce(1)), quality.word_vectors(docs.repartition(5)))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (7, 0), (None, 1), (9, None), (2, 0), (3, 7)], "doc_id bigint, quality int")
    model = quality.fit(odd_rows(spark), labels)
    got = quality.score(odd_rows(spark), model)
    assert got.columns == [*odd_rows(spark).columns, "__score"] and got.count() == 11
    assert len({r["__score"] for r in got.where("doc_id in (1, 2, 3)").collect()}) == 1
    assert quality.score(no_rows(spark), quality.fit(no_rows(spark), labels)).collect() == []
    nothing = quality.fit(odd_rows(spark), labels.where("1 = 0"))
    assert {round(r["__score"], 6) for r in quality.score(odd_rows(spark), nothing).collect()} == {0.5}


def test_scores_match_a_plain_twin(spark):
    """Context sums, pooled vectors and the forward pass once more, token by token in plain Python."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r["doc_id"], re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]", (r["text"] or "").encode())) for r in docs.collect()]
    index = quality.index_vectors().tolist()
    streams = {k: [xxhash.xxh32_intdigest(t) % 2**14 for t in tokens] for k, tokens in rows}
    sums = defaultdict(lambda: [0] * quality.DIMS)
    for own in streams.values():
        for i, b in enumerate(own):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(own):
                    sums[b] = [x + y for x, y in zip(sums[b], index[own[j]])]
    unit = {b: [x / max(math.sqrt(sum(y * y for y in v)), 1e-9) for x in v] for b, v in sums.items()}
    vectors, network = quality.fit(docs, labels)
    assert all(np.allclose(vectors[b], v, atol=1e-6) for b, v in unit.items())
    sample = {r["__id"] for r in quality.labelled_sample(labels, "doc_id", "quality", 20_000).collect()}
    assert sample == {r["doc_id"] for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}

    def twin(own):
        x = [0.0] * quality.WIDTH
        if own:
            each = [unit.get(b, [0.0] * quality.DIMS) for b in own]
            mean = [sum(c) / len(own) for c in zip(*each)]
            spread = [math.sqrt(max(sum(v * v for v in c) / len(own) - m * m, 0)) for c, m in zip(zip(*each), mean)]
            x = [*mean, *spread, len(set(own)) / len(own), sum(a == b for a, b in zip(own, own[1:])) / len(own), math.log1p(len(own)) / 10]
        z = [(v - c) / s for v, c, s in zip(x, network.centre.tolist(), network.scale.tolist())]
        hidden = [max(sum(v * w for v, w in zip(z, column)) + b, 0) for column, b in zip(network.hidden.T.tolist(), network.hidden_bias.tolist())]
        logit = sum(h * w for h, w in zip(hidden, network.output.tolist())) + network.output_bias
        return 1 / (1 + math.exp(-max(-35, min(35, logit / network.temperature))))

    got = {r["doc_id"]: r for r in catalog.QUERIES["op10_quality"](spark, sf).collect()}
    assert got.keys() == streams.keys()
    for k, own in streams.items():
        assert abs(got[k]["score"] - twin(own)) < 2e-3, k
