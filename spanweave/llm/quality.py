"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing: every token falls into one of ``BUCKETS`` buckets; a bucket has a fixed sparse
ternary index vector, and its context vector is the sum of the index vectors of its neighbours over
all texts. Tasks add up whole numbers for their documents, Spark sums them per bucket; the result has a
fixed size, whatever the corpus.

A document is the mean and the spread of the (unit) context vectors of its tokens, the shares of
distinct tokens and of tokens that repeat the one before, and its length.
A network of two layers in numpy is trained on a bounded sample of labelled rows (``sample`` rows of
lowest hash) and calibrated by a temperature on a part of them that training does not see.

Defined results: null, empty and token-free texts pool to the zero vector and get its score; repeated rows are
scored alike; labels that are null, other than 0 and 1, or contradict each other are left out; without both
labels the score is the share of ones (0.5 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
DIMS = 32
NONZERO = 4
REACH = 2
SLICE_TOKENS = 1 << 17
SAMPLE_ROWS = 20_000
WIDTH = 2 * DIMS + 3
HIDDEN = 32
EPOCHS = 40
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]")


def index_vectors() -> np.ndarray:
    """The ternary index vector of each bucket; the row after the last one (no token) is zero."""
    vectors = np.zeros((BUCKETS + 1, DIMS), np.int16)
    draw = np.random.default_rng(1)
    places = draw.random((BUCKETS, DIMS)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(vectors[:BUCKETS], places, draw.choice(np.array([-1, 1], np.int16), (BUCKETS, NONZERO)), axis=1)
    return vectors


def buckets_of(raw: bytes | None) -> np.ndarray:
    tokens = TOKEN.findall(raw or b"")
    digest = xxhash.xxh32_intdigest
    return np.fromiter((digest(t) for t in tokens), np.int64, len(tokens)) & (BUCKETS - 1)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    sums, counts = np.zeros((DIMS, BUCKETS)), np.zeros(BUCKETS, np.int64)

    def add(stream: np.ndarray) -> None:
        around = np.zeros((len(stream), DIMS), np.int16)
        for step in range(1, REACH + 1):
            around[step:] += index[stream[:-step]]
            around[:-step] += index[stream[step:]]
        real = stream < BUCKETS
        places = stream[real]
        counts[:] += np.bincount(places, minlength=BUCKETS)
        for d in range(DIMS):
            sums[d] += np.bincount(places, around[real, d], BUCKETS)

    gap = np.full(REACH, BUCKETS)
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for raw in batch.column(0).cast(pa.large_binary()):
            stream = buckets_of(raw.as_py())
            for at in range(0, max(1, len(stream)), SLICE_TOKENS):
                # slices of a very long text are cut apart; the texts of a slice are kept apart by gaps
                held += [stream[at : at + SLICE_TOKENS], gap]
                size += len(held[-2]) + REACH
                if size >= SLICE_TOKENS:
                    add(np.concatenate(held))
                    held, size = [], 0
    if held:
        add(np.concatenate(held))
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(counts[seen]), *(pa.array(sums[d, seen].astype(np.int64)) for d in range(DIMS))],
        ["bucket", "n", *(f"d{d}" for d in range(DIMS))],
    )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vector of every bucket over all texts (BUCKETS x DIMS, a fixed size)."""
    names = [f"d{d}" for d in range(DIMS)]
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _context_sums, ", ".join(f"{n} bigint" for n in ["bucket", "n", *names])
    )
    found = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    if found.num_rows:
        sums = np.stack([found.column(n).to_numpy() for n in names], axis=1).astype(np.float64)
        vectors[found.column("bucket").to_numpy()] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return vectors


def pooled(raw: bytes | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the token vectors, distinct and repeating tokens, and the length."""
    stream = buckets_of(raw)
    out = np.zeros(WIDTH, np.float32)
    if len(stream):
        kinds, counts = np.unique(stream, return_counts=True)
        own, weight = vectors[kinds], (counts / len(stream)).astype(np.float32)
        mean = weight @ own
        out[:DIMS] = mean
        out[DIMS : 2 * DIMS] = np.sqrt(np.maximum(weight @ (own * own) - mean * mean, 0))
        out[-3] = len(kinds) / len(stream)
        out[-2] = np.count_nonzero(stream[1:] == stream[:-1]) / len(stream)
        out[-1] = np.log1p(len(stream)) / 10
    return out


class Network(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    output: np.ndarray
    output_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.centre) / self.scale @ self.hidden + self.hidden_bias, 0)
        return z @ self.output + self.output_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Two layers by Adam on cross entropy; the temperature minimises it on every fifth row."""
    x = x.astype(np.float64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        bias = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), bias, 1.0)
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    fit_x, fit_y = x[~aside], y[~aside].astype(np.float64)
    centre, scale = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-3
    fit_x = (fit_x - centre) / scale
    draw = np.random.default_rng(7)
    weights = [
        draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    size = int(min(256, max(16, len(fit_y) // 20)))
    for _ in range(epochs):
        order = draw.permutation(len(fit_y))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            a = fit_x[rows] @ weights[0] + weights[1]
            z = np.maximum(a, 0)
            miss = (_sigmoid(z @ weights[2] + weights[3]) - fit_y[rows]) / len(rows)
            back = np.outer(miss, weights[2]) * (a > 0)
            slopes = [fit_x[rows].T @ back + 1e-4 * weights[0], back.sum(axis=0), z.T @ miss + 1e-4 * weights[2], miss.sum(keepdims=True)]
            step += 1
            for w, s, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (s - m)
                v += 0.001 * (s * s - v)
                w -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    network = Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    if aside.any():
        logits, truth = network.logits(x[aside]), y[aside].astype(np.float64)
        options = np.geomspace(0.5, 10, 60)
        losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in options]
        network = network._replace(temperature=float(options[int(np.argmin(losses))]))
    return network


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, label) of at most ``rows`` labelled rows, those of lowest hash."""
    clear = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
        .where("label = other")
    )
    return clear.orderBy(F.xxhash64("__id"), "__id").limit(rows).select("__id", "label")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE_ROWS,
) -> tuple[np.ndarray, Network]:
    """Word vectors of all texts and a network trained on the labelled sample."""
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(t.as_py(), shared.value) for t in batch.column(2).cast(pa.large_binary())]
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32), pa.float32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(flat, WIDTH).cast(pa.list_(pa.float32()))],
                ["id", "label", "x"],
            )

    # the sample has a fixed bound of rows (id, label), so it may be broadcast
    picked = F.broadcast(labelled_sample(labels, id_col, label_col, sample))
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    rows = texts.join(picked, F.col("__doc") == F.col("__id")).select(
        F.col("__id").cast("bigint").alias("id"), F.col("label").cast("int").alias("label"), F.col("__text").alias("text")
    )
    pooled_rows = rows.mapInArrow(pool, "id bigint, label int, x array<float>")
    # one row for each id of the sample, however often it occurs
    found = pooled_rows.groupBy("id", "label").agg(F.max("x").alias("x")).toArrow()
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, WIDTH)
    order = np.lexsort((x[:, 0], found.column("id").to_numpy()))
    return vectors, train(x[order], found.column("label").to_numpy()[order])


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all without it) and ``__score``, the probability of label 1."""
    docs = docs.drop("__score")
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            rows = [pooled(t.as_py(), vectors) for t in batch.column(text_col).cast(pa.large_binary())]
            scores = network.scores(np.array(rows, np.float64).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(scores)], [*keep, "__score"])

    moved = docs.select(*[F.col(f"`{n}`") for n in [*keep, *([] if text_col in keep else [text_col])]])
    schema = ", ".join([*(f"`{n}` {moved.schema[n].dataType.simpleString()}" for n in keep), "__score double"])
    return moved.mapInArrow(run, schema)
