"""Benchmark decontamination with suffix arrays over the training texts.

Every task builds suffix arrays over shards of its training documents (whole documents, about
``shard_words`` words together) and binary-searches every distinct benchmark window in them: a
window is the first ``window`` words of a test suffix, or the whole item if it is shorter. The
interval found holds all places where the suffix occurs verbatim; windows that follow each other are
merged, which gives the longest matches. Nothing is shuffled: only benchmark windows travel,
as a broadcast whose size is checked.

A suffix is kept in the array only where it can match at all: the next words, as many as the shortest
window has, must be benchmark words. Words become numbers of the benchmark vocabulary (0: any other
word, and the gap between documents), and the leading words of a suffix are packed into a few
64-bit keys, so sorting and searching compare whole keys.

A benchmark of more than ``block_words`` window words is searched in blocks, each a pass over the
documents; hits of earlier passes travel along in a column, so the result is the same.

Defined results: a null text has no words; items without words match nothing; repeated items count once
each under their own id; items without id count as one item whose id is null and comes first in the list, and their windows
hit like any other; repeated documents are judged each; an empty benchmark leaves every document clean; other
columns are kept (:func:`judge` appends its own under ``found``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize

#: word bytes keep their (ASCII lower-case) value, all others become spaces
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
FOUND = "struct<n_words: bigint, spans: array<bigint>, items: array<bigint>>"


def in_order(items: set[int | None]) -> list[int | None]:
    return sorted(items, key=lambda x: (x is not None, x or 0))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(WORD_BYTES).split()


class Windows(NamedTuple):
    """Distinct windows of a block of the benchmark, ready for searching."""

    vocabulary: dict[bytes, int]
    sizes: np.ndarray  # words in each window
    low: np.ndarray  # packed keys of the least suffix that starts with the window, one row per key
    high: np.ndarray  # and of the greatest
    items: list[list[int | None]]  # ids of the items that hold each window
    bits: int
    longest: int
    shortest: int


def pack_keys(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """As many words as fit go into each 63-bit key, first word highest."""
    each = 63 // bits
    keys = []
    for at in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), np.int64)
        for i in range(each):
            key <<= bits
            if at + i < len(columns):
                key |= columns[at + i]
        keys.append(key)
    return keys


def build_windows(items: list[tuple[int | None, tuple[bytes, ...]]]) -> Windows | None:
    """items: (item id, words of one window)."""
    holders: dict[tuple[bytes, ...], set[int | None]] = {}
    for item, words in items:
        holders.setdefault(words, set()).add(item)
    if not holders:
        return None
    vocabulary = {w: n for n, w in enumerate(sorted({w for words in holders for w in words}), 1)}
    bits = len(vocabulary).bit_length()
    windows = sorted(holders)
    sizes = np.array([len(w) for w in windows])
    longest = int(sizes.max())
    low = np.zeros((len(windows), longest), np.int64)
    for row, words in enumerate(windows):
        low[row, : len(words)] = [vocabulary[w] for w in words]
    high = np.where(np.arange(longest) < sizes[:, None], low, (1 << bits) - 1)
    return Windows(
        vocabulary, sizes, np.array(pack_keys(list(low.T), bits)), np.array(pack_keys(list(high.T), bits)),
        [in_order(holders[w]) for w in windows], bits, longest, int(sizes.min()),
    )


def suffix_array(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions that can start a match in the order of their suffixes, and their packed keys."""
    gaps = np.where(ids == 0, np.arange(len(ids)), len(ids))
    run = np.minimum.accumulate(gaps[::-1])[::-1] - np.arange(len(ids))
    places = np.flatnonzero(run >= windows.shortest)
    padded = np.concatenate([ids, np.zeros(windows.longest, ids.dtype)]).astype(np.int64)
    keys = pack_keys([padded[places + i] for i in range(windows.longest)], windows.bits)
    order = np.lexsort(keys[::-1])
    return places[order], [k[order] for k in keys]


def search(keys: list[np.ndarray], probes: np.ndarray, strict: bool) -> np.ndarray:
    """For each probe, how many suffixes are less (or, if not strict, not greater): binary search."""
    n = len(keys[0])
    low, high = np.zeros(probes.shape[1], np.int64), np.full(probes.shape[1], n)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, n - 1)
        less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for key, probe in zip(keys, probes):
            value = key[middle]
            less |= same & (value < probe)
            same &= value == probe
        if not strict:
            less |= same
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def occurrences(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence of a window in a shard."""
    places, keys = suffix_array(ids, windows)
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = search(keys, windows.low, True), search(keys, windows.high, False)
    counts = last - first
    which = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return places[at], which


def _judge_shard(texts: list[bytes | None], earlier: list[dict | None], windows: Windows) -> list[dict]:
    lookup = windows.vocabulary.get
    counts, ids = [], []
    gap = np.zeros(1, np.int32)
    for raw in texts:
        words = words_of(raw)
        counts.append(len(words))
        ids += [np.fromiter((lookup(w, 0) for w in words), np.int32, len(words)), gap]
    shard = np.concatenate(ids)
    starts = np.concatenate([[0], np.cumsum(np.asarray(counts) + 1)])
    place, which = occurrences(shard, windows)
    order = np.argsort(place, kind="stable")
    place, which = place[order], which[order]
    bounds = np.searchsorted(place, starts)
    out = []
    for i, n in enumerate(counts):
        own, kind = place[bounds[i] : bounds[i + 1]] - starts[i], which[bounds[i] : bounds[i + 1]]
        before = earlier[i] or {"spans": [], "items": []}
        spans, items = before["spans"], set(before["items"])
        if len(own):
            spans = spans + np.stack([own, own + windows.sizes[kind]], axis=1).ravel().tolist()
            for w in np.unique(kind).tolist():
                items.update(windows.items[w])
        out.append({"n_words": n, "spans": merge_spans(spans), "items": in_order(items)})
    return out


def merge_spans(flat: list[int]) -> list[int]:
    """Union of half-open spans, given and returned as start, end, start, end, ..."""
    merged: list[int] = []
    for start, end in sorted(zip(flat[::2], flat[1::2])):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def _pass(shared, text_col: str, names: list[str], shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_binary())
            earlier = batch.column("__found").to_pylist()
            found, held, size, at = [], [], 0, 0
            for i, raw in enumerate(texts):
                held.append(raw.as_py())
                size += len(held[-1] or b"") // 4 + 1
                if size >= shard_words or i + 1 == len(texts):
                    found += _judge_shard(held, earlier[at : i + 1], windows)
                    held, size, at = [], 0, i + 1
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, kind)], [*names, "__found"])

    return run


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows (words) of every item with the items that hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[int | None, bytes], None] = {}
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                words = words_of(raw.as_py())
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    rows[item, b" ".join(words[i : i + window])] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1].decode() for k in rows], pa.string())], ["item", "words"]
            )

    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.where("text is not null").mapInArrow(cut, "item bigint, words string").distinct()


def find(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 13, shard_words: int = 1 << 20, block_words: int = 1 << 22,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all without it) and ``__found``: n_words, the merged hit
    spans (in words, flat) and the items with occurring windows."""
    spark = docs.sparkSession
    docs = docs.drop("__found")
    keep = docs.columns if keep is None else keep
    listed = materialize(item_windows(benchmark, item_id, item_text, window), "windows")
    blocks = max(1, -(-listed.count() * window // block_words))
    moved = [*keep, *([] if text_col in keep else [text_col])]
    current = docs.select(*[F.col(f"`{n}`") for n in moved]).withColumn("__found", F.expr(f"cast(null as {FOUND})"))
    for block in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block) if blocks > 1 else listed
        windows = build_windows([(r["item"], tuple(r["words"].encode().split())) for r in part.toLocalIterator()])
        if windows is None:
            windows = build_windows([(0, (b"",))])._replace(items=[[]])  # matches nothing: no word is empty
        last = block + 1 == blocks
        names = keep if last else moved
        schema = ", ".join([*(f"`{n}` {current.schema[n].dataType.simpleString()}" for n in names), f"__found {FOUND}"])
        current = current.mapInArrow(_pass(spark.sparkContext.broadcast(windows), text_col, names, shard_words), schema)
        if not last:
            current = materialize(current, "hits")
    return current


def hit_words(found: str) -> Column:
    """Number of words inside the merged spans."""
    return F.expr(
        f"aggregate(sequence(0, cast(size({found}.spans) / 2 as int)), 0L, (n, i) -> n + "
        f"coalesce(get({found}.spans, 2 * i + 1) - get({found}.spans, 2 * i), 0L))"
    )


def judge(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """As :func:`find`, with n_hit and contaminated (a hit, and at least one word in ``share``) in ``__found``."""
    rows = find(docs, benchmark, **options)
    hit = hit_words("__found")
    return rows.withColumn("__found", F.struct(
        F.col("__found.n_words").alias("n_words"), hit.alias("n_hit"), F.col("__found.items").alias("items"),
        F.col("__found.spans").alias("spans"),
        ((hit > 0) & (share * hit >= F.col("__found.n_words"))).alias("contaminated"),
    ))
