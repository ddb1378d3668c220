"""SimHash near-duplicate classes, searched with BK-trees.

Texts become 64-bit fingerprints of their word shingles; equal fingerprints fold to one node. Nodes
within ``radius`` bits are linked, and every row gets the class it reaches over links.

How the search is dealt out: two fingerprints that differ in at most 2 of 64 bits agree on at least 2
of 4 blocks of 16 bits, so each fingerprint goes to the 6 buckets named by a pair of its blocks, and
every link is found in one of them. A bucket is a shard with a BK-tree of its own (children keyed by
their Hamming distance to the parent); a search follows only the edges within the radius. Buckets
with more members than ``shard_size`` are cut into slices, and each pair of slices is a shard: the
tree of one slice, probed by the other. A shard reports its local classes as one link per
member, never as pairs, so a dense group costs as many rows as it has members.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; equal
texts and repeated rows share fingerprint and class and all stay; a row without id keeps its class (the smallest
id that is not null); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.components import components
from spanweave.llm.names import free_name
from spanweave.session import materialize

BLOCKS = 4
BLOCK_BITS = 16
MAX_RADIUS = BLOCKS - 2
SLICE_ROWS = 4096
#: bits that tell which rows may have to go
FILTER_BITS = 1 << 24


def shingle_hashes(raw: bytes | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words of a text (ASCII lower case, ASCII white space)."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[i:j], seed) for i, j in zip(starts, ends[width - 1 :].tolist())), np.uint64, n)


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; zero without words."""
    hashes = shingle_hashes(raw, width, seed)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE_ROWS):
        part = hashes[at : at + SLICE_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3, seed: int = 42) -> DataFrame:
    """One row (id, fp) per input row; fp is the fingerprint as a signed long."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            marks = np.fromiter((fingerprint(t.as_py(), width, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(mark, f"id {kind}, fp bigint")


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while (distance := (node[0] ^ value).bit_count()) != 0:
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (value, {})
                return
            node = child

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Stored values within the radius; only edges that can lead to one are followed."""
        stack = [self.root] if self.root is not None else []
        while stack:
            stored, children = stack.pop()
            distance = (stored ^ value).bit_count()
            if distance <= radius:
                yield stored
            if len(children) <= 2 * radius:
                stack.extend(child for edge, child in children.items() if -radius <= edge - distance <= radius)
            else:
                for edge in range(distance - radius, distance + radius + 1):
                    if (child := children.get(edge)) is not None:
                        stack.append(child)


def local_links(stored: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each local class of a shard: the tree holds ``stored``."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    tree = BKTree()
    same = stored is probes
    for value in stored:
        if not same:
            tree.add(value)
    for value in probes:
        for other in tree.near(value, radius):
            a, b = find(value), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if same:
            tree.add(value)
    return [(x, find(x)) for x in list(parent)]


def _search(radius: int):
    """Shards arrive whole and sorted; a shard that spans two batches is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            a, b = zip(*out) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def solve(rows: np.ndarray) -> None:
            # columns: bucket, low slice, high slice, slice of the row, fingerprint
            if rows[0, 1] == rows[0, 2]:
                stored = probes = rows[:, 4].view(np.uint64).tolist()
            else:
                low = rows[:, 3] == rows[0, 1]
                stored, probes = rows[low, 4].view(np.uint64).tolist(), rows[~low, 4].view(np.uint64).tolist()
            for a, b in local_links(stored, probes, radius):
                if a != b:
                    out.append((a - (a >> 63 << 64), b - (b >> 63 << 64)))

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            rows = np.concatenate(held)
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            for i, j in zip(bounds, bounds[1:]):
                if j - i > 1:
                    solve(rows[i:j])
            held = [np.ascontiguousarray(rows[bounds[-1] :])]
            yield flush()
        if held and len(held[0]) > 1:
            solve(held[0])
        yield flush()

    return run


def near_links(nodes: DataFrame, radius: int = 2, shard_size: int = 2048) -> DataFrame:
    """Links (a, b) that join exactly those distinct fingerprints (column fp) which chains of
    distances up to ``radius`` join."""
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"radius must be 0 to {MAX_RADIUS}: {BLOCKS} blocks find no more with certainty")
    mask = (1 << BLOCK_BITS) - 1
    block = [F.shiftrightunsigned(F.col("fp"), BLOCK_BITS * i).bitwiseAND(F.lit(mask)) for i in range(BLOCKS)]
    names = [
        F.shiftleft(F.lit(at).cast("bigint"), 2 * BLOCK_BITS) + F.shiftleft(block[i], BLOCK_BITS) + block[j]
        for at, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    placed = nodes.select("fp", F.explode(F.array(*names)).alias("bucket"))
    large = (
        placed.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > shard_size)
        .select("bucket", F.ceil(F.col("members") / shard_size).cast("bigint").alias("slices"))
    )
    sliced = placed.join(large, "bucket", "left").select(
        "bucket", "fp", F.coalesce("slices", F.lit(1).cast("bigint")).alias("slices"),
        F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1).cast("bigint"))).alias("slice"),
    )
    shards = sliced.select(
        "bucket", "fp", "slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("other")
    ).select(
        "bucket", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice", "fp"
    )
    dealt = shards.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "fp")
    return dealt.mapInArrow(_search(radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, seed: int = 42,
    shard_size: int = 2048,
) -> DataFrame:
    """One row (id, fp, component) per input row; component is the smallest id of the class."""
    marks = materialize(fingerprints(docs, id_col, text_col, width, seed), "simhash-marks")
    nodes = marks.groupBy("fp").agg(F.min("id").alias("first"))
    links = near_links(nodes.select("fp"), radius, shard_size)
    labels = components(links)
    rooted = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = rooted.join(named, "root").select("fp", "component")
    return marks.join(classes, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The row with the smallest id of each class, with all its columns.

    Rows that share an id are one document: one of them stays. Rows without id stay."""
    return keepers_of(docs, near_duplicates(docs, id_col, **options), id_col)


def keepers_of(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As :func:`keep_one`, for classes (id, component) that were found by any method.

    Texts stay where they are: a bitmap of fixed size tells which rows may have to go (their id is not that of their class, or
    is repeated), and only those are joined with the ids that stay."""
    ids = materialize(
        found.where("id is not null").groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("stays"), F.count("*").alias("rows")), "classes"
    )
    key, place = F.col(f"`{id_col}`"), lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = (
        ids.where("not stays or rows > 1").select(place("id").alias("place")).groupBy(F.floor(F.col("place") / 64).alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    )
    names = {n: free_name(n, docs.columns) for n in ("at", "bits")}
    # at most FILTER_BITS / 64 rows
    marked = docs.withColumn(names["at"], F.floor(place(key) / 64)).join(
        F.broadcast(bits.withColumnsRenamed(names)), names["at"], "left"
    )
    hit = F.coalesce(F.expr(f"shiftright({names['bits']}, cast(pmod(xxhash64(`{id_col}`), {FILTER_BITS}) % 64 as int)) & 1") == 1, F.lit(False)) & key.isNotNull()
    own = [F.col(f"`{c}`") for c in docs.columns]
    stay, open_ = marked.where(~hit).select(*own), marked.where(hit).select(*own)
    keeper = free_name("keeper", docs.columns)
    keepers = ids.where("stays").select(F.col("id").alias(keeper), "rows")

    def rows_of(some: DataFrame) -> DataFrame:
        # as many keepers as classes: never broadcast, whatever the planner thinks of a small corpus
        return open_.join(some.select(keeper).hint("merge"), key == F.col(keeper), "left_semi")

    kept = stay.unionAll(rows_of(keepers.where("rows = 1")))
    repeated = keepers.where("rows > 1")
    return kept if repeated.isEmpty() else kept.unionAll(rows_of(repeated).dropDuplicates([id_col]))
