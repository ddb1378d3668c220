"""Near-copy classes by exact Jaccard similarity of word shingles.

Two texts are linked if they share at least ``share`` (4 of 5 by default) of the distinct shingles of
``width`` words that either has; every row gets the class it reaches over links. Fingerprint distances
do not bound this similarity (short texts at 0.83 differ in 17 of 64 bits), so candidates come from prefixes:
in any one order of all shingles, two such texts share one of the first n - ceil(share * n) + 1 of each.

How it is dealt out: equal shingle sets fold to one node. Prefixes are ordered by
how often a sample of the texts holds a shingle (most hold it never), then by hash, so that common lines come last; the
sample decides only how much work there is. They go through one shuffle to the buckets of their shingles, where the
members stream by in sorted order behind the first one, the hub, with which each is compared; the hub is the member with the
fewest shingles of its own, so of a dense group this leaves a class and few others, and costs as many rows as it has members. A second
turn takes other orders, for members whose classes still differ. Then the members of a bucket outside its largest class are compared with all of other
classes, in slices where they are many.

Before any set travels, a pair has to pass two exact bounds: what the sizes and places of the shared shingle
leave, and the sum of minima of the two counts of shingles by hash class (``_sketch``, at most a byte for each
shingle, whose hash has eight). Only the sets of pairs that pass are built again from their texts and sent, once for each pair; all
similarities are exact counts.

Classes that another search of the same texts finds (``also``) are links like any other: they go in after the first turn, so that later
turns leave out pairs which they join.

Defined results: a null or empty text, or one without words, has the empty set, and all those are one class, as in
:mod:`spanweave.llm.simhash`; a text of fewer than ``width`` words is one shingle; repeated rows share a class and all stay; a row
without id keeps its class (the smallest id that is not null); an empty table gives an empty table. Shingles, sets
and rows are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.components import components
from spanweave.llm.simhash import shingle_hashes
from spanweave.session import materialize

SHARE = (4, 5)
#: one text in so many is counted, and shingles that so many of those hold are common
SAMPLE, COMMON, MOST_COMMON = 32, 4, 1 << 17
FILTER_BITS = 1 << 24
#: how many orders choose the hubs of a turn
ORDERS = (2, 8)
#: members of one bucket that are compared with all others in one slice
SLICE = 1000
#: sets that a task remembers, so as not to send the prefix of a copy again
REMEMBERED = 1 << 20
#: prefix rows and sets that a task hands over at once
ROWS_TOGETHER, SETS_TOGETHER = 1 << 15, 1 << 9


def shingle_set(raw: bytes | None, width: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(raw, width, seed))


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.astype("<u8").tobytes())


def prefix_size(n: int, share: tuple[int, int] = SHARE) -> int:
    """Two sets that are similar enough share one of so many first members of each."""
    return n + (-share[0] * n // share[1]) + 1 if n else 0


def _sketch(own: np.ndarray) -> bytes:
    """Members by hash class, one to two to a class; empty if a class has too many to count in a byte.

    Members that two sets do not share count as shared where they meet by chance; in classes so small few do."""
    classes = 1 << max(0, len(own).bit_length() - 1)
    counts = np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_common_members(a: bytes, b: bytes) -> int | None:
    """Upper bound of the members that two sets share, by their sketches."""
    if not a or not b:
        return None
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in sorted((a, b), key=len))
    # classes are the last bits of a hash, so a finer sketch folds to a coarser one
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(0)).sum())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): mark names a row by its id and text."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.col(f"`{id_col}`")
    return docs.select(key.alias("id"), F.xxhash64(key, text).alias("mark"), text.alias("text"))


def common_shingles(texts: DataFrame, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts hold, in the order of their hashes, and how many hold each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width, seed).view(np.int64))], ["shingle"])

    sample = texts.where(F.pmod("mark", F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(cut, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()
    names, held = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(names)
    return names[order], held[order]


def _marks(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, mark, key and size n of the set, its sketch) per row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, seed) for t in batch.column(2).cast(pa.large_binary())]
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int32()), pa.array(map(_sketch, sets), pa.binary())],
                ["id", "mark", "key", "n", "sketch"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(mark, f"id {kind}, mark bigint, key bigint, n int, sketch binary")


def _prefixes(texts: DataFrame, width: int, seed: int, share: tuple[int, int]) -> DataFrame:
    """(shingle, key, n, at) of the prefix of each set; a task sends that of copies once."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width, seed))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = shared.value
        seen: set[int] = set()
        for batch in batches:
            parts: list[tuple[np.ndarray, int, int]] = []
            for text in batch.column(0).cast(pa.large_binary()):
                own = shingle_set(text.as_py(), width, seed)
                key = set_key(own)
                if key in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                n, first = len(own), prefix_size(len(own), share)
                if len(names):
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    own = own[np.argsort(np.where(names[at] == own, held[at], 0), kind="stable")]
                parts.append((own[:first], key, n))
            sizes = np.array([len(p) for p, _, _ in parts], np.int64)
            if sizes.sum():
                ends = np.cumsum(sizes)
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p for p, _, _ in parts]).view(np.int64)),
                     pa.array(np.repeat(np.array([k for _, k, _ in parts], np.uint64).view(np.int64), sizes)),
                     pa.array(np.repeat(np.array([n for _, _, n in parts], np.int32), sizes)),
                     pa.array((np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32))],
                    ["shingle", "key", "n", "at"],
                )
                # the JVM holds a batch outside its heap
                for at in range(0, whole.num_rows, ROWS_TOGETHER):
                    yield whole.slice(at, ROWS_TOGETHER)

    return texts.select("text").mapInArrow(cut, "shingle bigint, key bigint, n int, at int")


MEMBER = ("key", "n", "at", "root")
BUCKETS = "shingle bigint, key bigint, n int, at int, root bigint, hub_key bigint, hub_n int, hub_at int, hub_root bigint"


def _with_hubs(members: DataFrame, turn: int) -> DataFrame:
    """Distinct members (shingle, key, n, at, root) of buckets of two or more, each with the bucket's hub.

    The hub is the member with the least share of its set before the shingle: of copies that were edited the one with the fewest
    edits, which is close to most others. Equals follow one of a few orders. The others stream by behind the hub, so a task holds no bucket."""
    rank = F.xxhash64("key", F.pmod("shingle", F.lit(ORDERS[turn])), F.lit(turn))
    sorted_ = members.repartition("shingle").sortWithinPartitions("shingle", F.col("at") / F.col("n"), rank, "key").select("shingle", *MEMBER)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, lone, before = None, False, None  # hub of the open bucket, whether nothing followed it yet, key of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(5)]
            shingle, key = cols[0], cols[1]
            new = np.r_[hub is None or shingle[0] != hub[0], shingle[1:] != shingle[:-1]]
            again = ~new & (np.r_[key[0] if before is None else before, key[:-1]] == key)
            # hubs of this batch, after that of the bucket which is still open
            hubs = [np.concatenate([[c[0] if hub is None else hub[i]], c[new]]) for i, c in enumerate(cols)]
            of = np.cumsum(new)
            follows = ~new & ~again & (hubs[1][of] != key)
            # a hub is a member too, once something follows it
            met = np.zeros(len(hubs[0]), bool)
            met[of[follows]] = True
            first = np.flatnonzero(met & np.r_[lone, np.ones(len(met) - 1, bool)])
            out = [np.concatenate([c[follows], h[first]]) for c, h in zip(cols, hubs)]
            out += [np.concatenate([h[of[follows]], h[first]]) for h in hubs[1:]]
            lone = bool(not met[-1] and (lone if len(met) == 1 else True))
            hub, before = [h[-1] for h in hubs], key[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["shingle", *MEMBER, *[f"hub_{c}" for c in MEMBER]])

    return sorted_.mapInArrow(stream, BUCKETS)


def _fits(share: tuple[int, int], a: str = "", b: str = "hub_") -> Column:
    """Two sets can be similar enough with this as the first shingle they share: so many members are left in both."""
    needed = share[0] * (F.col(f"{a}n") + F.col(f"{b}n"))
    left = lambda tag: sum(share) * (F.col(f"{tag}n") - F.col(f"{tag}at")) >= needed
    return left(a) & left(b)


def _pairs(met: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b) of members and partners that have different roots and sizes that fit."""
    open_ = met.where((F.col("root") != F.col("hub_root")) & _fits(share))
    return open_.select(F.least("key", "hub_key").alias("a"), F.greatest("key", "hub_key").alias("b")).distinct()


def _rooted(members: DataFrame, labels: DataFrame) -> DataFrame:
    found = labels.select(F.col("node").alias("key"), F.col("root").alias("found"))
    return members.join(found, "key", "left").select("shingle", "key", "n", "at", F.coalesce("found", "key").alias("root"))


def _across(members: DataFrame, most: int = SLICE) -> DataFrame:
    """Members outside the largest class of their bucket, each with all members of other classes.

    Where those outside are many, each goes to one of several slices and the partners to all."""
    dealt = members.repartition("shingle")
    classes = dealt.groupBy("shingle", "root").agg(F.count("*").alias("size"))
    mixed = classes.groupBy("shingle").agg(
        F.max_by("root", F.struct("size", "root")).alias("largest"), (F.sum("size") - F.max("size")).alias("outside"), F.count("*").alias("classes")
    ).where("classes > 1").select("shingle", "largest", F.ceil(F.col("outside") / most).cast("int").alias("slices"))
    open_ = dealt.join(mixed, "shingle")
    outside = open_.where("root <> largest").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    partners = open_.select("shingle", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *[F.col(c).alias(f"hub_{c}") for c in MEMBER])
    return outside.join(partners, ["shingle", "slice"])


def _bounded(pairs: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs that may be similar enough by their sketches."""
    both = (
        pairs.join(nodes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        .join(nodes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            shared = map(most_common_members, batch.column(4).to_pylist(), batch.column(5).to_pylist())
            may = [c is None or sum(share) * c >= share[0] * (n + m) for (n, m), c in zip(sizes, shared)]
            yield batch.select([0, 1]).filter(pa.array(may, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(judge, "a bigint, b bigint")


def _sets(texts: DataFrame, asked: DataFrame, width: int, seed: int) -> DataFrame:
    """(mark, members) of the rows with these marks, and of few others: a bitmap of fixed size sorts most out."""
    place = F.pmod("mark", F.lit(FILTER_BITS))
    found = (
        asked.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).cast("int").alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).collect()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[[r["at"] for r in found]] = [r["bits"] for r in found]
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        # the JVM holds a batch outside its heap
        for batch in (whole.slice(at, SETS_TOGETHER) for whole in batches for at in range(0, whole.num_rows, SETS_TOGETHER)):
            places = batch.column(0).to_numpy() % FILTER_BITS
            wanted = pa.array((bits[places >> 6] >> (places & 63) & 1).astype(bool))
            sets = [shingle_set(t.as_py(), width, seed) for t in batch.column(1).filter(wanted).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(wanted), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["mark", "members"])

    return texts.select("mark", "text").mapInArrow(build, "mark bigint, members array<bigint>")


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, seed: int, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough. Each set goes from its text straight to the pairs that ask for it."""
    ends = pairs.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("key"), "a", "b")
    asked = materialize(ends.join(nodes.select("key", "mark"), "key").select("mark", "a", "b", (F.col("key") == F.col("a")).alias("is_a")), "jaccard-asked")
    # dealt by pair first: sets are sorted and put together where they meet, not before they travel
    sent = _sets(texts, asked, width, seed).join(asked, "mark").select("a", "b", "is_a", "members").repartition("a", "b")
    met = sent.groupBy("a", "b").agg(
        F.first(F.when(F.col("is_a"), F.col("members")), ignorenulls=True).alias("of_a"),
        F.first(F.when(~F.col("is_a"), F.col("members")), ignorenulls=True).alias("of_b"),
    )
    common = F.size(F.array_intersect("of_a", "of_b"))
    return met.where(share[1] * common >= share[0] * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _links_of(found: DataFrame, marks: DataFrame) -> DataFrame:
    """Links (a, b) between sets, of classes (id, component) of rows that are named by their marks."""
    of = marks.select("mark", "key").distinct()
    ends = found.join(of.select(F.col("mark").alias("id"), F.col("key").alias("a")), "id").select("a", "component").distinct()
    both = ends.join(of.select(F.col("mark").alias("component"), F.col("key").alias("b")), "component")
    return both.where("a <> b").select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = SHARE, seed: int = 42,
    also: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """One row (id, key, component) per input row; component is the smallest id of the class.

    ``also`` is another search: it gets rows with a text and the name of their id, and returns the class (id, component) of each."""
    texts = _texts(docs, id_col, text_col)
    marks = materialize(_marks(texts, width, seed), "jaccard-marks")
    nodes = materialize(
        marks.groupBy("key").agg(F.min("id").alias("first"), F.min("mark").alias("mark"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "jaccard-nodes"
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        may = materialize(_bounded(pairs, nodes, share), "jaccard-pairs")
        return materialize(_similar(may, nodes, texts, width, seed, share), "jaccard-links")

    placed = _prefixes(texts, width, seed, share).withColumn("root", F.col("key"))
    met = materialize(_with_hubs(placed, 0), "jaccard-buckets")
    members = met.select("shingle", "key", "n", "at")
    links = confirmed(_pairs(met, share))
    if also is not None:
        links = links.unionAll(materialize(_links_of(also(texts.select("mark", "text"), "mark"), marks), "jaccard-also"))
    met = _with_hubs(_rooted(members, components(links)), 1)
    links = links.unionAll(confirmed(_pairs(met, share)))
    met = _across(_rooted(members, components(links)))
    links = links.unionAll(confirmed(_pairs(met, share)))
    labels = components(links)
    rooted = nodes.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("key", "component")
    return marks.select("id", "key").join(classes, "key").select("id", "key", "component")
