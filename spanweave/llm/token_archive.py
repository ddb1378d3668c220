"""Token archives with directly addressable codes.

A segment stores the ids of consecutive documents. Each id is split into 8-bit chunks, lowest first.
Level k holds the k-th chunk of every id that has one, a bitmap that marks which of them go on to
level k + 1, and a rank directory: the number of marked entries before every 512th one. Entry i of a
level continues at entry rank(i) of the next, so any token is read in as many steps as it
has chunks, without decoding a block.

Segments are rows of a Parquet table in the shared folder, in ascending id order: part (range
partition), seq (segment within it), documents (their ids and lengths), tokens and levels. The
position of a document in the whole stream is the tokens of earlier parts (one total per part), plus
those of earlier segments of its part, plus its place in the segment.

Encoding: the tokenizers library never lets a token cross white space, so a text is the concatenation
of its space-separated chunks; each distinct chunk is encoded once as long as a Python worker knows it. A worker
keeps its table of up to ``CACHE_CHUNKS`` chunks over all its tasks, those in use before others.

Defined results: a null text is empty; an empty text is the end id alone; repeated rows are encoded
each, ties in id ordered by a hash of the text, then by the text; rows without id come first; an empty table gives an empty archive;
other columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.session import shared_folder

CHUNK_BITS = 8
RANK_EVERY = 512
SEGMENT_TOKENS = 1 << 19
CACHE_CHUNKS = 400_000
TEXTS_TOGETHER = 512
WORDS_TOGETHER = 256
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
# Latin letters of one or two bytes (but for the dotted capital I, which lower case takes apart)
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")
LEVEL = pa.struct([("chunks", pa.binary()), ("marks", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("tokens", pa.int64()), ("levels", pa.list_(LEVEL)),
])
SEGMENT_SQL = (
    "part int, seq int, ids array<bigint>, lengths array<int>, tokens bigint, "
    "levels array<struct<chunks: binary, marks: binary, ranks: binary>>"
)


def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of a stream of unsigned ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS != 0
        starts = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY)))]) if len(more) else [0]
        levels.append({
            "chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "marks": np.packbits(more, bitorder="little").tobytes(),
            "ranks": np.asarray(starts, "<u4").tobytes(),
        })
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK_BITS


def token_at(levels: list[dict[str, bytes]], at: int) -> int:
    """One id by its position: a chunk per level, and one directory entry with at most 512 bits to count."""
    value = shift = 0
    for level in levels:
        value |= level["chunks"][at] << shift
        if not level["marks"][at >> 3] >> (at & 7) & 1:
            return value
        block = at // RANK_EVERY
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        inside = int.from_bytes(level["marks"][block * RANK_EVERY // 8 : at // 8 + 1], "little")
        at = rank + (inside & ((1 << at - block * RANK_EVERY) - 1)).bit_count()
        shift += CHUNK_BITS
    raise ValueError("an id goes on after the last level")


def unpack(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    ids, at = None, None
    for k, level in enumerate(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        if ids is None:
            ids, at = chunks, np.arange(len(chunks))
        else:
            ids[at] |= chunks << np.uint32(CHUNK_BITS * k)
        at = at[np.unpackbits(np.frombuffer(level["marks"], np.uint8), bitorder="little", count=len(at)).astype(bool)]
    return ids


class Known:
    """A table that keeps what is in use: when the new half is full it becomes the old one, and what is asked for again moves up."""

    def __init__(self, most: int = CACHE_CHUNKS) -> None:
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.half = most // 2

    def missing(self, asked: set[bytes]) -> set[bytes]:
        """What the table does not have; the rest is in ``now`` afterwards, with room for the missing."""
        new = asked.difference(self.now)
        if len(self.now) + len(new) > self.half:
            self.now, self.old, new = {}, self.now, asked
        again = new & self.old.keys()
        self.now.update(zip(again, map(self.old.__getitem__, again)))
        return new - again


class ChunkEncoder:
    """Ids of texts as little-endian 16 or 32-bit integers, chunk by chunk.

    A chunk that is a run of Latin letters and a run of ASCII signs is two words to the tokenizer. Such
    words are encoded many at a time, parted by spaces, and told apart by their word-end tokens."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.tokenizer = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "tokenizer": None}

    def open(self) -> None:
        """Load the tokenizer, once in a Python worker."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known, self.words = Known(), Known()
        self.words.now[b""] = b""

    def _single(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return ((c, np.array(e.ids, self.kind).tobytes()) for c, e in zip(chunks, found))

    def _learn_words(self, words: list[bytes]) -> None:
        groups = [words[at : at + WORDS_TOGETHER] for at in range(0, len(words), WORDS_TOGETHER)]
        found = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        width = self.kind.itemsize
        for group, encoding in zip(groups, found):
            ids = np.array(encoding.ids, self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(ends) == len(group) and ends[-1] == len(ids) * width:
                packed = ids.tobytes()
                self.words.now.update((w, packed[i:j]) for w, i, j in zip(group, [0, *ends], ends))
            else:
                self.words.now.update(self._single(group))

    def learn(self, missing: set[bytes]) -> None:
        plain, rest, parts = [], [], {b""}
        for chunk in missing:
            letters = chunk.rstrip(SIGNS)
            if letters.isalpha() or LETTERS.fullmatch(letters):
                signs = chunk[len(letters) :]
                plain.append((chunk, letters, signs))
                parts.add(letters)
                parts.add(signs)
            else:
                rest.append(chunk)
        new = self.words.missing(parts)
        new.discard(b"")
        self.words.now[b""] = b""
        self._learn_words(list(new))
        words = self.words.now
        self.known.now.update([(chunk, words[letters] + words[signs]) for chunk, letters, signs in plain])
        self.known.now.update(self._single(rest))

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if self.tokenizer is None:
            self.open()
        cut = [lowered(t or b"").split() for t in texts]
        self.learn(self.known.missing(set().union(*cut)))
        known = self.known.now.__getitem__
        return [np.frombuffer(b"".join(map(known, chunks)), self.kind) for chunks in cut]


def lowered(raw: bytes) -> bytes:
    """The text in ASCII lower case, as the tokenizer lower-cases anyway; left alone where that could
    change how marks combine with letters, or make a special token."""
    return raw if b"\xcc" in raw or b"<|" in raw else raw.lower()


def _write(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        count = 0

        def segment() -> pa.RecordBatch:
            stream = np.concatenate(held)
            row = {"part": part, "seq": seq, "ids": ids, "lengths": lengths, "tokens": len(stream), "levels": pack(stream)}
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_TOGETHER):
                rows = batch.slice(at, TEXTS_TOGETHER)
                streams = encoder.encode(rows.column(1).cast(pa.large_binary()).to_pylist())
                for key, stream in zip(rows.column(0).to_pylist(), streams):
                    held += [stream, end]
                    ids.append(key)
                    lengths.append(len(stream) + 1)
                    count += len(stream) + 1
                    if count >= SEGMENT_TOKENS:
                        yield segment()
                        ids, lengths, held, count, seq = [], [], [], 0, seq + 1
        if ids:
            yield segment()

    return run


def write_archive(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, parts: int | None = None,
) -> str:
    """Encode every text and write the archive in ascending id order; returns its folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/spanweave/tokens-{uuid.uuid4().hex}"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows of one id may lie in several parts, and so may copies of one row
    rows = rows.withColumn("mark", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "id", "mark", F.rand(7)).sortWithinPartitions("id", "mark", "text").select("id", "text")
    shared = spark.sparkContext.broadcast(ChunkEncoder(tokenizer_path))
    ordered.mapInArrow(_write(shared, end_id), SEGMENT_SQL).write.parquet(folder)
    return folder


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seq", "id", "inner", "length", "crc"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            stream = unpack(row["levels"]).astype("<u4")
            ends = np.cumsum(np.asarray(row["lengths"], np.int64))
            starts = ends - np.asarray(row["lengths"], np.int64)
            sums = [zlib.crc32(stream[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(sums)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["ids"], pa.int64()),
                pa.array(starts), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64()),
            ], names)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, length, crc) of every document, decoded from the archive; crc is the CRC-32 of its
    ids as little-endian unsigned 32-bit integers."""
    segments = spark.read.schema(SEGMENT_SQL).parquet(folder)
    sizes = segments.select("part", "seq", "tokens")
    # one total per range partition: as many rows as the archive has parts
    totals = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    bases = totals.select(
        "part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base")
    )
    inside = sizes.select(
        "part", "seq", (F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")).alias("offset")
    )
    placed = inside.join(bases, "part").select("part", "seq", (F.col("base") + F.col("offset")).alias("before"))
    decoded = segments.select("part", "seq", "ids", "lengths", "levels").select(
        F.struct("part", "seq", "ids", "lengths", "levels").alias("s")
    ).select("s.*").mapInArrow(_read, "part int, seq int, id bigint, inner bigint, length bigint, crc bigint")
    return decoded.join(placed, ["part", "seq"]).select("id", (F.col("before") + F.col("inner")).alias("start"), "length", "crc")
