"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into words (a run of spaces and what follows it; no piece crosses such a cut). The
distinct words of a batch are a relation: their substrings of bounded length are exploded, joined on
equality with the piece table (by hash, then confirmed character by character), grouped by word, and
each word's lattice is folded into its pieces; texts look their words up. Spark deals out the
texts; nothing is shuffled, and the piece table, of the size of the model, is sent to every task.

The fold: pieces of a BPE model (the kind of the public model) are found by its merges, best score
first, leftmost on ties. The path of highest summed score, which decodes a unigram model, is
not its encoding; :func:`viterbi_words` has that fold for unigram tables, as joins and a higher-order
aggregate. Characters without a piece become byte pieces.

Decoding joins the ids with the piece table, puts bytes and characters together, turns the space mark into spaces and drops
the first one.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows are encoded alike; a text
that holds the space mark itself decodes to a space in its place; an empty table gives an empty table; other
columns are kept as asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
KNOWN_WORDS = 120_000
SLICE_WORDS = 8192


class Pieces(NamedTuple):
    """The piece table, sorted by hash."""

    hashes: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    chars: np.ndarray  # code points, zero-padded
    sizes: np.ndarray
    maybe: np.ndarray  # which leading hash bits occur
    longest: int
    byte_ids: np.ndarray  # id of each byte piece, -1 without
    unknown: int
    surface: list[bytes]  # bytes of each id
    word: re.Pattern[str]  # cuts a text into words


def _hash_columns(chars: np.ndarray) -> np.ndarray:
    value = np.zeros(len(chars), np.uint64)
    for column in chars.T:
        value = np.where(column > 0, value * FACTOR + column.astype(np.uint64), value)
    return value


def load_pieces(model_path: str) -> Pieces:
    """Read the piece table of a model; run on the driver, once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    texts, surface = [], []
    byte_ids = np.full(256, -1, np.int64)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            surface.append(b"")
        else:
            texts.append((piece, i, model.get_score(i)))
            surface.append(piece.replace(MARK, " ").encode())
    return make_pieces(texts, byte_ids, model.unk_id(), surface)


def make_pieces(texts: list[tuple[str, int, float]], byte_ids: np.ndarray, unknown: int, surface: list[bytes]) -> Pieces:
    if any(MARK in p.lstrip(MARK) for p, _, _ in texts):
        raise ValueError("a piece crosses the cut in front of a space")
    # control characters that no longer piece holds are words of their own
    alone = "".join(c for c in "\n\r\t" if not any(c in p for p, _, _ in texts if len(p) > 1))
    word = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
    longest = max(len(p) for p, _, _ in texts)
    chars = np.zeros((len(texts), longest), np.uint32)
    for row, (piece, _, _) in enumerate(texts):
        chars[row, : len(piece)] = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
    hashes = _hash_columns(chars)
    order = np.argsort(hashes, kind="stable")
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two pieces share a hash")
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Pieces(
        hashes[order], np.array([i for _, i, _ in texts])[order], np.array([s for _, _, s in texts], np.float64)[order], chars[order],
        np.array([len(p) for p, _, _ in texts])[order], maybe, longest, byte_ids, unknown, surface, word,
    )


def lattice(chars: np.ndarray, ends: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Id and score of the piece of each (length - 1, start), -1 and -inf without one.

    ``chars`` are the code points of all words in a row, ``ends`` the end of the word at each place."""
    n = len(chars)
    ids, scores = np.full((pieces.longest, n), -1, np.int64), np.full((pieces.longest, n), -np.inf)
    starts, value = np.arange(n), np.zeros(n, np.uint64)
    for size in range(1, pieces.longest + 1):
        fits = starts + size <= ends[starts]
        starts, value = starts[fits], value[fits]
        if not len(starts):
            break
        value = value * FACTOR + chars[starts + size - 1]
        some = np.flatnonzero(pieces.maybe[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        places = np.minimum(np.searchsorted(pieces.hashes, value[some]), len(pieces.hashes) - 1)
        same = (pieces.hashes[places] == value[some]) & (pieces.sizes[places] == size)
        some, places = some[same], places[same]
        at = starts[some]
        equal = np.ones(len(at), bool)
        for k in range(size):
            equal &= chars[at + k] == pieces.chars[places, k]
        ids[size - 1, at[equal]] = pieces.ids[places[equal]]
        scores[size - 1, at[equal]] = pieces.scores[places[equal]]
    return ids, scores


def fold_merges(words: np.ndarray, scores: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the symbols that remain when the best pair of each word is merged, round by
    round, until no pair of neighbours is a piece. ``words``: the word of each place, ascending."""
    starts, sizes, owner = np.arange(len(words)), np.ones(len(words), np.int64), words
    done_starts, done_sizes = [], []
    while len(starts):
        joined = sizes[:-1] + sizes[1:]
        able = (owner[:-1] == owner[1:]) & (joined <= longest)
        value = np.full(len(starts), -np.inf)
        pairs = np.flatnonzero(able)
        value[pairs] = scores[joined[pairs] - 1, starts[pairs]]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.maximum.reduceat(value, first)
        lengths = np.diff(np.r_[first, len(owner)])
        reached = (value == np.repeat(best, lengths)) & (value > -np.inf)
        merged = np.flatnonzero(reached)
        merged = merged[np.r_[True, owner[merged][1:] != owner[merged][:-1]]] if len(merged) else merged
        active = np.repeat(best > -np.inf, lengths)
        done_starts.append(starts[~active])
        done_sizes.append(sizes[~active])
        sizes = sizes.copy()
        sizes[merged] += sizes[merged + 1]
        active[merged + 1] = False
        starts, sizes, owner = starts[active], sizes[active], owner[active]
    begins, spans = np.concatenate(done_starts or [starts]), np.concatenate(done_sizes or [sizes])
    order = np.argsort(begins)
    return begins[order], spans[order]


def encode_words(words: list[str], pieces: Pieces) -> list[bytes]:
    """Ids of each word, packed as little-endian 32-bit integers."""
    whole = "".join(words)
    chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    ids, scores = lattice(chars, np.repeat(np.cumsum(sizes), sizes), pieces)
    starts, spans = fold_merges(owner, scores, pieces.longest)
    found = ids[spans - 1, starts]
    counts, flat = np.ones(len(found), np.int64), found
    missing = np.flatnonzero(found < 0)
    if len(missing):
        spelled = []
        for at in starts[missing].tolist():
            own = [int(pieces.byte_ids[b]) for b in whole[at].encode("utf-8", "replace")]
            spelled.append(own if min(own) >= 0 else [pieces.unknown])
        counts[missing] = [len(x) for x in spelled]
        flat = np.repeat(found, counts)
        flat[flat < 0] = np.concatenate(spelled)
    ends = np.cumsum(np.bincount(owner[starts], counts, len(words)).astype(np.int64)) * 4
    packed = flat.astype("<i4").tobytes()
    return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """Encodes texts, remembering the words of a task (emptied at ``KNOWN_WORDS``)."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > KNOWN_WORDS:
            self.known = {}
            missing = list(words)
        for at in range(0, len(missing), SLICE_WORDS):
            part = missing[at : at + SLICE_WORDS]
            self.known.update(zip(part, encode_words(part, self.pieces)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of several texts; their new words are encoded together."""
        cut = [self.pieces.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self.known}
        if new:
            self.learn(new if len(self.known) + len(new) <= KNOWN_WORDS else {w for words in cut for w in words})
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4") for words in cut]


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    text = b"".join(map(pieces.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode(
    docs: DataFrame, pieces: Pieces, text_col: str = "text", keep: list[str] | None = None, group: int = 256, verify: bool = False
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all without it) and ``__ids``; with ``verify`` also ``__whole``,
    whether the ids decode to the text (spaces for space marks)."""
    docs = docs.drop("__ids", "__whole")
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                texts = part.column(text_col).to_pylist()
                found = encoder.encode(texts)
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if verify:
                    made.append(pa.array([decode_ids(x, shared.value) == (t or "").replace(MARK, " ") for x, t in zip(found, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *made], [*keep, *added])

    added = ["__ids", "__whole"] if verify else ["__ids"]
    moved = docs.select(*[F.col(f"`{n}`") for n in [*keep, *([] if text_col in keep else [text_col])]])
    schema = ", ".join([*(f"`{n}` {moved.schema[n].dataType.simpleString()}" for n in keep), "__ids array<int>", *(["__whole boolean"] if verify else [])])
    return moved.mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "__ids") -> DataFrame:
    """``encoded`` with ``__text``, the text of its ids."""
    encoded = encoded.drop("__text")
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(np.asarray(x.values if x.is_valid else [], np.int64), shared.value) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "__text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), "__text string"])
    return encoded.mapInArrow(run, schema)


def viterbi_words(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(word, ids, score): the path of highest summed score of each word over a unigram piece table
    (piece, id, score); null where no path covers the word. Of equal paths the one whose last pieces are longest wins.

    Substrings up to ``longest`` characters are exploded and joined with the pieces; the edges of a word, by
    end and start, are folded into the best (score, ids) of each place."""
    own = words.select("word").where(F.length("word") > 0).distinct()
    cut = own.select("word", F.explode(F.expr("sequence(1, length(word))")).alias("start")).select(
        "word", "start", F.explode(F.expr(f"sequence(1, least({longest}, length(word) - start + 1))")).alias("size")
    )
    edges = cut.withColumn("piece", F.expr("substring(word, start, size)")).join(table, "piece")
    grouped = edges.groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct((F.col("start") + F.col("size") - 1).alias("end"), F.col("start").alias("start"), "id", "score"))).alias("edges")
    )
    best = F.expr(
        "aggregate(edges, array(struct(0 AS at, 0D AS score, cast(array() AS array<int>) AS ids)), (best, e) -> "
        "aggregate(filter(best, b -> b.at = e.start - 1), best, (kept, b) -> "
        "if(exists(kept, k -> k.at = e.end AND k.score >= b.score + e.score), kept, "
        "concat(filter(kept, k -> k.at != e.end), array(struct(e.end AS at, b.score + e.score AS score, concat(b.ids, array(cast(e.id AS int))) AS ids))))))"
    )
    ended = grouped.withColumn("best", best)
    found = ended.select("word", F.expr("get(filter(best, b -> b.at = length(word)), 0)").alias("whole"))
    return own.join(found, "word", "left").select("word", F.col("whole.ids").alias("ids"), F.col("whole.score").alias("score"))
