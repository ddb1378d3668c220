"""Byte-pair encoding by backtracking, decoding through an offset table.

The merges give the same ids as always taking the earliest merge first, but no merge is ever replayed on a text. A row of
tokens is the encoding of its text exactly if each two neighbours are: if undoing the latest merges on both sides of
their border never meets a pair that would have been merged across it (``Tables.fits``). The encoder takes
the longest token at each place, all of which one pass of an Aho-Corasick automaton over the words finds; where it does not fit its
left neighbour, the next shorter token that begins there is tried, and where none fits the place is marked as a dead end
and the neighbour is shortened. Every place is left for dead once at most, so the time is linear in the length.

The tables are made from the tokenizer's own merge list on the driver (their size is the model's) and sent to the
executors. A Python worker keeps them with the words and pairs it has met, up to ``CACHE`` entries each, and uses them in all its
tasks. Texts are cut at ASCII white space, which no token crosses; normalisation and the cutting of chunks into words
are the tokenizer's.

Decoding joins token strings by spaces, as this tokenizer has no decoder: the strings lie end to end in one array, and an offset table
says where each id's begin. No shuffle anywhere.

Defined results: a null or empty text has no ids, and no ids decode to an empty text; rows are encoded one by one, so repeated rows and rows
without id give a row each; ties do not occur; an empty table gives an empty table; other columns are kept as they are. The added columns must not
be among them: their names are parameters.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.token_archive import LETTERS, SIGNS, lowered

NEVER = 1 << 40
CACHE = 400_000
TEXTS_TOGETHER = 512
#: ids whose strings are gathered at once
IDS_TOGETHER = 1 << 17
#: stands for the end of a word; no byte is written as a line feed in the vocabulary
END = "\n"


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else the next free one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(seen)))}
    return [hidden.get(b, chr(b)) for b in range(256)]


class Tables:
    """What a merge list says about tokens: how they part, which shorter token begins them, which pairs stand."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text("utf-8"))
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["decoder"] is not None or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("a byte-pair model without decoder and with plain added tokens is needed")
        self.spec_text, self.suffix = json.dumps({**spec, "truncation": None, "padding": None}), model["end_of_word_suffix"] or ""
        self.special = {a["content"]: a["id"] for a in added}
        vocab = {self._inner(name): i for name, i in model["vocab"].items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.fit: dict[int, bool] = {}
        live = {i for name, i in vocab.items() if len(name.removesuffix(END)) == 1}
        for rank, merge in enumerate(model["merges"]):
            # an inner part keeps its suffix only at the end of the word
            a, b = (self._inner(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if max(self.rank[x], self.rank[y]) >= rank or (self.pair_rank.setdefault((x, y), rank) != rank):
                raise ValueError("merges have to come after those that make their parts")
            if made not in live and x in live and y in live and self.fits(x, y, rank):
                self.rank[made], self.left[made], self.right[made] = rank, x, y
                live.add(made)
        names = {name: i for name, i in vocab.items() if i in live}
        self.length = [0] * size
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for name, i in names.items():
            self.automaton.add_word(name, i)
            self.length[i] = len(name)
            self.shorter[i] = next((names[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in names), -1)
        self.automaton.make_automaton()
        self.lengths = np.array(self.length)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        strings = [b""] * size
        for name, i in chain(model["vocab"].items(), self.special.items()):
            strings[i] = b" " + name.encode()
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])

    def _inner(self, name: str) -> str:
        return name.removesuffix(self.suffix) + END if self.suffix and name.endswith(self.suffix) else name

    def fits(self, a: int, b: int, limit: int = NEVER) -> bool:
        """No merge earlier than ``limit`` crosses the border of two neighbours."""
        until_a = until_b = limit  # the merges that take up the present edges
        while True:
            crossing = self.pair_rank.get((a, b), NEVER)
            if crossing < until_a and crossing <= until_b:
                return False
            if self.rank[a] > self.rank[b]:
                until_a, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                until_b, b = self.rank[b], self.left[b]
            else:
                return True

    def _walk(self, longest: list[int], at: int, end: int) -> list[int]:
        length, shorter, fit = self.length, self.shorter, self.fit
        out: list[int] = []
        dead: set[int] = set()
        token, last = longest[at], -1
        while at < end:
            while token >= 0:
                stop = at + length[token]
                if stop not in dead:
                    if last < 0:
                        break
                    good = fit.get(last << 20 | token)
                    if good is None:
                        good = fit[last << 20 | token] = self.fits(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = stop, token
                token = longest[at] if at < end else -1
            else:  # nothing fits here: give the last token up for a shorter one
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of words written in the letters of the vocabulary."""
        if len(self.fit) > CACHE:
            self.fit = {}
        text = END.join(words) + END
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        longest = np.full(len(text) + 1, -1)
        longest[found[:, 0] - self.lengths[found[:, 1]] + 1] = found[:, 1]  # matches come by their end, so the longest is last
        first, out, at = longest.tolist(), [], 0
        for word in words:
            end = at + len(word) + 1
            out.append(self._walk(first, at, end))
            at = end
        return out


class Encoder:
    """Ids of texts, chunk by chunk; lives as long as its Python worker and keeps what it has met."""

    def __init__(self, tables: Tables) -> None:
        self.tables = tables
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.library = None

    def __getstate__(self) -> dict:
        return {"tables": self.tables, "chunks": {}, "words": {"": b""}, "library": None}

    def _tokenizer(self):
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.tables.spec_text)
            self.letters = {i: c for i, c in enumerate(byte_letters())}
            names = sorted(self.tables.special, key=len, reverse=True)
            self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        return self.library

    def _cut(self, chunk: str) -> Iterator[str | int]:
        """Words of a chunk in the letters of the vocabulary, and ids of added tokens."""
        for part in self.marks.split(chunk) if self.marks else [chunk]:
            if part in self.tables.special:
                yield self.tables.special[part]
            elif part:
                plain = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
                    yield word

    def learn(self, chunks: Iterable[bytes]) -> None:
        self._tokenizer()
        cuts: list[tuple[bytes, list[str | int]]] = []
        for chunk in chunks:
            letters = chunk.rstrip(SIGNS)
            if letters.isalpha() or LETTERS.fullmatch(letters):
                # a run of letters and a run of signs
                word = letters.decode().lower()
                own = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                cuts.append((chunk, [own, chunk[len(letters) :].decode()]))
            else:
                cuts.append((chunk, list(self._cut(chunk.decode()))))
        if len(self.words) > CACHE:
            self.words = {"": b""}
        new = list({w for _, cut in cuts for w in cut if isinstance(w, str) and w not in self.words})
        if new:
            self.words.update((w, np.array(ids, self.tables.kind).tobytes()) for w, ids in zip(new, self.tables.encode_words(new)))
        single = lambda i: np.array([i], self.tables.kind).tobytes()
        self.chunks.update((c, b"".join(single(w) if isinstance(w, int) else self.words[w] for w in cut)) for c, cut in cuts)

    def encode(self, texts: Sequence[bytes | None]) -> list[np.ndarray]:
        cut = [lowered(t or b"").split() for t in texts]
        new = set().union(*cut).difference(self.chunks)
        if len(self.chunks) + len(new) > CACHE:
            self.chunks = {}
            new = set().union(*cut)
        self.learn(new)
        known = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(known, chunks)), self.tables.kind) for chunks in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        parts, offsets = [], self.tables.offsets
        for at in range(0, len(ids), IDS_TOGETHER):
            own = ids[at : at + IDS_TOGETHER].astype(np.int64)
            sizes = offsets[own + 1] - offsets[own]
            ends = np.cumsum(sizes)
            parts.append(self.tables.blob[np.arange(ends[-1]) + np.repeat(offsets[own] - ends + sizes, sizes)].tobytes())
        return b"".join(parts)[1:]


def load(path: str) -> Encoder:
    return Encoder(Tables(path))


def _lists(streams: Sequence[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, streams)]).astype(np.int32)
    flat = np.concatenate(streams).astype(np.int32) if streams else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(
    docs: DataFrame, encoder: Encoder, text_col: str = "text", keep: Sequence[str] | None = None, ids_col: str = "__ids", decoded_col: str | None = None,
) -> DataFrame:
    """The kept columns (all by default) with the ids of each text; ``decoded_col`` adds what they decode to."""
    kept = list(docs.columns if keep is None else keep)
    added = [c for c in (ids_col, decoded_col) if c]
    if clash := set(kept) & set(added):
        raise ValueError(f"columns {sorted(clash)} exist, choose other names")
    shared = docs.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_TOGETHER):
                rows = batch.slice(at, TEXTS_TOGETHER)
                streams = encoder.encode(rows.column(len(kept)).cast(pa.large_binary()).to_pylist())
                new: list[pa.Array] = [_lists(streams)]
                if decoded_col:
                    new.append(pa.array([encoder.decode(s) for s in streams], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *new], [f"c{i}" for i in range(len(kept) + len(new))])

    # plain names inside, so that no name of the input matters
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [T.StructField(f"c{i}", inner.schema[f"c{i}"].dataType) for i in range(len(kept))]
    fields += [T.StructField(f"c{len(kept) + i}", t) for i, t in enumerate([T.ArrayType(T.IntegerType()), T.StringType()][: len(added)])]
    out = inner.mapInArrow(run, T.StructType(fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate([*kept, *added])])


def decode(rows: DataFrame, encoder: Encoder, ids_col: str = "__ids", id_cols: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The id columns with the text that each list of ids decodes to (null: empty)."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder)
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            texts = [encoder.decode(np.array(ids or [], np.int64)) for ids in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.binary()).cast(pa.string())], [f"c{i}" for i in range(n + 1)])

    inner = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(id_cols)], F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    fields = [T.StructField(f"c{i}", inner.schema[f"c{i}"].dataType) for i in range(n)] + [T.StructField(f"c{n}", T.StringType())]
    return inner.mapInArrow(run, T.StructType(fields)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate([*id_cols, text_col])])
