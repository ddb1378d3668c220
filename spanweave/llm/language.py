"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams (1 to
3 bytes, ASCII lower case, all other ASCII as space) tells the languages with a one from those with a zero: the
log-odds of the two groups' n-gram shares. All training texts are counted, per language, in one
map-side combined aggregate whose result has a fixed size per language.

Decoding is loss-weighted: the margins of the bits are compared with each codeword under the logistic
loss, a bit counting by how often it is right on a bounded sample of training texts (``sample`` rows of lowest
hash), and the codeword of least loss wins. The score is the share of its language in the soft-max of
the losses, at the temperature that suits the sample best; a text is ambiguous if the two best
codewords are closer than ``gap`` in score.

Codewords: with up to 5 languages every way to split them into two groups (all the bits there are), else
as many bits as 8 for each binary digit of the number of languages, drawn so that the codewords lie far apart.

Defined results: texts that are null or have no letter get ``und`` and score 0; repeated rows are judged alike; rows without
language are not learned from; with one language all texts with a letter get it, with none all get ``und``; an empty
table gives an empty table; other columns are kept as asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS, TRIPLES = 1 << 13, 1 << 14
FEATURES = 256 + PAIRS + TRIPLES
UNDETERMINED = "und"
SAMPLE_ROWS = 4000
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SLICE_BYTES = 1 << 20


def has_letter(raw: bytes | None) -> bool:
    if not raw:
        return False
    return any(chr(c).isalpha() for c in set(raw) if c < 128) or any(c.isalpha() for c in set(raw.decode("utf-8", "replace")) if ord(c) > 127)


def grams(raw: bytes) -> np.ndarray:
    """Feature numbers of all n-grams of a text; runs of non-letters are one space."""
    text = b" " + b" ".join(raw.translate(LETTERS).split()) + b" "
    one = np.frombuffer(text, np.uint8).astype(np.uint32)
    two = one[:-1] * np.uint32(256) + one[1:]
    three = two[:-1] * np.uint32(256) + one[2:]
    mixed_two, mixed_three = two * np.uint32(2654435761), three * np.uint32(2654435761)
    return np.concatenate([
        one, 256 + (mixed_two >> np.uint32(32 - 13)), 256 + PAIRS + (mixed_three >> np.uint32(32 - 14)),
    ]).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one per language."""
    if n <= 5:
        return np.array([[1 if (bit | 1) >> row & 1 else -1 for bit in range(1, (1 << n) - 1, 2)] for row in range(n)] or [[]], np.float64)
    bits = 8 * max(1, int(n - 1).bit_length())
    draw = np.random.default_rng(3)
    best, apart = None, -1.0
    for _ in range(50):
        code = draw.choice([-1.0, 1.0], (n, bits))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        distance = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if distance.min() > apart:
            best, apart = code, float(distance.min())
    return best


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    worth: np.ndarray  # of each bit
    temperature: float

    def margins(self, raw: bytes) -> np.ndarray:
        """Mean log-odds of the n-grams, per bit."""
        total, count = np.zeros(self.code.shape[1]), 0
        for at in range(0, len(raw), SLICE_BYTES):
            own = grams(raw[at : at + SLICE_BYTES])
            total += self.weights[own].sum(axis=0, dtype=np.float64)
            count += len(own)
        return total / max(count, 1) * 3

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of every codeword for rows of margins, in units of the texts' own spread."""
        return np.logaddexp(0, -margins[:, None, :] * 4 * self.code) @ self.worth

    def shares(self, margins: np.ndarray) -> np.ndarray:
        z = -self.losses(margins) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            raw = raw.as_py()
            for at in range(0, len(raw), SLICE_BYTES):
                own = counts.setdefault(lang, np.zeros(FEATURES, np.int64))
                own += np.bincount(grams(raw[at : at + SLICE_BYTES]), minlength=FEATURES)
    for lang, own in counts.items():
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(own[seen])], ["lang", "feature", "n"]
        )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows that are not held out and have a language."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = (
        rows.select("lang", "text").mapInArrow(_count, "lang string, feature bigint, n bigint")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    )
    languages = sorted(set(found.column("lang").to_pylist()))
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    shares = np.zeros((len(languages), FEATURES))
    row = np.searchsorted(languages, found.column("lang").to_pylist())
    shares[row, found.column("feature").to_numpy()] = found.column("n").to_numpy()
    shares = (shares + 0.5) / (shares + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    bits = code.shape[1]
    groups = [(shares[code[:, b] > 0].mean(axis=0), shares[code[:, b] < 0].mean(axis=0)) for b in range(bits)]
    weights = np.stack([np.log(p / q) for p, q in groups], axis=1) if bits else np.zeros((FEATURES, 0))
    model = Model(languages, code, weights.astype(np.float32), np.ones(bits), 1.0)
    return _calibrated(model, rows, sample) if bits else model


def _calibrated(model: Model, rows: DataFrame, sample: int) -> Model:
    """Worth of the bits and temperature from at most ``sample`` training rows."""
    # ids of the sample: a fixed bound of rows
    picked = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1).cast(pa.large_binary())]
            margins = [shared.value.margins(t).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(margins, pa.list_(pa.float64()))], ["id", "lang", "margins"])

    kind = rows.schema["id"].dataType.simpleString()
    measured = rows.join(F.broadcast(picked), "id").select("id", "text", "lang").mapInArrow(measure, f"id {kind}, lang string, margins array<double>")
    # one row for each id of the sample, however often it occurs
    found = measured.groupBy("id").agg(F.max(F.struct("lang", "margins")).alias("row")).select("row.lang", "row.margins").toArrow()
    if not found.num_rows:
        return model
    margins = np.array(found.column("margins").to_pylist())
    truth = np.searchsorted(model.languages, found.column("lang").to_pylist())
    right = (np.sign(margins) == model.code[truth]).mean(axis=0)
    model = model._replace(worth=np.maximum(2 * right - 1, 0.05))
    losses = model.losses(margins)

    def miss(temperature: float) -> float:
        z = -losses / temperature
        return float(np.mean(np.logaddexp.reduce(z, axis=1) - z[np.arange(len(z)), truth]))

    return model._replace(temperature=float(min(np.geomspace(0.02, 5, 60), key=miss)))


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, gap: float = 0.2
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all without it) and ``__lang``: (name, score, ambiguous)."""
    docs = docs.drop("__lang")
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("name", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def judge(raw: bytes | None) -> tuple[str, float, bool]:
        own = shared.value
        if not own.languages or not has_letter(raw):
            return UNDETERMINED, 0.0, True
        shares = own.shares(own.margins(raw)[None])[0] if own.code.shape[1] else np.ones(1)
        order = np.argsort(-shares, kind="stable")
        second = shares[order[1]] if len(order) > 1 else 0.0
        return own.languages[order[0]], float(shares[order[0]]), bool(shares[order[0]] - second < gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dict(zip(("name", "score", "ambiguous"), judge(t.as_py()))) for t in batch.column(text_col).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(found, kind)], [*keep, "__lang"])

    moved = docs.select(*[F.col(f"`{n}`") for n in [*keep, *([] if text_col in keep else [text_col])]])
    schema = ", ".join([*(f"`{n}` {moved.schema[n].dataType.simpleString()}" for n in keep), "__lang struct<name: string, score: double, ambiguous: boolean>"])
    return moved.mapInArrow(run, schema)
