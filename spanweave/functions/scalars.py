"""Text, vector, rate and identity functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import _c

Z95 = 1.959963984540054
REQUEST_OVERHEAD_BYTES = 100_000
MIN_OCR_CONFIDENCE = 0.55
OCR_HOLD_SEC = 1.5


def strip_space(text) -> Column:
    """Text without any whitespace."""
    return F.regexp_replace(_c(text), r"(?U)\s+", "")


def casefold(text) -> Column:
    """Unicode case folding, to tell equal texts: the lower case of the upper case, which takes apart what folds to several
    letters (sharp s to ss). Final sigma folds to sigma, and the dotless i, which has the upper case of another letter,
    passes as a code point that no text has. (Cherokee folds to lower case here, not to upper case, on both sides alike.)"""
    upper = F.upper(F.translate(_c(text), "\u0131", "\ufdd0"))
    # changes nothing, but the optimizer takes lower(upper(x)) for lower(x)
    folded = F.lower(F.translate(upper, "\ufdd0", "\ufdd0"))
    return F.translate(folded, "\u03c2\ufdd0", "\u03c3\u0131")


def folded_contains(text, needle) -> Column:
    """The text contains the needle, whatever their case."""
    return F.contains(casefold(text), casefold(needle))


def base64_bytes(n) -> Column:
    return (F.lit(4) * F.floor((_c(n) + 2) / 3)).cast("bigint")


def content_key(*cols) -> Column:
    """Identity of a record: SHA-256 over its values in column order, nulls kept apart."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def ratio(hits, total) -> Column:
    """hits / total, 0 when undefined."""
    return F.coalesce(F.try_divide(_c(hits).cast("double"), _c(total).cast("double")), F.lit(0.0))


def f1(hits, predictions, targets) -> Column:
    return ratio(_c(hits) * 2, _c(predictions) + _c(targets))


def wilson(hits, total) -> tuple[Column, Column]:
    """95 % interval of a share, null for an empty total, clamped to [0, 1]."""
    n = _c(total).cast("double")
    p = F.try_divide(_c(hits).cast("double"), n)
    shrink = 1 + F.try_divide(F.lit(Z95 * Z95), n)
    centre = (p + F.try_divide(F.lit(Z95 * Z95 / 2), n)) / shrink
    spread = F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(Z95 * Z95 / 4), n * n))
    radius = F.lit(Z95) * spread / shrink
    ok = n > 0
    return (
        F.when(ok, F.greatest(F.lit(0.0), centre - radius)),
        F.when(ok, F.least(F.lit(1.0), centre + radius)),
    )


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def usable_vector(a) -> Column:
    """Non-empty, finite and not all zero."""
    norm = l2_norm(a)
    return F.coalesce((F.size(_c(a)) > 0) & ~F.isnan(norm) & (norm > 0) & (norm < float("inf")), F.lit(False))


def l2_normalize(a) -> Column:
    norm = l2_norm(a)
    return F.when(usable_vector(a), F.transform(_c(a), lambda x: x.cast("double") / norm))


def distinct_join(texts, separator: str) -> Column:
    """Texts joined once each, first occurrence order."""
    return F.array_join(F.array_distinct(_c(texts)), separator)


def truncate(text, length: int) -> Column:
    return F.left(F.trim(_c(text)), F.lit(length))


def asr_confidence(avg_logprob) -> Column:
    return F.exp(_c(avg_logprob))


def ocr_frame(lines, min_confidence: float = MIN_OCR_CONFIDENCE) -> tuple[Column, Column]:
    """(joined text, mean confidence) of the trusted lines of one frame; null when none is left."""
    kept = F.filter(
        F.transform(lines, lambda x: F.struct(F.trim(x["text"]).alias("text"), x["score"].alias("score"))),
        lambda x: (F.length(x["text"]) > 0) & (x["score"] >= min_confidence),
    )
    text = F.array_join(F.transform(kept, lambda x: x["text"]), " ")
    mean = F.try_divide(
        F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x["score"]), F.size(kept).cast("double")
    )
    some = F.size(kept) > 0
    return F.when(some, text), F.when(some, mean)
