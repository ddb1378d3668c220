"""Strict and lenient readers of model answers stored as JSON text.

``from_json`` alone hides type errors (it turns ``true`` and ``"3"`` into null, and one odd
element voids the array), so the answer is read as VARIANT and every bound is type-tested.
Bare ``NaN``/``Infinity`` tokens are legal in the producer's JSON; they become null first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import _c

NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"


def answer_variant(text) -> Column:
    """VARIANT of an answer; null when it is no JSON document."""
    bare = F.regexp_replace(
        _c(text), r'(?<=[:\[,\s])-?(?:NaN|Infinity)(?=\s*[,}\]])', "null"
    )
    return F.try_parse_json(bare)


def _number(element: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(element, path, "variant"))
    value = F.try_variant_get(element, path, "double")
    return F.when(
        F.coalesce(F.regexp_like(kind, F.lit(NUMERIC)), F.lit(False)) & (F.abs(value) != float("inf")),
        value,
    )


def answer_segments(answer: Column) -> Column:
    """array<variant> under ``segments``; null when it is missing or not a list."""
    return F.try_variant_get(answer, "$.segments", "array<variant>")


def span_elements(segments: Column) -> Column:
    """array<struct<start_sec,end_sec>>; a bound that is no finite number is null."""
    return F.transform(
        segments,
        lambda x: F.struct(
            _number(x, "$.start_sec").alias("start_sec"), _number(x, "$.end_sec").alias("end_sec")
        ),
    )


def _usable(x: Column) -> Column:
    return F.coalesce(x["start_sec"] < x["end_sec"], F.lit(False))


def parse_answers(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans`` (every element, nulls for bad bounds) and ``format_valid``."""
    return (
        df.withColumn("_segments", answer_segments(answer_variant(text)))
        .withColumn("spans", span_elements(F.col("_segments")))
        .withColumn("format_valid", F.col("_segments").isNotNull())
        .drop("_segments")
    )


def parse_strict(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``segments`` and ``parse_error``: one bad span voids the whole answer."""
    return (
        parse_answers(df, text)
        .withColumn("parse_error", ~(F.col("format_valid") & F.coalesce(F.forall("spans", _usable), F.lit(False))))
        .withColumn(
            "segments",
            F.when(F.col("parse_error"), F.array().cast("array<struct<start_sec:double,end_sec:double>>"))
            .otherwise(F.col("spans")),
        )
        .drop("spans", "format_valid")
    )


def parse_lenient(df: DataFrame, duration: str, core_start: str, core_end: str, text: str = "text") -> DataFrame:
    """Add ``segments`` (valid spans only), ``predicted_count``, ``invalid_segments``, ``format_valid``."""
    from .intervals import valid_span

    empty = F.array().cast("array<struct<start_sec:double,end_sec:double>>")
    spans = F.coalesce(F.col("spans"), empty)
    good = F.filter(
        spans,
        lambda x: valid_span(x["start_sec"], x["end_sec"], duration, core_start, core_end),
    )
    return (
        parse_answers(df, text)
        .withColumn("segments", good)
        .withColumn("predicted_count", F.size(spans).cast("bigint"))
        .withColumn("invalid_segments", (F.size(spans) - F.size(good)).cast("bigint"))
        .drop("spans")
    )
