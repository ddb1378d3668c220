"""Open JSON progress counters reduced to the known, well-formed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import NUMERIC

# Counters that may be shown.
COUNTERS = (
    "completed_page_count",
    "page_count",
    "event_count",
    "candidate_count",
    "transcript_rows_read",
    "model_calls",
    "turn",
    "pending_event_count",
    "pending_observation_count",
    "pending_proposal_count",
    "pending_review_count",
)

# Capability flags that may be shown.
FLAGS = ("transcript", "semantic_search", "read_frames", "read_text", "local_proposals")


def _number(doc: Column, path: str) -> Column:
    """Finite non-negative number; booleans, texts and missing values are null."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    value = F.try_variant_get(doc, path, "double")
    ok = F.coalesce(F.regexp_like(kind, F.lit(NUMERIC)), F.lit(False)) & (value >= 0) & (value < float("inf"))
    return F.when(ok, value)


def _flag(doc: Column, path: str) -> Column:
    """A JSON boolean; numbers and texts are null."""
    strict = F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "BOOLEAN"
    return F.when(strict, F.try_variant_get(doc, path, "boolean"))


def clean_progress(df: DataFrame, text: str, modified: str | None = None) -> DataFrame:
    """Add the allow-listed counters, capability flags, duration, coverage, ready clip count and next scan
    range; with ``modified`` (a time without zone, in UTC) also ``updated_at`` as text."""
    doc = F.try_parse_json(text)
    cols = {c: F.when(_number(doc, f"$.{c}") == F.floor(_number(doc, f"$.{c}")), _number(doc, f"$.{c}").cast("bigint")) for c in COUNTERS}
    duration, coverage = _number(doc, "$.duration_sec"), _number(doc, "$.scan_coverage")
    ready = F.try_variant_get(doc, "$.ready_event_ids", "array<variant>")
    texts = F.filter(ready, lambda x: F.schema_of_variant(x) == "STRING")
    ids = F.array_distinct(F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")))
    start, end = _number(doc, "$.next_page.core_start_sec"), _number(doc, "$.next_page.core_end_sec")
    if modified is not None:
        df = df.withColumn("updated_at", F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return df.withColumns(
        {
            **cols,
            **{f"can_{c}": _flag(doc, f"$.capabilities.{c}") for c in FLAGS},
            "duration_sec": F.when(duration > 0, duration),
            "scan_coverage": F.when(coverage <= 1, coverage),
            "ready_clip_count": F.when(ready.isNotNull(), F.size(ids).cast("bigint")),
            "next_start_sec": F.when(start < end, start),
            "next_end_sec": F.when(start < end, end),
        }
    )
