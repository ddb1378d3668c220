"""Column functions over spans given as (start, end) second pairs. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def is_finite(value) -> Column:
    """True for a non-null number that is neither NaN nor infinite."""
    value = _c(value).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(INF))


def overlap(s1, e1, s2, e2) -> Column:
    """Shared seconds, never negative."""
    return F.greatest(F.lit(0.0), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def overlaps(s1, e1, s2, e2) -> Column:
    return (_c(s1) < _c(e2)) & (_c(s2) < _c(e1))


def iou(s1, e1, s2, e2) -> Column:
    """Shared seconds over the hull; 0 for an empty hull."""
    hull = F.greatest(_c(e1), _c(e2)) - F.least(_c(s1), _c(s2))
    return F.coalesce(F.try_divide(overlap(s1, e1, s2, e2), hull), F.lit(0.0))


def reference_coverage(s, e, target_start, target_end) -> Column:
    return F.coalesce(
        F.try_divide(overlap(s, e, target_start, target_end), _c(target_end) - _c(target_start)),
        F.lit(0.0),
    )


def event_iou(s, e, target_start, target_end, alternatives) -> Column:
    """Best IoU against a target and its alternative ranges (array of {start_sec,end_sec})."""
    best = F.array_max(
        F.transform(alternatives, lambda a: iou(s, e, a["start_sec"], a["end_sec"]))
    )
    return F.greatest(iou(s, e, target_start, target_end), F.coalesce(best, F.lit(0.0)))


def decisive_coverage(s, e, evidence) -> Column:
    """Share of decisive evidence seconds kept by a span; null when there is no such evidence."""
    spans = F.filter(evidence, lambda x: x.isNotNull() & (x["role"] == "decisive"))
    kept = F.aggregate(
        spans, F.lit(0.0), lambda acc, x: acc + overlap(s, e, x["start_sec"], x["end_sec"])
    )
    total = F.aggregate(spans, F.lit(0.0), lambda acc, x: acc + (x["end_sec"] - x["start_sec"]))
    return F.when(F.size(spans) > 0, F.try_divide(kept, total))


def event_coverage(s, e, target_start, target_end, alternatives, evidence) -> Column:
    return F.greatest(
        event_iou(s, e, target_start, target_end, alternatives),
        F.coalesce(decisive_coverage(s, e, evidence), F.lit(0.0)),
    )


def midpoint(s, e) -> Column:
    return (_c(s) + _c(e)) / 2


def owned_by(s, e, core_start, core_end) -> Column:
    """Half-open ownership by midpoint."""
    mid = midpoint(s, e)
    return (mid >= _c(core_start)) & (mid < _c(core_end))


def contains_all(s, e, spans) -> Column:
    """A non-empty array of spans that all lie inside [s, e] and have a positive length."""
    return (F.size(spans) > 0) & F.forall(
        spans,
        lambda x: (x["start_sec"] >= _c(s))
        & (x["start_sec"] < x["end_sec"])
        & (x["end_sec"] <= _c(e)),
    )


def clamp_start(s) -> Column:
    return F.greatest(F.lit(0.0), _c(s))


def clamp_end(e, duration) -> Column:
    return F.least(_c(duration), _c(e))


def shift(value, origin, digits: int = 6) -> Column:
    """Rebase a time to an origin, rounded."""
    return F.round(_c(value) - _c(origin), digits)


def open_overlap(stream_start, stream_duration, s, e) -> Column:
    """Overlap where a missing start is -inf and a missing duration is +inf."""
    begin = F.coalesce(_c(stream_start), F.lit(-INF))
    length = F.coalesce(_c(stream_duration), F.lit(INF))
    finish = F.when(begin == F.lit(-INF), F.lit(INF)).otherwise(begin + length)
    return (begin < _c(e)) & (finish > _c(s))


def valid_span(s, e, duration, core_start, core_end) -> Column:
    """Finite ordered bounds inside [0, duration] whose midpoint the detect range owns."""
    return F.coalesce(
        is_finite(s)
        & is_finite(e)
        & (_c(s) >= 0)
        & (_c(s) < _c(e))
        & (_c(e) <= _c(duration))
        & owned_by(s, e, core_start, core_end),
        F.lit(False),
    )


# Fixed value: reason prefix of a candidate that touches a read edge.
EDGE_PREFIX = "观看边缘的候选需要补充前后文："


def edge_demote(kind, reason, s, e, read_start, read_end, duration) -> tuple[Column, Column, Column]:
    """(kind, reason, violation) after demoting positives that touch an interior read edge."""
    s, e, read_start, read_end, duration = map(_c, (s, e, read_start, read_end, duration))
    outside = ~((s >= read_start) & (s < e) & (e <= read_end))
    touches = ((read_start > 0) & (s <= read_start)) | ((read_end < duration) & (e >= read_end))
    demote = (_c(kind) == "positive") & touches & ~outside
    return (
        F.when(demote, F.lit("uncertain")).otherwise(_c(kind)),
        F.when(demote, F.concat(F.lit(EDGE_PREFIX), _c(reason))).otherwise(_c(reason)),
        outside,
    )


MIN_CLIP_SEC = 0.5


def clip_edit_error(s, e, duration) -> Column:
    """Reason code of an invalid edited range; null when it is fine."""
    return F.when((_c(s) < 0) | (_c(e) > _c(duration)), F.lit("out_of_video")).when(
        _c(e) - _c(s) < MIN_CLIP_SEC, F.lit("too_short")
    )


def scope_flags(segments, duration, core_start, core_end) -> tuple[Column, Column]:
    """Counts of spans outside the view and of spans the detect range does not own."""
    bounds = F.size(
        F.filter(segments, lambda x: (x["start_sec"] < 0) | (x["end_sec"] > _c(duration)))
    )
    scope = F.size(
        F.filter(segments, lambda x: ~owned_by(x["start_sec"], x["end_sec"], core_start, core_end))
    )
    return bounds, scope


def hull(spans) -> tuple[Column, Column]:
    """Smallest start and largest end of an array of spans."""
    return (
        F.array_min(F.transform(spans, lambda x: x["start_sec"])),
        F.array_max(F.transform(spans, lambda x: x["end_sec"])),
    )
