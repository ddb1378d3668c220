"""Streams over run metrics and traces."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.telemetry import PREFIXES, is_allowed

MERGED = T.StructType(
    [T.StructField("run", T.LongType()), T.StructField("step", T.LongType()), T.StructField("key", T.StringType()), T.StructField("value", T.DoubleType())]
)
STAGNANT = T.StructType([T.StructField(n, T.LongType()) for n in ("run", "step", "new_facts", "stagnant_steps")])


SLOTS = 1 << 10  # steps are dealt to so many values of the state


class MetricMerge(StatefulProcessor):
    """State per slot of steps, in one value as each call of the state store is a round trip. For each step of the slot: the newest
    training place, per key its place and value, and the digest of the whole step as it was last sent. A place is a file and a position
    in it, later files come later.

    Rows of a batch may arrive in any order; places decide. A step is emitted, whole, only when its digest differs, so keys that a
    newer attempt no longer has disappear, and files that are read again emit nothing.

    A key is a slot, whose rows name their run and step (see :func:`merge_metrics_stream`), or the run and step of all its rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # pickled {(run, step): (since, {name: (place, value)}, digest)}: a slot has thousands of values, and as columns each would be converted apart
        self.step = handle.getValueState("slot", "steps binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.step.get()
        steps = pickle.loads(stored[0]) if stored else {}
        lacks = int(key[0]) // SLOTS if len(key) == 1 else 0
        changed: dict[tuple[int, int], list] = {}
        for batch in rows:
            named = [batch[n].tolist() if n in batch else repeat(int(key[i])) for i, n in enumerate(("run", "step"))]
            places = zip(batch["file"].tolist(), batch["pos"].astype(int).tolist())
            for run, step, place, training, name, value in zip(*named, places, *(batch[n].tolist() for n in ("training", "key", "value"))):
                ident = (run, step)
                since, newest, digest = now = changed.get(ident) or steps.get(ident) or (None, {}, None)
                if since is not None and place < since:
                    continue
                later, before = training and not lacks and since != place, newest.get(name)
                if later or before is None or before[0] <= place and before != (place, float(value)):
                    if ident not in changed:
                        changed[ident] = now = [since, dict(newest), digest]
                    if later:
                        now[0] = place
                    if before is None or before[0] <= place:
                        now[1][name] = (place, float(value))
        told = []
        for (run, step), (since, newest, digest) in changed.items():
            alive = {name: x for name, x in newest.items() if since is None or x[0] >= since}
            listed = sorted(((name, value) for name, (_, value) in alive.items()), key=lambda x: (x[0] is not None, x[0] or ""))
            now = hashlib.sha256(repr(listed).encode("utf-8", "surrogatepass")).digest()
            steps[run, step] = (since, alive, now)
            if now != digest:
                told += [(None if lacks & 1 else run, None if lacks & 2 else step, *x) for x in listed]
        if changed:
            self.step.update((pickle.dumps(steps, pickle.HIGHEST_PROTOCOL),))
        if told:
            yield pd.DataFrame(told, columns=MERGED.names)

    def close(self) -> None:
        pass


def merge_metrics_stream(log: DataFrame) -> DataFrame:
    """Whole changed steps in update mode: merge and emit-when-changed; read with ``newest_groups`` by (run, step).

    ``log``: run, pos, step, training, key, value and, if places are told apart by file, file. As in
    :func:`~spanweave.operators.telemetry.merge_metrics`, steps without a run or number replace nothing.
    State is keyed by slots of the hashed (run, step), so one long run spreads over many tasks; a task holds one slot."""
    lacks = F.col("run").isNull().cast("int") + 2 * F.col("step").isNull().cast("int")
    rows = log.select(
        (F.pmod(F.xxhash64("run", "step"), F.lit(SLOTS)) + SLOTS * lacks).alias("slot"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("run", "step")],
        (F.col("file") if "file" in log.columns else F.lit("")).alias("file"), "pos", F.coalesce("training", F.lit(False)).alias("training"), "key", "value",
    )
    return rows.groupBy("slot").transformWithStateInPandas(MetricMerge(), outputStructType=MERGED, outputMode="Update", timeMode="None")


def allowed_metrics_stream(log: DataFrame, names: Sequence[str], prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """As :func:`merge_metrics_stream`, of finite allow-listed values only; whatever the order in which files come, the values of
    later ones win. ``log``: run, file, pos, step, key, value."""
    return merge_metrics_stream(log.filter(is_allowed(names, prefixes)).withColumn("training", F.lit(False)))


class _Remembered:
    """Texts of one key with a number each, in slices by their hash that double with the texts: few texts take one call of the
    state store to read and one to write, and of many only the slices are read that are asked for."""

    SIZE = 256
    SCHEMA = ("slice long", "texts array<string>, numbers array<double>")

    def __init__(self, state, slices: int, count: int) -> None:
        self.state, self.slices, self.count = state, slices, count

    def _of(self, texts, slices: int) -> dict[int, list[str]]:
        dealt: dict[int, list[str]] = {}
        for text in texts:
            dealt.setdefault(crc32(text.encode("utf-8", "surrogatepass")) % slices, []).append(text)
        return dealt

    def read(self, texts=None) -> dict[str, float]:
        """What is remembered in the slices of these texts, or in all."""
        asked = range(self.slices) if texts is None else self._of(texts, self.slices)
        return {t: n for i in asked for t, n in zip(*(self.state.getValue((i,)) or ((), ())))}

    def write(self, known: dict[str, float], more: dict[str, float], gone: Iterable[str] = ()) -> None:
        """Add ``more`` to what ``read`` gave as ``known``, for the texts of both, and forget those of ``gone``."""
        gone = set(gone)
        self.count += len(more) - len(gone)
        slices = self.slices
        while self.count > self.SIZE * slices:
            slices *= 2
        touched = self._of([*more, *gone], self.slices)
        if slices > self.slices:
            known, touched = self.read(), None
            for i in range(self.slices):
                self.state.removeKey((i,))
        kept = {t: n for t, n in (known | more).items() if t not in gone}
        for i, texts in self._of(kept, slices).items():
            if touched is None or i in touched:
                self.state.updateValue((i,), (texts, [float(kept[t]) for t in texts]))
        for i in set(touched or ()) - set(self._of(kept, slices)):
            self.state.removeKey((i,))
        self.slices = slices


class Stagnation(StatefulProcessor):
    """Per run: facts seen so far, facts of the steps that are open, and the stagnant counter.

    A step is open until the watermark passes its end; then it is closed, the steps of a run in order, whatever the order in which their
    rows came. A run has one timer at a time that counts, for its earliest open step, and closes all that are due."""

    def __init__(self, step_sec: float) -> None:
        self.step_sec = step_sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", *_Remembered.SCHEMA)
        self.open = handle.getMapState("open", *_Remembered.SCHEMA)  # texts of a step and a fact
        self.counter = handle.getValueState("counter", "stagnant long, steps array<long>, slices array<long>, facts array<long>")

    def _end(self, step: int) -> int:
        return int((step + 1) * self.step_sec * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, set[str]] = {}
        for batch in rows:
            for step, fact, known in zip(batch["step"].astype(int), batch["fact"], batch["fact"].notna()):
                facts = found.setdefault(step, set())
                if known:
                    facts.add(fact)
        stagnant, steps, slices, facts = self.counter.get() or (0, [], [1, 1], [0, 0])
        open_ = _Remembered(self.open, slices[1], facts[1])
        told = {f"{step} {fact}": step for step, new in found.items() for fact in new}
        known = open_.read(told)
        more = {text: step for text, step in told.items() if text not in known}
        if more:
            open_.write(known, more)
        now = sorted({*steps, *found})
        if more or now != list(steps):
            if not steps or now[0] < steps[0]:
                self.handle.registerTimer(self._end(now[0]))
            self.counter.update((stagnant, now, [slices[0], open_.slices], [facts[0], open_.count]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stagnant, steps, slices, facts = self.counter.get()
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        closed, left = [s for s in steps if self._end(s) <= due], [s for s in steps if self._end(s) > due]
        if not closed:  # closed with an earlier one
            return
        open_, seen = (_Remembered(state, n, m) for state, n, m in zip((self.open, self.seen), reversed(slices), reversed(facts)))
        waiting = open_.read()
        gone = [text for text, step in waiting.items() if self._end(step) <= due]
        told: dict[int, list[str]] = {}
        for text in gone:
            told.setdefault(int(waiting[text]), []).append(text.split(" ", 1)[1])
        known = seen.read({f for new in told.values() for f in new})
        more: dict[str, float] = {}
        out = []
        for step in closed:
            fresh = [f for f in told.get(step, ()) if f not in known and f not in more]
            more |= dict.fromkeys(fresh, step)
            stagnant = 0 if fresh else stagnant + 1
            out.append((int(key[0]), step, len(fresh), stagnant))
        if gone:
            open_.write(waiting, {}, gone)
        if more:
            seen.write(known, more)
        if left:
            self.handle.registerTimer(self._end(left[0]))
        self.counter.update((stagnant, left, [seen.slices, open_.slices], [seen.count, open_.count]))
        yield pd.DataFrame(out, columns=STAGNANT.names)

    def close(self) -> None:
        pass


def stagnation_stream(facts: DataFrame, step_sec: float, delay: str) -> DataFrame:
    """Stagnation per (run, step), each step once, when the watermark (the latest ``ts`` less ``delay``) has passed its end.

    ``facts``: run, ts, fact (null for a sign of life without a fact). Step n lasts from n * step_sec to (n + 1) * step_sec
    seconds since 1970; rows of steps already closed are dropped."""
    step = F.floor(F.unix_millis("ts") / 1000 / step_sec).alias("step")
    timed = facts.withWatermark("ts", delay).select("run", "ts", step, "fact")
    return timed.groupBy("run").transformWithStateInPandas(
        Stagnation(step_sec), outputStructType=STAGNANT, outputMode="Update", timeMode="EventTime"
    )


COUNTS = ("request_errors", "invalid_tool_requests", "missing_tool_calls", "requests")
TRACED = T.StructType([
    T.StructField("job", T.LongType()), T.StructField("part", T.LongType()), T.StructField("hour", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in COUNTS], T.StructField("request_sec", T.DoubleType()),
    T.StructField("repeated", T.LongType()), T.StructField("late", T.LongType()),
])
REQUEST_KINDS = ("model", "clip_review", "perception_model")


HOURS_TOGETHER = 256  # hours of one value of the state


class TraceCounts(StatefulProcessor):
    """Counts per hour of one part of a job, over distinct rows that are not late.

    The watermark of a part is the latest time of the batches before, less the delay. Rows behind it are counted as late and not
    otherwise; row ids are remembered as long as a copy that is not late can come, hours as long as they can change."""

    def __init__(self, delay_sec: float) -> None:
        self.delay_sec = delay_sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "t double, slices long, ids long")
        self.ids = handle.getMapState("ids", *_Remembered.SCHEMA)
        self.hours = handle.getMapState("hours", "block long", "hours array<long>, counts array<array<long>>, request_sec array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, slices, n = self.latest.get() or (float("-inf"), 1, 0)
        behind = latest - self.delay_sec
        ids = _Remembered(self.ids, slices, n)
        known, more = ids.read(), {}
        blocks: dict[int, dict[int, list]] = {}
        changed: dict[int, list] = {}
        for batch in rows:
            for ident, t, kind, error, empty, seconds in zip(*(batch[c] for c in ("id", "t", "kind", "error", "calls_empty", "elapsed_sec"))):
                hour = int(t // 3600)
                if hour not in changed:
                    block = hour // HOURS_TOGETHER
                    if block not in blocks:
                        stored = self.hours.getValue((block,)) or ((), (), ())
                        blocks[block] = {h: [*c[:4], sec, *c[4:]] for h, c, sec in zip(*stored)}
                    changed[hour] = blocks[block].setdefault(hour, [0, 0, 0, 0, 0.0, 0, 0])
                found = changed[hour]
                if t < behind:
                    found[6] += 1
                elif ident in known or ident in more:
                    found[5] += 1
                else:
                    more[ident] = float(t)
                    timed = kind in REQUEST_KINDS and seconds is not None and seconds == seconds
                    found[0] += kind == "request_error"
                    found[1] += kind == "tool" and bool(error)
                    found[2] += kind == "model" and bool(empty)
                    found[3] += timed
                    found[4] += float(seconds) if timed else 0.0
                latest = max(latest, float(t))
        old = [ident for ident, t in known.items() if t < latest - self.delay_sec]
        more = {ident: t for ident, t in more.items() if t >= latest - self.delay_sec}
        if more or old:
            ids.write(known, more, old)
        self.latest.update((latest, ids.slices, ids.count))
        for block, found in blocks.items():
            counts = [[int(x) for x in (*c[:4], *c[5:])] for c in found.values()]
            self.hours.updateValue((block,), (list(found), counts, [float(c[4]) for c in found.values()]))
        yield pd.DataFrame([(int(key[0]), int(key[1]), hour, *found) for hour, found in changed.items()], columns=TRACED.names)

    def close(self) -> None:
        pass


def trace_counts_stream(trace: DataFrame, delay_sec: float = 3600.0, part: Column | None = None) -> DataFrame:
    """Running counts per (job, part, hour) in update mode, without repeated rows and with late ones apart; read with
    ``newest_groups`` and add up the parts and hours of a job.

    ``trace``: job, id, ts, kind, elapsed_sec, calls_empty, error. The rows of a job are dealt by ``part`` (a whole number made from the
    id; by default one of 16 by its hash), each with its own watermark, so that copies meet and a busy job spreads over tasks."""
    dealt = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(16)) if part is None else part
    timed = trace.select(
        "job", dealt.cast("bigint").alias("part"), F.col("id").cast("string").alias("id"), (F.unix_millis("ts") / 1000).alias("t"), "kind",
        F.coalesce("error", F.lit(False)).alias("error"), F.coalesce("calls_empty", F.lit(False)).alias("calls_empty"),
        F.col("elapsed_sec").cast("double").alias("elapsed_sec"),
    )
    return timed.groupBy("job", "part").transformWithStateInPandas(
        TraceCounts(delay_sec), outputStructType=TRACED, outputMode="Update", timeMode="None"
    )
