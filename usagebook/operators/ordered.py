"""Ordered folds over the lines of logs, divided: running values, differences of cumulative counters, context carried along.

A log's lines are dealt to segments of SEGMENT line numbers, and windows run
inside a segment, so a log of any length is spread over many tasks. What a
segment tells those after it (the last or first value stated, a sum) is one
aggregated row, and a window over those rows (one for each SEGMENT lines) gives
each segment what came before it. Both steps are associative, so the result is
that of one window over the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagebook.functions.tables import written

COUNTERS = ("input_tokens", "cached_tokens", "output_tokens")
#: Line numbers of a segment.
SEGMENT = 1 << 16

#: What a delta takes into account: required counters, each optional one with the flag that says whether it was reported.
REQUIRED = ("input_tokens", "output_tokens", "total_tokens")
OPTIONAL = {"cached_tokens": "cached_reported", "reasoning_tokens": "reasoning_reported", "w5m": "writes_reported", "w1h": "writes_reported", "w_other": "writes_reported"}
SNAPSHOT = (*REQUIRED, *OPTIONAL)
FLAGS = ("cached_reported", "reasoning_reported", "writes_reported")
#: Counters whose growth is usage.
BILLED = ("input_tokens", "output_tokens", "cached_tokens", "w5m", "w1h", "w_other")


def running(log: DataFrame, ways: dict[str, tuple[str, Column]], source: str = "source_id", line: str = "line_number", size: int = SEGMENT, stored: bool = False) -> DataFrame:
    """Adds columns that sum up a log's lines so far.

    ways maps a name to (how, value): `last` or `first` value that isn't null up to
    the line, `before`, the last one of earlier lines only, or `sum` up to the line.
    The log is stored first, as its segments are summed up besides, unless it is already.
    """
    mark = "_segment"
    stated = {f"_v_{n}": v for n, (_, v) in ways.items()}
    kept = log.withColumns({mark: F.floor(F.col(line) / size).cast("long"), **stated})
    kept = kept if stored else written(kept, "log-segments")
    place = lambda c: F.when(F.col(c).isNotNull(), F.col(line))
    told = {"last": lambda c: F.max_by(c, place(c)), "before": lambda c: F.max_by(c, place(c)), "first": lambda c: F.min_by(c, place(c)), "sum": F.sum}
    parts = kept.groupBy(source, mark).agg(*[told[how](f"_v_{n}").alias(f"_p_{n}") for n, (how, _) in ways.items()])
    earlier = Window.partitionBy(source).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
    carry = {"last": lambda c: F.last(c, True), "before": lambda c: F.last(c, True), "first": lambda c: F.first(c, True), "sum": F.sum}
    carried_in = parts.select(source, mark, *[carry[how](f"_p_{n}").over(earlier).alias(f"_c_{n}") for n, (how, _) in ways.items()])
    inside = Window.partitionBy(source, mark).orderBy(line)
    so_far, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for n, (how, _) in ways.items():
        v, c = f"_v_{n}", F.col(f"_c_{n}")
        if how == "sum":
            out[n] = F.coalesce(F.sum(v).over(so_far), F.lit(0)) + F.coalesce(c, F.lit(0))
        elif how == "first":
            out[n] = F.coalesce(c, F.first(v, True).over(so_far))
        else:
            out[n] = F.coalesce(F.last(v, True).over(so_far if how == "last" else before), c)
    joined = kept.join(carried_in, [source, mark], "left").withColumns(out)
    return joined.select(*[c for c in log.columns if c not in out], *out)


def counter_deltas(log: DataFrame, counters: tuple[str, ...] = COUNTERS, source: str = "source_id", line: str = "line_number", size: int = SEGMENT) -> DataFrame:
    """Adds delta_<counter>, reset, epoch, billable and ordinal to a log of cumulative counters that are always reported.

    A counter that falls begins a new epoch, whose first delta is the value
    itself. A line whose deltas are all zero isn't billable, but is the next
    line's baseline.
    """
    log = running(log, {"_before": ("before", F.struct(*counters))}, source, line, size)
    before = {c: F.col("_before")[c] for c in counters}
    fell = F.exists(F.array(*[F.coalesce(F.col(c) < before[c], F.lit(False)) for c in counters]), lambda x: x)
    out = log.withColumn("reset", fell.cast("int"))
    out = out.withColumns({f"delta_{c}": F.when(F.col("reset") == 1, F.col(c)).otherwise(F.col(c) - F.coalesce(before[c], F.lit(0))) for c in counters})
    out = out.withColumn("billable", F.exists(F.array(*[f"delta_{c}" for c in counters]), lambda d: d > 0)).drop("_before")
    out = running(out, {"epoch": ("sum", F.col("reset").cast("long")), "ordinal": ("sum", F.col("billable").cast("long"))}, source, line, size)
    return out.withColumn("ordinal", F.when(F.col("billable"), F.col("ordinal")))


def carried(log: DataFrame, values: dict[str, str | None], source: str = "source_id", line: str = "line_number", size: int = SEGMENT) -> DataFrame:
    """Replaces each value column by the last one stated up to its line.

    values maps a column to a flag column that says where it is stated, so a
    stated null clears what was before; with None a value is stated where it
    isn't null.
    """
    stated = {c: F.when(F.col(flag).cast("boolean") if flag else F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))) for c, flag in values.items()}
    out = running(log, {f"_last_{c}": ("last", s) for c, s in stated.items()}, source, line, size)
    return out.withColumns({c: F.col(f"_last_{c}")["v"] for c in values}).select(log.columns)


def once_per_key(rows: DataFrame, keys: list[str], line: str = "line_number") -> DataFrame:
    """The least line of each key, aggregated before it moves."""
    return rows.groupBy(*keys).agg(F.min(line).alias(line))


def _fell(now: Column, before: Column) -> Column:
    """Whether a snapshot falls below the one before; cache writes only where both report them."""
    own = [now[c] < before[c] for c in (*REQUIRED, "cached_tokens", "reasoning_tokens")]
    writes = now["writes_reported"] & before["writes_reported"]
    own += [writes & (now[c] < before[c]) for c in ("w5m", "w1h", "w_other")]
    return F.coalesce(F.exists(F.array(*own), lambda x: x), F.lit(False))


def snapshot_deltas(log: DataFrame, now: str = "now", instant: str = "occurred_at", source: str = "source_id", line: str = "line_number", size: int = SEGMENT) -> DataFrame:
    """Differences of snapshots (a struct of SNAPSHOT and FLAGS, every counter a number) that know what was reported.

    Adds reset, delta (a struct of the counters' growth and of the flags, which say
    whether the growth is known), billable, event (billable at a usable time), epoch
    and event_index. A counter that isn't reported on both lines has no growth; it
    is neither a fall nor a gain. A snapshot that falls begins a new epoch and
    counts whole. Equal counters change nothing but what is reported. A billable
    line without a usable time is no baseline, so the next delta spans both. The log
    is a stored table, as it is read more than once.
    """
    valid = F.when(F.col(instant).isNotNull(), F.struct(F.col(line).alias("line"), F.col(now).alias("now")))
    base = "_base"
    if log.where(F.col(instant).isNull()).isEmpty():
        out = running(log, {base: ("before", F.col(now))}, source, line, size, stored=True).withColumn("_moves", F.lit(True))
    else:
        last = running(log, {"_last": ("before", valid)}, source, line, size, stored=True)
        moved = written(_moved(last.where(F.col(instant).isNull()), now, source, line), "log-moved")
        flagged = log.join(moved.withColumn("_moved", F.lit(True)), [source, line], "left")
        moves = F.col(instant).isNotNull() | F.coalesce(F.col("_moved"), F.lit(False))
        flagged = flagged.withColumn("_moves", moves).drop("_moved")
        out = running(flagged, {base: ("before", F.when(F.col("_moves"), F.col(now)))}, source, line, size)
    n, b = F.col(now), F.col(base)
    same = F.coalesce(F.forall(F.array(*[n[c] == b[c] for c in SNAPSHOT]), lambda x: x), F.lit(False))
    out = out.withColumn("reset", ~same & _fell(n, b))
    b = F.when(~F.col("reset"), F.col(base))
    grown = lambda c: n[c] - F.coalesce(b[c], F.lit(0))
    known = lambda f: n[f] & F.coalesce(b[f], F.lit(True))
    optional = {c: F.when(b.isNull(), n[c]).when(known(f), grown(c)).otherwise(0) for c, f in OPTIONAL.items()}
    delta = F.struct(*[grown(c).alias(c) for c in REQUIRED], *[v.alias(c) for c, v in optional.items()], *[known(f).alias(f) for f in FLAGS])
    out = out.withColumn("delta", delta)
    billable = ~same & F.exists(F.array(*[F.col("delta")[c] for c in BILLED]), lambda d: d != 0)
    out = out.withColumn("billable", billable).withColumn("event", F.col("billable") & F.col(instant).isNotNull())
    counted = {"epoch": ("sum", (F.col("reset") & F.col("_moves")).cast("long")), "event_index": ("sum", F.col("event").cast("long"))}
    return running(out.drop(base), counted, source, line, size).drop("_moves")


def advance(before: dict | None, now: dict) -> tuple[bool, bool, dict]:
    """One step of the same fold by itself: whether counters fall, whether the growth is billable, the growth with its flags."""
    if before is not None and all(now[c] == before[c] for c in SNAPSHOT):
        return False, False, {c: 0 for c in SNAPSHOT} | {f: now[f] and before[f] for f in FLAGS}
    writes = before is not None and now["writes_reported"] and before["writes_reported"]
    watched = (*REQUIRED, "cached_tokens", "reasoning_tokens", *(("w5m", "w1h", "w_other") if writes else ()))
    fell = before is not None and any(now[c] < before[c] for c in watched)
    if before is None or fell:
        delta = {k: now[k] for k in (*SNAPSHOT, *FLAGS)}
    else:
        delta = {c: now[c] - before[c] for c in REQUIRED} | {f: now[f] and before[f] for f in FLAGS}
        delta |= {c: now[c] - before[c] if delta[f] else 0 for c, f in OPTIONAL.items()}
    return fell, any(delta[c] for c in BILLED), delta


def _moved(rows: DataFrame, now: str, source: str, line: str) -> DataFrame:
    """Of snapshots without a usable time those that are baselines all the same, because nothing in them is billable.

    Whether one is depends on those before it, so they are taken one after the
    other, from the last snapshot with a time on; only such lines are moved here,
    and none is held.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = since = before = None
        for batch in batches:
            out = {source: [], line: []}
            for r in batch.to_pylist():
                last = r["last"] or {"line": -1, "now": None}
                if (r[source], last["line"]) != (log, since):
                    log, since, before = r[source], last["line"], last["now"]
                if not advance(before, r["now"])[1]:
                    before = r["now"]
                    out[source].append(log)
                    out[line].append(r[line])
            yield pa.RecordBatch.from_pydict(out, pa.schema([(source, pa.string()), (line, pa.int64())]))

    chosen = rows.select(F.col(source), F.col(line).cast("long").alias(line), F.col(now).alias("now"), F.col("_last").alias("last"))
    return chosen.repartition(source).sortWithinPartitions(source, line).mapInArrow(follow, f"{source} string, {line} long")


__all__ = ["SEGMENT", "advance", "carried", "counter_deltas", "once_per_key", "running", "snapshot_deltas"]
