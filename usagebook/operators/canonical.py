"""Canonical events: one row for all sightings of a billable event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagebook.functions.ids import stable_id
from usagebook.functions.values import COUNTERS, COVERAGE, rank

#: What an event takes from its best copy.
IDENTITY = ("session_id", "provider", "raw_model", "auth_mode", "auth_mode_provenance", "service_tier", "inference_geo", "cache_write_data_complete", "input_subset_accounting_consistent")


def preference(df: DataFrame) -> Column:
    """Copies in order of trust: coverage, quality, input, output; then a fixed order of the rest."""
    return F.struct(rank(F.col("coverage"), COVERAGE).alias("c"), "quality_rank", "input_tokens_total", "output_tokens_total", "source_id", "line_number", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"x{k}") for k, c in enumerate(IDENTITY)])


def greatest_counters() -> list[Column]:
    """Aggregates of copies' counters: each one's greatest, and writes, the greatest of what a copy or all together say of cache writes. They may be taken in any grouping."""
    w5, w1 = (F.max(f"cache_write_{k}_tokens") for k in ("5m", "1h"))
    together = F.max(F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens") + F.col("cache_write_unknown_tokens"))
    return [*[F.max(c).alias(c) for c in COUNTERS], F.greatest(together, w5 + w1).alias("writes")]


def merged_counters() -> list[Column]:
    """An event's counters from those aggregates. Client A's total is the sum of its parts; of the other the uncached input is what its total leaves."""
    first = F.col("client") == "claude_code"
    total, cached, writes = F.col("input_tokens_total"), F.col("input_tokens_cached"), F.col("writes")
    own = {
        "input_tokens_total": F.when(first, F.col("input_tokens_uncached") + cached + writes).otherwise(total),
        "input_tokens_uncached": F.when(first, F.col("input_tokens_uncached")).otherwise(F.greatest(total - cached - writes, F.lit(0))),
        "cache_write_unknown_tokens": writes - F.col("cache_write_5m_tokens") - F.col("cache_write_1h_tokens"),
    }
    return [own.get(c, F.col(c)).alias(c) for c in COUNTERS]


def _warnings(observations: DataFrame) -> Column:
    """All warnings of an event's copies, and their notes where a source has them; of each kind a set, which the few codes bound."""
    found = F.collect_set("warning")
    if "notes" in observations.columns:
        found = F.array_union(found, F.flatten(F.collect_set(F.coalesce("notes", F.array().cast("array<string>")))))
    return F.array_sort(found)


def fold(observations: DataFrame) -> DataFrame:
    """Events by (client, event_key): earliest time, each counter's maximum, identity of the best copy, all warnings.

    Cache writes by duration are compared with their total, since one copy may
    report only the total and another the durations. Copies move once, as they are:
    an event has few, and partial aggregates of one row each, moved once by source
    and once by event, are several times as wide.
    """
    observations = observations.repartition("client", "event_key")
    best = F.max_by(F.struct(*IDENTITY), preference(observations))
    folded = observations.groupBy("client", "event_key").agg(
        F.min("occurred_at").alias("occurred_at"),
        *greatest_counters(),
        F.max("quality_rank").alias("quality_rank"),
        F.max(rank(F.col("coverage"), COVERAGE)).alias("coverage_rank"),
        F.count_distinct("source_id").cast("long").alias("source_count"),
        F.count("*").alias("copies"),
        _warnings(observations).alias("warnings"),
        best.alias("best"),
    )
    return folded.select(
        stable_id(F.col("client"), F.col("event_key")).alias("event_id"),
        "client", "event_key", "occurred_at",
        *merged_counters(), "quality_rank",
        F.element_at(F.array(*[F.lit(c) for c in COVERAGE]), F.col("coverage_rank") + 1).alias("coverage"),
        "source_count", "copies", "warnings", *[F.col(f"best.{c}").alias(c) for c in IDENTITY],
    )


def ranked_copies(observations: DataFrame) -> DataFrame:
    """Every copy with its place in its event, 1 for the best."""
    order = preference(observations)
    return observations.withColumn("place", F.row_number().over(Window.partitionBy("client", "event_key").orderBy(order.desc())))


def provenance(observations: DataFrame, event_id: str | None = None) -> DataFrame:
    """For each event, or one, its sightings, duplicates and sources."""
    rows = observations.withColumn("event_id", stable_id(F.col("client"), F.col("event_key")))
    if event_id is not None:
        rows = rows.where(F.col("event_id") == event_id)
    return rows.groupBy("client", "event_key", "event_id").agg(F.count("*").alias("observations"), (F.count("*") - 1).alias("duplicates"), F.count_distinct("source_id").alias("sources"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))


def in_window(events: DataFrame, start: object = None, end: object = None) -> DataFrame:
    """Events of [start, end). The filter stands after the fold, since an event's time is the least of its copies'."""
    if start is not None:
        events = events.where(F.col("occurred_at") >= F.lit(start))
    return events if end is None else events.where(F.col("occurred_at") < F.lit(end))
