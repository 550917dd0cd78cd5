"""Reconciliation of local events with provider exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagebook.functions.tables import written
from usagebook.functions.values import complete_sum, local_date, provider_name, small

COUNTED = ("request_count", "input_tokens_uncached", "input_tokens_cached", "cache_write_5m_tokens", "cache_write_1h_tokens", "cache_write_unknown_tokens", "output_tokens")
ROUTING = ("inference_geo", "service_tier", "provider_route")
CLASSES = ("matched", "provider_only", "local_only", "time_boundary", "route_unknown", "counter_mismatch")
#: What reconciliation reads of an event; provider_route may be absent.
EVENT = ("client", "event_key", "occurred_at", "provider", "raw_model", "input_tokens_uncached", "input_tokens_cached", "cache_write_5m_tokens", "cache_write_1h_tokens", "cache_write_unknown_tokens", "output_tokens_total", "cache_write_data_complete", *ROUTING)
TOLERANCE = "interval 1 hour"
#: The longest bucket.
MAX_DAYS = 366


def bucket_keys() -> list[str]:
    return ["source_kind", "bucket_start", "bucket_end", "provider", "model", *ROUTING]


def full_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets with all columns, null where the export has none."""
    kinds = dict.fromkeys(COUNTED, "bigint") | dict.fromkeys(ROUTING, "string") | {"provider_metered_usd": "decimal(18,6)"}
    return buckets.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in buckets.columns})


def normalised_buckets(buckets: DataFrame) -> DataFrame:
    """One row a key: a counter that one part lacks is unknown, whereas amounts that are stated add up."""
    return full_buckets(buckets).groupBy(*bucket_keys()).agg(*[complete_sum(F.col(c)).alias(c) for c in COUNTED], F.sum("provider_metered_usd").alias("provider_metered_usd"), F.count("*").alias("parts"))


def bucket_issues(buckets: DataFrame) -> DataFrame:
    """Buckets that can't be compared: (code, source_kind, bucket_start)."""
    b = full_buckets(buckets)
    rules = {
        "empty_interval": F.col("bucket_end") <= F.col("bucket_start"),
        "too_long": F.datediff("bucket_end", "bucket_start") > MAX_DAYS,
        "no_content": F.coalesce(*COUNTED).isNull() & F.col("provider_metered_usd").isNull(),
        "unknown_provider": ~F.coalesce(provider_name(F.col("provider")).isin("anthropic", "openai"), F.lit(False)),
        "negative_counter": F.least(*COUNTED) < 0,
    }
    return b.select(F.explode(F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()]))).alias("code"), "source_kind", "bucket_start")


def latest_imports(buckets: DataFrame) -> DataFrame:
    """Buckets of each source kind's latest import."""
    newest = buckets.groupBy("source_kind").agg(F.max("import_id").alias("import_id"))
    return buckets.join(small(newest), ["source_kind", "import_id"], "left_semi")


def contained(buckets: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Buckets that lie wholly in [start, end)."""
    if start is not None:
        buckets = buckets.where(F.col("bucket_start") >= F.lit(start).cast("timestamp"))
    return buckets if end is None else buckets.where(F.col("bucket_end") <= F.lit(end).cast("timestamp"))


def local_sums() -> list[Column]:
    """The local side: cache writes stay unknown unless they are above zero or known to be complete."""
    complete = F.coalesce("cache_write_data_complete", F.lit(False))
    writes = [F.sum(F.when((F.col(c) > 0) | complete, F.col(c))).alias(c) for c in ("cache_write_5m_tokens", "cache_write_1h_tokens", "cache_write_unknown_tokens")]
    routing = [F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in ROUTING]
    return [F.count("*").alias("request_count"), F.sum("input_tokens_uncached").alias("input_tokens_uncached"), F.sum("input_tokens_cached").alias("input_tokens_cached"), *writes, F.sum("output_tokens_total").alias("output_tokens"), *routing]


def with_route(events: DataFrame) -> DataFrame:
    return events if "provider_route" in events.columns else events.withColumn("provider_route", F.lit(None).cast("string"))


def day_span(start: Column, end: Column) -> Column:
    """The days that [start, end] touches, by which events and buckets meet in an equi-join."""
    return F.explode(F.sequence(F.to_date(start), F.to_date(end)))


def matches(events: DataFrame, buckets: DataFrame, boundary: bool = False) -> DataFrame:
    """(bucket_id, event columns) of events inside their buckets, or, for boundary, at most an hour outside.

    Buckets are spread over the days that they touch, so the join is by provider
    and day with the bounds as a condition, and neither side must be small. An
    event meets a bucket once, since it has one day.
    """
    start, end = F.col("bucket_start"), F.col("bucket_end")
    if boundary:
        start, end = start - F.expr(TOLERANCE), end + F.expr(TOLERANCE)
    spread = buckets.select("bucket_id", F.col("provider").alias("_provider"), F.lower("model").alias("_model"), F.col("bucket_start").alias("_start"), F.col("bucket_end").alias("_end"), day_span(start, end).alias("_day"))
    e = with_route(events).withColumns({"_by": provider_name(F.col("provider"), F.col("client")), "_on": F.to_date("occurred_at")})
    at = F.col("occurred_at")
    inside = (at >= F.col("_start")) & (at < F.col("_end"))
    if boundary:
        inside = ~inside & (at >= F.col("_start") - F.expr(TOLERANCE)) & (at <= F.col("_end") + F.expr(TOLERANCE))
    found = e.join(small(spread), (F.col("_by") == F.col("_provider")) & (F.col("_on") == F.col("_day")) & (F.col("_model").isNull() | (F.col("_model") == F.lower("raw_model"))) & inside)
    return found.drop("_by", "_on", "_provider", "_model", "_start", "_end", "_day")


def local_side(matched: DataFrame, prefix: str = "local") -> DataFrame:
    """The sums of each bucket's events."""
    sums = matched.groupBy("bucket_id").agg(*local_sums())
    return sums.select("bucket_id", *[F.col(c).alias(f"{prefix}_{c}") for c in (*COUNTED, *ROUTING)])


def reconcile(events: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every bucket with its local sums, its counters less those, and its class."""
    b = full_buckets(buckets)
    exact = written(local_side(matches(events, b)), "matched")  # a row a bucket; read twice, as buckets without events are matched again
    unmatched = b.join(exact.select("bucket_id"), "bucket_id", "left_anti")
    near = local_side(matches(events, unmatched, boundary=True), "near")
    out = b.join(exact, "bucket_id", "left").join(near, "bucket_id", "left")
    has_usage = F.coalesce(*COUNTED).isNotNull()
    reported = F.array_compact(F.array(*COUNTED))
    all_zero = (F.size(reported) > 0) & F.forall(reported, lambda x: x == 0)
    here = F.col("local_request_count").isNotNull()
    differs = F.exists(F.array(*[F.col(c) - F.col(f"local_{c}") for c in COUNTED]), lambda d: F.coalesce(d != 0, F.lit(False)))
    routed = [F.col(c).isNotNull() & (F.coalesce(F.lower(c) != F.lower(f"local_{c}"), F.lit(True))) for c in ROUTING]
    no_route = F.coalesce(*[F.col(c) for c in ROUTING]).isNull()
    classified = (
        F.when(~here & all_zero, "matched")
        .when(~here & F.col("near_request_count").isNotNull() & has_usage, "time_boundary")
        .when(~here, "provider_only")
        .when(~has_usage, "route_unknown")
        .when(differs, "counter_mismatch")
        .when(no_route | routed[0] | routed[1] | routed[2], "route_unknown")
        .otherwise("matched")
    )
    zero = lambda c: F.when(~here & all_zero & F.col(c).isNotNull(), 0)
    local = {c: F.coalesce(F.col(f"local_{c}"), zero(c), F.when(classified == "time_boundary", F.col(f"near_{c}"))) for c in COUNTED}
    return out.select(*b.columns, classified.alias("classification"), *[v.alias(f"local_{c}") for c, v in local.items()], *[(F.col(c) - v).alias(f"delta_{c}") for c, v in local.items()])


def local_only(events: DataFrame, buckets: DataFrame, zone: str) -> DataFrame:
    """Events that no bucket with counters covers, by local day, provider and raw model."""
    usage = full_buckets(buckets).where(F.coalesce(*COUNTED).isNotNull())
    covered = matches(events, usage).select("client", "event_key").distinct()
    left = with_route(events).join(covered, ["client", "event_key"], "left_anti")
    rows = left.groupBy(local_date(F.col("occurred_at"), zone).alias("local_day"), provider_name(F.col("provider"), F.col("client")).alias("provider_name"), F.col("raw_model").alias("model")).agg(*local_sums())
    day = F.col("local_day").cast("timestamp")
    return rows.withColumns({"bucket_start": F.to_utc_timestamp(day, zone), "bucket_end": F.to_utc_timestamp(F.date_add("local_day", 1).cast("timestamp"), zone), "classification": F.lit("local_only")})


def summary(*classified: DataFrame) -> DataFrame:
    """Rows of each class, all classes listed."""
    rows = None
    for df in classified:
        part = df.groupBy("classification").agg(F.count("*").alias("n"))
        rows = part if rows is None else rows.unionAll(part)
    every = rows.sparkSession.createDataFrame([(c,) for c in CLASSES], "classification string")
    return every.join(rows.groupBy("classification").agg(F.sum("n").alias("n")), "classification", "left").select("classification", F.coalesce("n", F.lit(0)).alias("n"))


def class_order() -> Column:
    """A class's place in reports."""
    return F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("classification"))


def scope_summary(classified: DataFrame, providers: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Rows of each class within a cost query's providers and models; a bucket for all models counts."""
    if providers:
        classified = classified.where(F.col("provider").isin(providers))
    if models:
        classified = classified.where(F.col("model").isNull() | F.lower("model").isin([m.lower() for m in models]))
    return summary(classified)


def with_imports(buckets: DataFrame, imports: DataFrame) -> DataFrame:
    """Buckets with the digest and time of their import."""
    return buckets.join(small(imports.select("import_id", "content_digest", "imported_at")), "import_id")


def import_status(buckets: DataFrame) -> DataFrame:
    """Imports, buckets, extent and latest import of each source kind."""
    return buckets.groupBy("source_kind").agg(F.count_distinct("import_id").alias("imports"), F.count("*").alias("buckets"), F.count_distinct("provider").alias("providers"), F.min("bucket_start").alias("first_start"), F.max("bucket_end").alias("last_end"), F.max("import_id").alias("latest_import"))


def new_imports(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Documents (content_digest, ...) that weren't imported yet, each content once."""
    return documents.join(known.select("content_digest").distinct(), "content_digest", "left_anti").dropDuplicates(["content_digest"])
