"""Sinks of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagebook.functions.values import money_text


def flat(report: DataFrame) -> DataFrame:
    """The columns as CSV can hold them: arrays, maps and structs as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return report.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in report.schema.fields])


#: The columns of a usage row as CSV, in their order (fixed values).
ROW_COLUMNS = (
    "day", "client", "model", "requests", "event_ids_json", "sessions", "input_tokens_total", "input_tokens_uncached", "input_tokens_cached", "cache_write_5m_tokens", "cache_write_1h_tokens", "cache_write_unknown_tokens",
    "output_tokens_total", "reasoning_output_tokens", "web_search_requests", "web_fetch_requests", "api_equivalent_usd", "known_api_equivalent_usd", "api_equivalent_usd_status", "api_equivalent_usd_lower_bound",
    "api_equivalent_usd_upper_bound", "provider_units_json", "known_provider_units_json", "provider_unit_name", "provider_unit_status", "provider_unit_lower_bound", "provider_unit_upper_bound", "priced_events", "partial_events",
    "unpriced_events", "quality", "warnings_json",
)
#: The columns of context before them in a document (fixed values).
CONTEXT_COLUMNS = (
    "record_type", "report_schema_version", "generated_at_utc", "timezone", "requested_start_date", "requested_end_date_inclusive", "client_filters_json", "model_filters_json", "query_start_utc", "query_end_utc_exclusive",
    "catalog_revision", "catalog_sha256", "catalog_freshness", "coverage_json",
)
UNIT = "credits"


def usage_rows(report: DataFrame) -> DataFrame:
    """A usage report with evidence as the fixed columns, all text: an exact amount is stated as such, any other lower bound as known; what a report isn't grouped by is empty."""
    lower, upper = (lambda m: money_text(F.col(f"{m}_lower"))), (lambda m: money_text(F.col(f"{m}_upper")))
    exact = lambda m: F.col(f"{m}_status") == "exact"
    units = lambda when: F.to_json(F.map_filter(F.create_map(F.lit(UNIT), F.when(when, lower("credits"))), lambda _, v: v.isNotNull()))
    made = {
        "event_ids_json": F.to_json("event_ids"), "warnings_json": F.to_json("warnings"), "api_equivalent_usd": F.when(exact("usd"), lower("usd")), "known_api_equivalent_usd": F.when(~exact("usd"), lower("usd")), "api_equivalent_usd_status": F.col("usd_status"),
        "api_equivalent_usd_lower_bound": lower("usd"), "api_equivalent_usd_upper_bound": upper("usd"), "provider_units_json": units(exact("credits")), "known_provider_units_json": units(~exact("credits") & (F.col("credits_lower") != 0)),
        "provider_unit_name": F.when(F.col("credits_status") != "unavailable", UNIT), "provider_unit_status": F.col("credits_status"), "provider_unit_lower_bound": lower("credits"), "provider_unit_upper_bound": upper("credits"),
    }
    value = lambda c: made[c] if c in made else F.col(c) if c in report.columns else F.lit(None)
    return report.select(*[F.coalesce(value(c).cast("string"), F.lit("")).alias(c) for c in ROW_COLUMNS])


def usage_document(report: DataFrame, context: dict[str, str], coverage: str) -> DataFrame:
    """A row of metadata, which alone holds the coverage, then the usage rows, each with the context, in fixed columns."""
    named = CONTEXT_COLUMNS[1:-1]
    if unknown := set(context) - set(named):
        raise ValueError(f"no such context: {sorted(unknown)}")
    common = [F.lit(context.get(c, "")).alias(c) for c in named]
    data = usage_rows(report).select(F.lit("data").alias("record_type"), *common, F.lit("").alias("coverage_json"), "*")
    return report.sparkSession.range(1).select(F.lit("metadata").alias("record_type"), *common, F.lit(coverage).alias("coverage_json"), *[F.lit("").alias(c) for c in ROW_COLUMNS]).unionByName(data)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_csv(report: DataFrame, path: str) -> None:
    flat(report).write.mode("overwrite").csv(path, header=True, escape="\"")


def envelope(report: DataFrame, context: dict[str, str]) -> DataFrame:
    """A metadata row and the data rows, each with the context, so that any part of the file explains itself."""
    named = [F.lit(v).alias(f"context_{k}") for k, v in context.items()]
    data = flat(report).select(F.lit("data").alias("record_type"), *named, "*")
    metadata = report.sparkSession.range(1).select(F.lit("metadata").alias("record_type"), *named)
    return metadata.unionByName(data, allowMissingColumns=True)


def document(context: dict[str, str], **parts: DataFrame) -> DataFrame:
    """A nested document: the context, and each part's rows as an array. Parts are report-sized."""
    spark = next(iter(parts.values())).sparkSession
    out = spark.range(1).select(*[F.lit(v).alias(k) for k, v in context.items()])
    for name, df in parts.items():
        out = out.crossJoin(df.agg(F.collect_list(F.struct(*df.columns)).alias(name)))  # one row each
    return out
