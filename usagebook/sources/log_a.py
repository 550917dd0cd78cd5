"""Session logs of client A: nested records, one JSON object a line; usage stands in assistant records.

Only usage and identifiers are read; prompts, answers and tool results never
leave the parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.functions.ids import pseudonym
from usagebook.functions.values import non_blank, rfc3339
from usagebook.sources.common import field, fields, file_lines, listed_files, parsed, some_rows

CLIENT, PROVIDER = "claude_code", "anthropic"
PATTERN = "*.[jJ][sS][oO][nN][lL]"
_U = "$.message.usage"
#: Counters: the object in which each stands, and its name there (fixed values).
_USAGE = {
    "input": ("_usage", "input_tokens"), "cached": ("_usage", "cache_read_input_tokens"), "writes": ("_usage", "cache_creation_input_tokens"), "w5m": ("_creation", "ephemeral_5m_input_tokens"), "w1h": ("_creation", "ephemeral_1h_input_tokens"),
    "output": ("_usage", "output_tokens"), "searches": ("_tools", "web_search_requests"), "fetches": ("_tools", "web_fetch_requests"),
}
_SETTINGS = ("service_tier", "speed", "inference_geo")
#: What is read of each object of a record.
_OBJECTS = {"_top": ("$", ("type", "timestamp", "sessionId", "requestId", "uuid")), "_message": ("$.message", ("id", "model", "usage")), "_usage": (_U, _SETTINGS), "_creation": (f"{_U}.cache_creation", ()), "_tools": (f"{_U}.server_tool_use", ())}
_OBJECTS = {name: (path, (*known, *(n for of, n in _USAGE.values() if of == name))) for name, (path, known) in _OBJECTS.items()}


def records(lines: DataFrame) -> DataFrame:
    """Assistant records with their counters and identifiers, and code, the reason why a record can't be used."""
    p = parsed(lines).select("source_id", "path", "line_number", F.col("v").isNull().alias("_malformed"), *[fields("v", path, names).alias(name) for name, (path, names) in _OBJECTS.items()])
    # a selection of its own: each object is read once, however often the next one uses it
    session = F.coalesce(field("_top", "sessionId"), F.nullif(F.regexp_extract("path", r"([^/]+)/subagents/[^/]+$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+?)(\.jsonl)?$", 1))
    kind = {name: field(of, n, "kind") for name, (of, n) in _USAGE.items()}
    number = {name: field(of, n, "number") for name, (of, n) in _USAGE.items()}
    bad = F.exists(F.array(*[kind[name].isNotNull() & (kind[name] != "VOID") & number[name].isNull() for name in _USAGE]), lambda x: x)
    row = {
        "source_id": F.col("source_id"), "line_number": F.col("line_number"), "_malformed": F.col("_malformed"), "_type": field("_top", "type"), "_time": field("_top", "timestamp"),
        "_key": F.coalesce(non_blank(field("_message", "id")), non_blank(field("_top", "requestId")), non_blank(field("_top", "uuid"))), "session_id": pseudonym("ses", "session", session), "raw_model": field("_message", "model"),
        **number, "_bad": F.coalesce(bad, F.lit(False)), **{name: F.lower(non_blank(field("_usage", name))) for name in _SETTINGS}, "_has_usage": field("_message", "usage", "kind").isNotNull(), "occurred_at": rfc3339(field("_top", "timestamp")),
    }
    rows = some_rows(p, row, F.col("_malformed") | (field("_top", "type") == "assistant"))
    nothing = F.coalesce(*_USAGE).isNull()
    code = (
        F.when(F.col("_malformed"), "claude_malformed_record")
        .when(F.col("_time").isNull(), "claude_missing_timestamp")
        .when(F.col("occurred_at").isNull(), "claude_invalid_timestamp")
        .when(~F.col("_has_usage"), "claude_missing_usage")
        .when(nothing, "claude_empty_usage")
    )
    return rows.withColumn("code", code)


def observations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations and warnings of client A's lines.

    Records of one response repeat with growing counters: within a file they are
    one observation with each counter's maximum and the earliest time.
    """
    rows = records(lines)
    warnings = rows.where("code is not null").select("source_id", "line_number", "code")
    good = rows.where("code is null").withColumn("group_key", F.coalesce("_key", F.concat_ws(":", "source_id", "line_number")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_number"))).alias(c)
    merged = good.groupBy("source_id", "group_key").agg(
        F.min("line_number").alias("line_number"), F.min("occurred_at").alias("occurred_at"), *[F.max(c).alias(c) for c in _USAGE], *[first(c) for c in ("session_id", "raw_model", "service_tier", "speed", "inference_geo")],
        (F.count_distinct("raw_model") > 1).alias("disagrees"), F.bool_or("_bad").alias("bad"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    classified = zero("w5m") + zero("w1h")
    writes = F.greatest(zero("writes"), classified)
    over = F.col("writes").isNotNull() & (classified > F.col("writes"))
    reasons = F.array_compact(F.array(F.when(F.col("disagrees"), "model_disagreement"), F.when(F.col("bad"), "invalid_counter"), F.when(over, "ttl_sum_above_total"), F.when(F.col("output").isNull(), "output_missing"), F.when(F.col("input").isNull(), "input_missing")))
    out = merged.select(
        "source_id", "line_number", F.lit(CLIENT).alias("client"), "group_key", pseudonym("evt", "message", F.col("group_key")).alias("event_key"), "session_id", "occurred_at", "raw_model", F.lit(PROVIDER).alias("provider"),
        (zero("input") + zero("cached") + writes).alias("input_tokens_total"), zero("input").alias("input_tokens_uncached"), zero("cached").alias("input_tokens_cached"), zero("w5m").alias("cache_write_5m_tokens"), zero("w1h").alias("cache_write_1h_tokens"), (writes - classified).alias("cache_write_unknown_tokens"),
        zero("output").alias("output_tokens_total"), F.lit(0).cast("long").alias("reasoning_output_tokens"), zero("searches").alias("web_search_requests"), zero("fetches").alias("web_fetch_requests"),
        F.when(F.size(reasons) == 0, "complete").otherwise("partial").alias("coverage"), F.lit(3).alias("quality_rank"), F.element_at(F.concat(reasons, F.array(F.lit(None).cast("string"))), 1).alias("warning"),
        F.lit(None).cast("string").alias("auth_mode"), F.lit(None).cast("string").alias("auth_mode_provenance"), "service_tier", "speed", "inference_geo",
        (F.col("writes").isNotNull() | (F.col("w5m").isNotNull() & F.col("w1h").isNotNull())).alias("cache_write_data_complete"), F.lit(True).alias("input_subset_accounting_consistent"),
    )
    return out.drop("group_key"), warnings


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The log files below root/projects, none of them opened."""
    return listed_files(spark, [f"{root}/projects"], PATTERN)


def read(spark: SparkSession, root: str, files: DataFrame | None = None, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, observations and warnings below root/projects, or of some of the files listed there. Profiles say nothing of this client."""
    files, lines, tails = file_lines(listed(spark, root) if files is None else files)
    seen, warnings = observations(lines)
    return files, seen, warnings.unionByName(tails)
