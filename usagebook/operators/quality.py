"""Checks of observations, and fingerprints of unknown fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagebook.functions.ids import digest
from usagebook.functions.values import COUNTERS


def observation_issues(observations: DataFrame) -> DataFrame:
    """(client, event_key, source_id, line_number, code): counters that contradict each other."""
    writes = F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens") + F.col("cache_write_unknown_tokens")
    rules = {
        "negative_counter": F.least(*COUNTERS) < 0,
        "subsets_exceed_input": F.col("input_tokens_cached") + writes > F.col("input_tokens_total"),
        "reasoning_exceeds_output": F.col("reasoning_output_tokens") > F.col("output_tokens_total"),
        "input_not_additive": (F.col("client") == "claude_code") & (F.col("input_tokens_uncached") + F.col("input_tokens_cached") + writes != F.col("input_tokens_total")),
        "missing_model": F.col("raw_model").isNull(),
    }
    codes = F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()]))
    return observations.select("client", "event_key", "source_id", "line_number", F.explode(codes).alias("code"))


def unknown_keys(record: Column, known: list[str]) -> Column:
    """The top-level keys of a JSON record that aren't known, sorted; null if there are none."""
    extra = F.array_sort(F.array_except(F.json_object_keys(record), F.array(*[F.lit(k) for k in known])))
    return F.when(F.size(extra) > 0, extra)


def drift(records: DataFrame, known: list[str], text: str = "text") -> DataFrame:
    """Sets of unknown keys by fingerprint, so that a change of format shows without showing the keys themselves."""
    keys = records.select(unknown_keys(F.col(text), known).alias("keys")).where("keys is not null")
    return keys.groupBy(F.substring(digest(F.array_join("keys", "\n")), 1, 16).alias("fingerprint")).agg(F.count("*").alias("records"), F.max(F.size("keys")).alias("unknown_keys"))
