"""Small column functions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a source uses to say that it doesn't know (fixed values).
UNRESOLVED = ("", "unknown", "not_available", "not-available", "unavailable", "n/a", "null")
COVERAGE = ("unavailable", "partial", "complete")
#: Rows up to which a dimension table is broadcast; beyond, Spark chooses the join.
BROADCAST_ROWS = 100_000

COUNTERS = (
    "input_tokens_total", "input_tokens_uncached", "input_tokens_cached", "cache_write_5m_tokens", "cache_write_1h_tokens",
    "cache_write_unknown_tokens", "output_tokens_total", "reasoning_output_tokens", "web_search_requests", "web_fetch_requests",
)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contains(from_: Column, to: Column, instant: Column) -> Column:
    """Whether [from, to) holds an instant; no end is open."""
    return (from_ <= instant) & (to.isNull() | (instant < to))


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Whether two half-open intervals share an instant."""
    return (to_b.isNull() | (from_a < to_b)) & (to_a.isNull() | (from_b < to_a))


def non_blank(value: Column) -> Column:
    """The trimmed value, null if blank."""
    return F.nullif(F.trim(value), F.lit(""))


def resolved(value: Column) -> Column:
    """The value in lower case, null if it says that it's unknown."""
    low = F.lower(F.trim(value))
    return F.when(~low.isin(*UNRESOLVED), low)


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """A label's place in an order, -1 for none."""
    return reduce(lambda out, k: F.when(value == order[k], k).otherwise(out), range(len(order)), F.lit(-1))


def local_date(instant: Column, zone: str) -> Column:
    """The calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def day_bounds(first: Column, last: Column, zone: str) -> tuple[Column, Column]:
    """The half-open UTC instants of an inclusive range of local days. A midnight that a clock change skips is the next instant that exists; one that occurs twice is the earlier."""
    return F.to_utc_timestamp(first.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(last, 1).cast("timestamp"), zone)


def complete_sum(value: Column) -> Column:
    """A sum that is null if any part is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def is_api_key(auth_mode: Column) -> Column:
    return F.coalesce(F.contains(F.lower(F.regexp_replace(auth_mode, "[^A-Za-z0-9]", "")), F.lit("apikey")), F.lit(False))


def provider_name(provider: Column, client: Column | None = None) -> Column:
    """One spelling for a provider; by client if it is missing or unknown."""
    name = F.translate(F.lower(F.trim(provider)), "-_ ", "")
    named = F.when(name.isin(*UNRESOLVED) | name.isNull(), None).otherwise(name)
    if client is None:
        return named
    return F.coalesce(named, F.when(client == "claude_code", "anthropic").when(client == "openai_codex", "openai"))


def total_input(total: Column, *parts: Column) -> Column:
    """The reported total of input tokens, or the sum of the classes."""
    return F.when(total > 0, total).otherwise(reduce(lambda a, b: a + b, parts))


def nano(amount: Column) -> Column:
    """An amount in whole billionths."""
    return F.round(amount * 1_000_000_000, 0).cast("long")


def money_text(amount: Column, digits: int = 6) -> Column:
    """Rounded half-even, without trailing zeros."""
    text = F.bround(amount, digits).cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def rfc3339(text: Column) -> Column:
    """An RFC 3339 instant, null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def flexible_instant(text: Column) -> Column:
    """Epoch seconds, an RFC 3339 instant, or a day."""
    return F.coalesce(F.when(text.rlike(r"^-?\d{1,12}$"), F.timestamp_seconds(text.cast("long"))), rfc3339(text), F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(text)))


def sanitised(identifier: Column, length: int = 128, fallback: str = "redacted") -> Column:
    """An identifier of the allowed alphabet and length, else the fallback."""
    return F.when(identifier.rlike(rf"^[A-Za-z0-9._;=:/@+-]{{1,{length}}}$"), identifier).otherwise(F.lit(fallback))
