"""Usage reports over priced events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagebook.functions.ids import short
from usagebook.functions.tables import written
from usagebook.functions.values import COUNTERS, local_date
from usagebook.operators.measures import STATUSES, finished, measure_sums
from usagebook.operators.pricing import TOKENS, TOOLS

QUALITY = ("unresolved", "heuristic", "derived", "exact")
#: Items that evidence lists keep for display.
EVIDENCE = 32


def report_filter(events: DataFrame, clients: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Events of the clients, and of the models by raw or canonical name, whatever their case."""
    if clients:
        events = events.where(F.col("client").isin(clients))
    if models:
        low = [m.lower() for m in models]
        events = events.where(F.lower("raw_model").isin(low) | F.coalesce(F.lower("canonical_model").isin(low), F.lit(False)))
    return events


def model_name() -> Column:
    return F.coalesce("canonical_model", "raw_model")


def usage_sums() -> list[Column]:
    return [
        F.count("*").alias("requests"), F.count_distinct(F.struct("client", "session_id")).alias("sessions"), *[F.sum(c).alias(c) for c in COUNTERS],
        *[F.count_if(F.col("legacy_status") == s).alias(f"{s}_events") for s in ("priced", "partial", "unpriced")],
        F.element_at(F.array(*[F.lit(q) for q in QUALITY]), F.min("quality_rank").cast("int") + 1).alias("quality"),
    ]


def usage_report(priced: DataFrame, by: tuple[str, ...], zone: str = "UTC", evidence: bool = False) -> DataFrame:
    """One row a group of local day, client and model (any of them): requests, sessions, tokens, both measures, quality.

    With evidence also all event ids and warnings of a group, sorted.
    """
    keys = {"day": local_date(F.col("occurred_at"), zone), "client": F.col("client"), "model": model_name(), "session": F.col("session_id")}
    unknown = set(by) - set(keys)
    if unknown or not by:
        raise ValueError(f"group by some of {sorted(keys)}")
    extra = [F.array_sort(F.collect_set("event_id")).alias("event_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings")] if evidence else []
    groups = priced.groupBy(*[keys[k].alias(k) for k in by]).agg(*usage_sums(), *measure_sums("usd"), *measure_sums("credits"), *extra)
    return finished(groups, "usd", "credits")


def usage_summary(priced: DataFrame) -> DataFrame:
    """The same over all events, in one row."""
    return finished(priced.agg(*usage_sums(), *measure_sums("usd"), *measure_sums("credits")), "usd", "credits")


def provider_units(priced: DataFrame) -> DataFrame:
    """Credits of each client: exact where every event that applies is, else what is known."""
    applies = priced.where("credits_status <> 'unavailable'").withColumn("unit", F.lit("credits"))
    exact = F.col("credits_status") == "exact"
    sums = applies.groupBy("client", "unit").agg(F.count("*").alias("expected"), F.count_if(exact).alias("exact_events"), F.sum(F.when(exact, F.col("credits_lower"))).alias("exact_sum"), F.sum("credits_lower").alias("known_sum"))
    return sums.select("client", "unit", "expected", "exact_events", F.when(F.col("expected") == F.col("exact_events"), F.col("exact_sum")).alias("exact_units"), F.when((F.col("expected") > F.col("exact_events")) & (F.col("known_sum") != 0), F.col("known_sum")).alias("known_units"))


def session_report(events: DataFrame) -> DataFrame:
    """First and last event, requests, models and tokens of each session."""
    return events.groupBy("client", "session_id").agg(
        F.min("occurred_at").alias("first_event"), F.max("occurred_at").alias("last_event"), F.count("*").alias("requests"), F.array_sort(F.collect_set("raw_model")).alias("models"),
        F.sum("input_tokens_total").alias("input_tokens_total"), F.sum("output_tokens_total").alias("output_tokens_total"),
    ).withColumn("display_id", short(F.col("session_id")))


def model_report(events: DataFrame) -> DataFrame:
    """Events and tokens of each (client, raw model)."""
    return events.groupBy("client", "raw_model").agg(F.count("*").alias("events"), *[F.sum(c).alias(c) for c in COUNTERS])


def cost_report(priced: DataFrame) -> DataFrame:
    """A row for each (client, provider, model) and one for all (grouping = 1), each from the events, since sessions don't add up. Without events the row for all has zeros, and no bounds."""
    keyed = priced.select("*", model_name().alias("model"), F.lower(F.trim("provider")).alias("provider_name"))
    keys = ["client", "provider_name", "model"]
    # rows of a session appear once a group; distinct sessions are counted per grouping
    sums = [F.count("*").alias("requests"), F.count_distinct(F.concat_ws("|", "client", "session_id")).alias("sessions"), *[F.sum(c).alias(c) for c in COUNTERS], *measure_sums("usd"), *measure_sums("credits")]
    groups = keyed.groupingSets([keys, []], *keys).agg(F.grouping_id().alias("grouping"), *sums).withColumn("grouping", F.when(F.col("grouping") > 0, 1).otherwise(0))
    kinds = {f.name: f.dataType for f in groups.schema}
    nothing = keyed.where(F.lit(False)).agg(*sums).na.fill(0, [*COUNTERS]).withColumns({k: F.lit(None).cast(kinds[k]) for k in keys} | {"grouping": F.lit(1)})
    # grouping sets give no row for all of nothing; where there is one, it has more requests
    others = [c for c in groups.columns if c not in ("grouping", *keys)]
    whole = groups.unionByName(nothing).groupBy("grouping", *keys).agg(F.max_by(F.struct(*others), "requests").alias("r")).select(*keys, "grouping", "r.*")
    return finished(whole, "usd", "credits")


def missing_components(priced: DataFrame, kind: str = "usd") -> DataFrame:
    """Components without a price: their events and quantity; a quantity that isn't always known is null."""
    rows = priced.select(F.explode("missing").alias("m")).select(F.lit(kind).alias("kind"), "m.component", "m.quantity")
    return rows.groupBy("kind", "component").agg(F.count("*").alias("events"), F.when(F.count("quantity") == F.count("*"), F.sum("quantity")).alias("quantity"))


def evidence_list(values: Column) -> Column:
    """At most EVIDENCE distinct values, in order, for display."""
    return F.slice(F.array_sort(F.collect_set(values)), 1, EVIDENCE)


def explained(kind: str = "usd") -> Column:
    """What is said of each event's amount: a sentence for each priced component, for each missing one with its reason, and for writes that only bounds know."""
    gone = lambda n: F.exists("missing", lambda m: m["component"] == n)
    used = [F.when((F.col(q) > 0) & ~gone(n), f"{n}: summed over events") for n, q in ((n, q) for n, q, _ in TOKENS)] + [F.when((F.col(q) > 0) & ~gone(q), f"{q}: summed over events") for q, _ in TOOLS]
    bounded = F.when((F.col(f"{kind}_status") == "bounded") & gone("cache_write_observation"), "cache writes not reported: bounded by the input counter")
    absent = F.transform("missing", lambda m: F.concat(m["component"], F.lit(": "), reason(m["component"])))
    return F.array_compact(F.concat(F.array(F.when(F.col(f"{kind}_status") == "unpriced", "no price in effect"), bounded, *[F.when(F.col(f"{kind}_status") != "unpriced", u) for u in used]), absent))


def reason(component: Column) -> Column:
    return F.when(component == "cache_write_observation", "not_observed").otherwise("no_rate")


def evidence(priced: DataFrame, by: tuple[str, ...] = ("client",), kind: str = "usd", most: int = EVIDENCE) -> DataFrame:
    """For each group of client, provider or model: events by status, missing components and explanations of their amounts.

    A missing component's quantity is null if that of any event is. Explanations are
    distinct and the least `most` in order; explanation_count is of all events'
    and omitted_explanation_count of those not shown. Distinct values are found
    before they move and no group's are gathered beyond `most`: Spark cuts each
    task's rows to `most` before the shuffle.
    """
    names = {"client": F.col("client"), "provider": F.lower(F.trim("provider")), "model": model_name()}
    rows = written(priced.select(*[names[k].alias(k) for k in by], f"{kind}_status", "missing", explained(kind).alias("said")), "evidence")  # read three times
    status = F.col(f"{kind}_status")
    counts = rows.groupBy(*by).agg(*[F.count_if(status == s).alias(f"{s}_events") for s in STATUSES], F.sum(F.size("said")).alias("explanation_count"))
    said = rows.select(*by, F.explode("said").alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy("text"))
    shown = said.withColumn("_n", place).where(F.col("_n") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("text")).alias("explanations"))
    gaps = rows.select(*by, F.explode("missing").alias("m")).groupBy(*by, F.col("m.component").alias("component")).agg(F.when(F.count("m.quantity") == F.count("*"), F.sum("m.quantity")).alias("quantity"))
    gone = gaps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.lit(kind).alias("kind"), "component", reason(F.col("component")).alias("reason"), "quantity"))).alias("missing_components"))  # nine components at most
    out = counts
    for part in (shown, gone):
        own = [f"_{k}" for k in by]
        other = part.withColumnsRenamed(dict(zip(by, own, strict=True)))
        out = out.join(other, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(by, own, strict=True)], "left").drop(*own)
    return out.withColumn("omitted_explanation_count", F.col("explanation_count") - F.coalesce(F.size("explanations"), F.lit(0)))


def provider_scope(events: DataFrame, given: list[str] | None = None) -> DataFrame:
    """The providers of the events, else those given, else both known ones."""
    found = events.select(F.lower(F.trim("provider")).alias("provider")).distinct()
    return events.sparkSession.createDataFrame([(p,) for p in given or ("anthropic", "openai")], "provider string") if found.isEmpty() else found


def period(events: DataFrame, zone: str) -> DataFrame:
    """The first and last local day of all events; null where there are none."""
    day = local_date(F.col("occurred_at"), zone)
    return events.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
