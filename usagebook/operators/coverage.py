"""What the ledger covers: clients, sources, runs, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagebook.functions.values import local_date

CLIENTS = ("claude_code", "openai_codex")
#: Completed runs that are kept.
RUNS_KEPT = 256


def ledger_stats(observations: DataFrame) -> DataFrame:
    return observations.agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("observations"), F.count_distinct("client", "event_key").alias("events"), F.count("warning").alias("warnings"))


def client_coverage(observations: DataFrame, events: DataFrame) -> DataFrame:
    """For every known client its sources, observations and events, and its first and last event (ties by key)."""
    clients = observations.sparkSession.createDataFrame([(c,) for c in CLIENTS], "client string")
    seen = observations.groupBy("client").agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("observations"), F.count("warning").alias("warnings"))
    order = F.struct("occurred_at", "event_key")
    edges = events.groupBy("client").agg(F.count("*").alias("events"), F.min(order).alias("first"), F.max(order).alias("last"))
    out = clients.join(seen, "client", "left").join(edges, "client", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(F.coalesce("sources", F.lit(0)) == 0, "no_sources").when(F.coalesce("events", F.lit(0)) == 0, "no_observations").otherwise("observed_window")
    return out.select("client", zero("sources"), zero("observations"), zero("events"), zero("warnings"), status.alias("window_status"), F.col("first.event_key").alias("first_key"), F.col("first.occurred_at").alias("first_at"), F.col("last.event_key").alias("last_key"), F.col("last.occurred_at").alias("last_at"))


def query_coverage(coverage: DataFrame, matching: DataFrame, start: str, end: str) -> DataFrame:
    """How each client's ledger covers [start, end): five states, no events being no proof of no usage."""
    hits = matching.groupBy("client").agg(F.count("*").alias("matching_events"))
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    n = F.coalesce("matching_events", F.lit(0))
    status = F.when(F.col("window_status") != "observed_window", F.col("window_status")).when(n > 0, "matching_events").when((b <= F.col("first_at")) | (a > F.col("last_at")), "outside_observed_window").otherwise("no_events_within_observed_window")
    return coverage.join(hits, "client", "left").select("client", status.alias("status"), n.alias("matching_events"))


def warning_counts(warnings: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Warnings of the latest run by client and code; one without a source keeps a null client."""
    latest = warnings
    if "run_id" in warnings.columns:
        newest = warnings.agg(F.max("run_id").alias("_run"))  # one row
        latest = warnings.join(F.broadcast(newest), F.col("run_id") == F.col("_run")).drop("_run")
    if sources is not None:
        latest = latest.join(sources.select("source_id", "client"), "source_id", "left")
    code = F.when(F.col("code").rlike("^[a-z0-9_]{1,64}$"), F.col("code")).otherwise("unrecognised")
    return latest.groupBy("client", code.alias("code")).agg(F.count("*").alias("n"))


def latest_runs(runs: DataFrame, keep: int = RUNS_KEPT) -> DataFrame:
    """The newest completed runs; the first of them is the latest."""
    done = runs.where("completed_at is not null").orderBy(F.desc("run_id")).limit(keep)
    return done.withColumn("age", F.row_number().over(Window.orderBy(F.desc("run_id"))))


def daily_activity(events: DataFrame, zone: str) -> DataFrame:
    return events.groupBy(local_date(F.col("occurred_at"), zone).alias("day"), "client").agg(F.count("*").alias("events"))


def health(observations: DataFrame, unresolved: DataFrame, issues: DataFrame, summary: DataFrame | None = None, sources: DataFrame | None = None, catalogs: DataFrame | None = None) -> DataFrame:
    """check, status, detail: the ledger's size, models without a price and catalog issues; with them the last run, each client's sources, and the catalogs' freshness.

    The row `overall` needs attention if a run was provisional or warned, a model has
    no price or a catalog has issues. A client of whom no source was found needs it
    too, but doesn't decide; nor does a catalog's age. unresolved is a short list (pricing.unresolved_models).
    """
    rows = [_lines(ledger_stats(observations))]
    models = unresolved.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("raw_model")), ",").alias("names"))
    rows.append(models.select(F.lit("unresolved_models").alias("check"), _tone(F.col("n") > 0), F.col("names").alias("detail")))
    rows.append(issues.agg(F.count("*").alias("n")).select(F.lit("catalog_issues").alias("check"), _tone(F.col("n") > 0), F.col("n").cast("string").alias("detail")))
    if summary is not None:
        # the newest run alone
        last = summary.agg(*[F.max_by(c, "run_id").alias(c) for c in ("warnings", "provisional", "status")])
        rows.append(last.select(F.lit("run_warnings").alias("check"), _tone(F.col("warnings") > 0), F.col("warnings").cast("string").alias("detail")))
        rows.append(last.select(F.lit("last_run").alias("check"), _tone(F.col("provisional")), F.coalesce("status", F.lit("none")).alias("detail")))
    if sources is not None:
        clients = observations.sparkSession.createDataFrame([(c,) for c in CLIENTS], "client string")
        found = sources.groupBy("client").agg(F.count("*").alias("n"), F.count_if("compressed").alias("compressed"))
        n = F.coalesce("n", F.lit(0))
        detail = F.concat_ws(" ", n.cast("string"), F.lit("sources,"), F.coalesce("compressed", F.lit(0)).cast("string"), F.lit("compressed"))
        rows.append(clients.join(found, "client", "left").select(F.concat(F.lit("sources:"), "client").alias("check"), _tone(n == 0), detail.alias("detail")))
    if catalogs is not None:
        rows.append(catalogs.select(F.concat(F.lit("catalog:"), F.coalesce("revision", F.lit(""))).alias("check"), _tone((F.col("freshness") != "fresh") | ~F.col("valid")), F.concat_ws(" ", "freshness", F.when(F.col("valid"), "valid").otherwise("invalid")).alias("detail")))
    whole = reduce(DataFrame.unionByName, rows)
    decides = (F.col("status") == "attention") & (F.col("check").isin("unresolved_models", "catalog_issues", "run_warnings", "last_run") | (F.startswith("check", F.lit("catalog:")) & F.endswith("detail", F.lit(" invalid"))))
    overall = whole.agg(F.count_if(decides).alias("n")).select(F.lit("overall").alias("check"), _tone(F.col("n") > 0), F.col("n").cast("string").alias("detail"))
    return whole.unionByName(overall)


def _tone(attention: Column) -> Column:
    return F.when(attention, "attention").otherwise("ok").alias("status")


def _lines(row: DataFrame) -> DataFrame:
    """A line for each column of a table of one row."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.lit("ok").alias("status"), F.col(c).cast("string").alias("detail")) for c in row.columns])).alias("r")).select("r.*")
