"""The composed jobs: from logs and a catalog to reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta
from types import ModuleType
from zoneinfo import ZoneInfo

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.functions.tables import written
from usagebook.operators import billing, canonical, catalog, coverage, incremental, ledger, pricing, reconcile, reports, verification
from usagebook.sources import common, documents, exports, log_a, log_b, sinks

#: Each client's logs: listed(spark, root), and read(spark, root, files, profiles) for files, observations and warnings.
ADAPTERS: dict[str, ModuleType] = {log_a.CLIENT: log_a, log_b.CLIENT: log_b}


@dataclass
class Ingested:
    """The whole observations, and of this run its own: those of changed sources, warnings, the inventory after it, changes, summary."""

    observations: DataFrame
    warnings: DataFrame
    sources: DataFrame
    changes: DataFrame
    summary: DataFrame
    fresh: DataFrame


def ingest(spark: SparkSession, roots: dict[str, str], run_id: int, stored: DataFrame | None = None, inventory: DataFrame | None = None, since: str | None = None, verify: bool = False, profiles: DataFrame | None = None) -> Ingested:
    """Reads the clients' logs below their roots; observations of sources that didn't change are taken from the stored ones.

    With an inventory, only files of another size or time than listed there are
    opened; with verify all are, and compared by their digests. Which files to open
    is a table, read by ranges of bytes; no path comes to the driver. profiles (root,
    auth_mode) say how a client was authenticated where its logs don't. A run limited by since leaves the sources it read as they were in the inventory,
    so that the next whole run reads them again.
    """
    seen = warned = sources = None
    for client, root in roots.items():
        opened = held = None
        if inventory is not None and not verify:
            listed = ADAPTERS[client].listed(spark, root).withColumn("source_id", common.source_id(F.col("path")))
            opened = written(incremental.touched(listed, inventory), "touched")
            held = inventory.join(listed.join(opened, "source_id", "left_anti"), "source_id", "left_semi")
        files, own, warnings = ADAPTERS[client].read(spark, root, opened, profiles)
        now = common.sources(files, client)
        now = now if held is None else now.unionByName(held.select(now.columns))
        seen = own if seen is None else seen.unionByName(own, allowMissingColumns=True)
        warned = warnings if warned is None else warned.unionByName(warnings)
        sources = now if sources is None else sources.unionByName(now)
    before = inventory if inventory is not None else sources.where("1 = 0")
    changes = incremental.source_changes(sources, before)
    if since is not None:
        seen = seen.where(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    new = seen.join(incremental.stale(changes), "source_id", "left_semi")
    whole = new if stored is None else incremental.replaced(stored, changes, new, since)
    summary = incremental.run_summary(changes, new, warned, run_id, limited=since is not None)
    after = incremental.source_status(sources, warned, run_id)
    if since is not None:
        after = before.unionByName(after.where("1 = 0"), allowMissingColumns=True)
    return Ingested(whole, warned, after, changes, summary, new)


def ledger_run(spark: SparkSession, roots: dict[str, str], path: str, run_id: int, today: date, profiles: DataFrame | None = None) -> tuple[Ingested, DataFrame]:
    """One run that grows the ledger at a path: what it read, and the parts of the ledger that were written.

    The inventory lies beside the ledger, one table a run, with the day on which
    each source was first seen. Logs that grew are merged into what is there; of
    rewritten ones the old rows go; vanished ones keep theirs.
    """
    inventory = _inventory(spark, path)
    run = ingest(spark, roots, run_id, inventory=inventory, profiles=profiles)
    days = F.lit(today)
    sources = run.sources
    if inventory is not None:
        gone = run.changes.where("state = 'vanished'").select("source_id")
        sources = sources.unionByName(inventory.drop("born").join(gone, "source_id", "left_semi"), allowMissingColumns=True)
        known = inventory.select("source_id", F.col("born").alias("_born"))
        sources = sources.drop("born").join(known, "source_id", "left").withColumn("born", F.coalesce("_born", days)).drop("_born")
    else:
        sources = sources.withColumn("born", days)
    sources = written(sources, "sources")
    wrote = ledger.merge(spark, path, run.fresh, sources, run_id, run.changes.where("state = 'rewritten'").select("source_id"))
    sources.write.mode("overwrite").parquet(f"{path}/sources/run={run_id:09d}")
    return run, wrote


def _inventory(spark: SparkSession, path: str) -> DataFrame | None:
    """The inventory of the last run of a ledger; None before the first."""
    try:
        every = spark.read.parquet(f"{path}/sources")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return every.where(F.col("run") == every.agg(F.max("run")).first()[0]).drop("run")


def local_bounds(first: date, last: date, zone: str) -> tuple[datetime, datetime]:
    """The instants in UTC at which the local days from first to last begin and end."""
    start = lambda day: datetime.combine(day, time(), ZoneInfo(zone)).astimezone(UTC)
    return start(first), start(last + timedelta(days=1))


def cost_period(selection: str, zone: str, now: datetime, first: date | None = None, last: date | None = None) -> tuple[date, date] | None:
    """The first and last local day of a period: today, yesterday, month (to date), range (as given); None for all history."""
    today = now.astimezone(ZoneInfo(zone)).date()
    match selection:
        case "today":
            return today, today
        case "yesterday":
            return today - timedelta(days=1), today - timedelta(days=1)
        case "month":
            return today.replace(day=1), today
        case "range" if first is not None and last is not None and last >= first:
            return first, last
        case "all":
            return None
    raise ValueError(f"no period {selection!r} from {first} to {last}")


def period_cost_report(observations: DataFrame, prices: pricing.Catalog, selection: str, zone: str, now: datetime, first: date | None = None, last: date | None = None, clients: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """The cost report of a local-calendar period, with its first and last day; those of all history are its events' own, null without any."""
    days = cost_period(selection, zone, now, first, last)
    start, end = local_bounds(*days, zone) if days else (None, None)
    report = cost_report(observations, prices, start, end, clients, models)
    if days:
        return report.select("*", F.lit(days[0]).alias("first_day"), F.lit(days[1]).alias("last_day"))
    return report.crossJoin(F.broadcast(reports.period(canonical.fold(observations), zone)))  # one row


def usage_report(observations: DataFrame, prices: pricing.Catalog, by: tuple[str, ...] = ("day", "client", "model"), zone: str = "UTC", start: str | None = None, end: str | None = None, clients: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    events = canonical.in_window(canonical.fold(observations), start, end)
    rows = reports.usage_report(reports.report_filter(pricing.price(events, prices), clients, models), by, zone)
    return rows.orderBy(*[F.asc_nulls_first(k) for k in by])


def cost_report(observations: DataFrame, prices: pricing.Catalog, start: object = None, end: object = None, clients: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    events = canonical.in_window(canonical.fold(observations), start, end)
    return reports.cost_report(reports.report_filter(pricing.price(events, prices), clients, models)).orderBy("grouping", "client", "provider_name", "model")


def session_report(observations: DataFrame, start: object = None, end: object = None, day: date | None = None, zone: str = "UTC", clients: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Sessions by their events in a window, or on a local day."""
    if day is not None:
        start, end = local_bounds(day, day, zone)
    events = reports.report_filter(canonical.in_window(canonical.fold(observations), start, end), clients, models)
    return reports.session_report(events).orderBy("first_event", "client", "session_id")


def model_report(observations: DataFrame) -> DataFrame:
    return reports.model_report(canonical.fold(observations)).orderBy("client", "raw_model")


def explain_event(observations: DataFrame, prices: pricing.Catalog, sources: DataFrame, event_id: str) -> DataFrame:
    """One event with its price, sightings and catalog evidence. The filter on the fold's key reaches the scan."""
    event = canonical.fold(observations).where(F.col("event_id") == event_id)
    priced = pricing.price(event, prices)
    records = prices.rates.select("id", "source_ids").unionByName(prices.aliases.select("id", "source_ids")) if "source_ids" in prices.rates.columns else prices.rates.select("id", F.array().cast("array<string>").alias("source_ids"))
    shown = catalog.evidence(priced, records, sources)
    seen = canonical.provenance(observations, event_id).select("client", "event_key", "observations", "duplicates", "sources")
    return priced.join(shown, ["client", "event_key"], "left").join(seen, ["client", "event_key"], "left")


def evidence_report(observations: DataFrame, prices: pricing.Catalog, by: tuple[str, ...] = ("client",), kind: str = "usd", start: object = None, end: object = None) -> DataFrame:
    """What the amounts of a window rest on, for each group."""
    events = canonical.in_window(canonical.fold(observations), start, end)
    return reports.evidence(pricing.price(events, prices), by, kind).orderBy(*by)


def health_report(observations: DataFrame, prices: pricing.Catalog, run: Ingested | None = None, catalogs: DataFrame | None = None) -> DataFrame:
    """The ledger's health: with a run also its warnings and sources, with the rows of catalog_report the catalogs'."""
    events = pricing.price(canonical.fold(observations), prices)
    return coverage.health(observations, pricing.unresolved_models(events), catalog.catalog_issues(prices), run and run.summary, run and run.sources, catalogs)


def catalog_report(spark: SparkSession, path: str, now: str, overrides: DataFrame | None = None, limit: int = verification.COLLECTION_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Of the catalog documents at a path, all in one job, each one's status and all issues.

    Overrides name their document (column document); their issues are among the
    document's, but don't make it invalid.
    """
    records = documents.catalog_records(spark, path)
    issues = written(verification.verify(records, limit), "issues")
    rows = verification.status(records, issues, now)
    if overrides is not None:
        issues = issues.unionAll(verification.override_issues(overrides, records.rates))
    return rows.orderBy(F.desc("published_at"), F.desc("revision"), "document"), issues.orderBy("document", "code", "record_id", "detail")


def catalog_list(spark: SparkSession, path: str) -> DataFrame:
    """Every rate of the documents at a path, as a row."""
    rates = documents.catalog_records(spark, path).rates
    return rates.orderBy("document", "provider", "canonical_model", "kind", "effective_from", "id")


def catalog_changes(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(collection, id, change) between two catalog documents."""
    old, new = (verification.as_document(documents.catalog_records(spark, p), "one") for p in (before, after))
    return verification.record_changes(old, new).drop("document").orderBy("collection", "id")


def catalog_candidates(spark: SparkSession, path: str, active: str, now: str) -> DataFrame:
    """The documents at a path as candidates for the active one: status, and whether each is the same, newer, a downgrade or in conflict."""
    held = documents.catalog_records(spark, active).headers.first()
    rows, _ = catalog_report(spark, path, now)
    if held is None:
        return rows.withColumn("relation", F.lit("newer"))
    return catalog.candidate_relation(rows, held.revision, held.published_at, held.sha256)


def import_exports(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Buckets of provider exports (import_id, value) whose content wasn't imported before (content_digest)."""
    return exports.buckets(_fresh(documents, known))


def import_issues(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(import_id, code) of such exports that give no bucket, or one that can't stand."""
    return exports.import_issues(_fresh(documents, known))


def _fresh(documents: DataFrame, known: DataFrame) -> DataFrame:
    return reconcile.new_imports(documents.withColumn("content_digest", F.sha2("value", 256)), known)


def reconciliation(observations: DataFrame, buckets: DataFrame, zone: str = "UTC", start: str | None = None, end: str | None = None) -> DataFrame:
    """Every bucket's class and every uncovered day, in order."""
    events = written(canonical.in_window(canonical.fold(observations), start, end), "events")
    chosen = reconcile.contained(reconcile.latest_imports(buckets), start, end)
    chosen = chosen if "bucket_id" in chosen.columns else chosen.withColumn("bucket_id", F.sha2(F.to_json(F.struct(*sorted(chosen.columns))), 256))
    rows = reconcile.reconcile(events, chosen)
    alone = reconcile.local_only(events, chosen, zone).withColumnRenamed("provider_name", "provider")
    alone = alone.withColumnsRenamed({c: f"local_{c}" for c in reconcile.COUNTED}).drop("local_day")
    return rows.unionByName(alone, allowMissingColumns=True).orderBy("bucket_start", "provider", "model", reconcile.class_order())


def bill(one_time: DataFrame, plans: DataFrame, attestations: DataFrame, start: str, end: str, providers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Each provider's recorded cash, and all together; without providers stated, all that the evidence names."""
    spark = one_time.sparkSession
    scope = spark.createDataFrame([(p,) for p in providers], "provider string") if providers else one_time.select("provider").union(plans.select("provider")).union(attestations.select("provider")).distinct()
    rows = billing.cash_rollup(one_time, plans, attestations, scope, start, end)
    return rows, billing.billing_status(rows, providers is not None)


def export(report: DataFrame, path: str, form: str, context: dict[str, str] | None = None) -> None:
    """Writes a report as json, csv, csv with its context in every row, or a usage report with evidence as rows or document of fixed columns."""
    if form == "json":
        sinks.write_json(report, path)
    elif form == "csv":
        sinks.write_csv(report, path)
    elif form == "envelope":
        sinks.write_csv(sinks.envelope(report, context or {}), path)
    elif form == "rows":
        sinks.write_csv(sinks.usage_rows(report), path)
    elif form == "document":
        sinks.write_csv(sinks.usage_document(report, {k: v for k, v in (context or {}).items() if k != "coverage_json"}, (context or {}).get("coverage_json", "")), path)
    else:
        raise ValueError(f"no form {form!r}")
