"""The composed jobs, from log files to reports."""

import json
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F
from test_usage import CATALOG, EXPORT_B, LOG_A, LOG_B

from usagebook.operators import incremental, quality, reconcile
from usagebook.plans import jobs
from usagebook.sources import common, documents, exports


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    a, b = root / "a" / "projects" / "p", root / "b" / "sessions" / "2026"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    (root / "b" / "archived_sessions").mkdir()
    write = lambda path, log: path.write_text("\n".join(map(json.dumps, log)) + "\n")
    write(a / "s.jsonl", LOG_A[:3])
    own = lambda thread: [LOG_B[0] | {"payload": LOG_B[0]["payload"] | {"id": thread, "session_id": "t1"}}, *LOG_B[1:5]]
    write(b / "rollout-1-01234567-89ab-cdef-0123-456789abcdef.jsonl", own("01234567-89ab-cdef-0123-456789abcdef"))
    write(root / "b" / "archived_sessions" / "rollout-2-01234567-89ab-cdef-0123-456789abcdee.jsonl", own("01234567-89ab-cdef-0123-456789abcdee"))
    return {"claude_code": str(root / "a"), "openai_codex": str(root / "b")}


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("prices") / "prices.json"
    path.write_text(json.dumps(CATALOG))
    return documents.catalog(spark, str(path)), documents.catalog_sources(spark, str(path))


def test_ingest_is_idempotent(spark, logs):
    first = jobs.ingest(spark, logs, 1)
    assert first.observations.count() == 5 and first.summary.first().provisional is False
    sources = first.sources.cache()
    second = jobs.ingest(spark, logs, 2, first.observations, sources)
    assert {r.state for r in second.changes.collect()} == {"unchanged"}
    assert second.observations.exceptAll(first.observations).count() == 0 and second.observations.count() == 5
    limited = jobs.ingest(spark, logs, 3, since="2026-07-10 13:00:02")
    assert limited.observations.count() == 2 and limited.summary.first().provisional is True


def test_unchanged_files_are_not_opened(spark, logs, monkeypatch):
    first = jobs.ingest(spark, logs, 1)
    stored, sources = first.observations.cache(), first.sources.cache()
    assert stored.count() == 5 and {r.status for r in sources.collect()} == {"ok"}
    opened = []
    read = common.file_lines
    for module in jobs.ADAPTERS.values():
        monkeypatch.setattr(module, "file_lines", lambda files: opened.extend(r.path for r in files.collect()) or read(files))
    second = jobs.ingest(spark, logs, 2, stored, sources)
    assert opened == [] and {r.state for r in second.changes.collect()} == {"unchanged"}
    assert second.observations.count() == 5 and second.sources.count() == 3
    jobs.ingest(spark, logs, 3, stored, sources, verify=True)
    assert len(opened) == 3
    last = {r.client: r.run_id for r in incremental.last_successful(first.sources).collect()}
    assert last == {"claude_code": 1, "openai_codex": 1}


def test_ledger_takes_changed_sources_only(spark, tmp_path):
    root, kept = tmp_path / "a" / "projects", str(tmp_path / "ledger")
    root.mkdir(parents=True)
    write = lambda name, log: (root / name).write_text("\n".join(map(json.dumps, log)) + "\n")
    write("s.jsonl", LOG_A[:3])
    write("t.jsonl", LOG_A[:3])
    roots = {"claude_code": str(tmp_path / "a")}
    run = jobs.ingest(spark, roots, 1)
    sources = run.sources.cache()
    sources.count()
    incremental.merge_into_ledger(spark, kept, run.changes, run.fresh)
    many = incremental.ledger(spark, kept).count()
    assert many == jobs.ingest(spark, roots, 9).observations.count() > 0
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "ledger").rglob("*.parquet")}
    write("t.jsonl", [{"type": "summary", "summary": "nothing that counts"}])
    limited = jobs.ingest(spark, roots, 2, incremental.ledger(spark, kept), sources, since="2100-01-01")
    assert limited.observations.count() == many and limited.sources.exceptAll(sources).count() == 0
    run = jobs.ingest(spark, roots, 2, incremental.ledger(spark, kept), sources)
    assert sorted(r.state for r in run.changes.collect()) == ["rewritten", "unchanged"]
    incremental.merge_into_ledger(spark, kept, run.changes, run.fresh)
    whole = jobs.ingest(spark, roots, 3).observations
    found = incremental.ledger(spark, kept).select(whole.columns)
    assert found.exceptAll(whole).count() == 0 and found.count() == whole.count() == many // 2
    assert any(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())  # the other source's folder is as it was


def test_periods(spark, logs, prices):
    seen, now = jobs.ingest(spark, logs, 1).observations.cache(), datetime(2026, 7, 11, 3, tzinfo=UTC)
    total = lambda *a: [r for r in jobs.period_cost_report(seen, prices[0], *a).collect() if r.grouping]
    assert jobs.cost_period("today", "America/New_York", now) == (date(2026, 7, 10), date(2026, 7, 10))
    assert jobs.cost_period("month", "UTC", now) == (date(2026, 7, 1), date(2026, 7, 11))
    assert jobs.local_bounds(date(2026, 3, 29), date(2026, 3, 29), "Europe/Berlin") == (datetime(2026, 3, 28, 23, tzinfo=UTC), datetime(2026, 3, 29, 22, tzinfo=UTC))
    assert total("yesterday", "UTC", now)[0].requests == total("all", "UTC", now)[0].requests == 3
    assert total("all", "UTC", now)[0].first_day == date(2026, 7, 10)
    (nothing,) = total("range", "UTC", now, date(2026, 1, 1), date(2026, 1, 2))  # a period without events has its total too
    assert (nothing.requests, nothing.sessions, nothing.usd_status, nothing.usd_lower, nothing.first_day) == (0, 0, "unavailable", None, date(2026, 1, 1))
    assert jobs.session_report(seen, day=date(2026, 7, 10), clients=["claude_code"]).count() == 1 and jobs.session_report(seen, day=date(2026, 7, 9)).count() == 0
    with pytest.raises(ValueError):
        jobs.cost_period("range", "UTC", now, date(2026, 1, 2), date(2026, 1, 1))


def test_every_export_is_accounted_for(spark):
    csv = 'Bucket Start,bucket-end,PROVIDER,model,request_count,provider_metered_usd\r\n2026-07-10T00:00:00Z,2026-07-11T00:00:00Z,openai,"a ""b"", c",2,\n\n2026-07-11T00:00:00Z,2026-07-12T00:00:00Z,openai,"two\nlines",,1.5\n'
    texts = [csv, json.dumps(EXPORT_B), "{not json", '{"x": 1}', "", "model\n", '{"buckets": [{"amount": {"value": "-1"}}]}']
    files = spark.createDataFrame(list(enumerate(texts)), "import_id long, value string")
    none = spark.createDataFrame([], "content_digest string")
    found = [(r.import_id, r.model, r.request_count, r.provider_metered_usd) for r in jobs.import_exports(files, none).where("import_id = 0").orderBy("bucket_start").collect()]
    assert [(k, m, n, u and float(u)) for k, m, n, u in found] == [(0, 'a "b", c', 2, None), (0, "two\nlines", None, 1.5)]
    assert {(r.import_id, r.code) for r in jobs.import_issues(files, none).collect()} == {(2, "invalid_json"), (3, "unknown_format"), (4, "empty_document"), (5, "no_buckets"), (6, "negative_amount")}
    assert exports.import_issues(files.where("import_id < 2")).count() == 0


def test_reports_from_logs(spark, logs, prices, tmp_path):
    seen = jobs.ingest(spark, logs, 1).observations.cache()
    rows = jobs.usage_report(seen, prices[0], ("day", "model")).collect()
    assert [(r.model, r.requests, r.input_tokens_total) for r in rows] == [("fable", 1, 170), ("gpt-alpha", 2, 160)]
    total = [r for r in jobs.cost_report(seen, prices[0]).collect() if r.grouping][0]
    assert (total.requests, total.sessions, total.usd_status) == (3, 2, "partial")
    assert jobs.session_report(seen).count() == 2 and jobs.model_report(seen).count() == 2
    event = jobs.canonical.fold(seen).where("raw_model = 'fable'").first().event_id
    shown = jobs.explain_event(seen, *prices, event).collect()
    assert len(shown) == 1 and shown[0].observations == 1 and shown[0].evidence[0].record_id == "r-fable"
    health = {r.check: r.detail for r in jobs.health_report(seen, prices[0]).collect()}
    assert health["unresolved_models"] == "gpt-alpha" and health["observations"] == "5"
    for form in ("json", "csv", "envelope"):
        jobs.export(jobs.usage_report(seen, prices[0]), str(tmp_path / form), form, {"zone": "UTC"})
    with pytest.raises(ValueError):
        jobs.export(seen, str(tmp_path / "x"), "xml")
    assert quality.observation_issues(seen).count() == 0


def test_reconciliation_from_exports(spark, logs):
    seen = jobs.ingest(spark, logs, 1).observations
    none = spark.createDataFrame([], "content_digest string")
    export = spark.createDataFrame([(1, json.dumps(EXPORT_B))], "import_id long, value string")
    buckets = jobs.import_exports(export, none)
    again = jobs.import_exports(export, export.select(F.sha2("value", 256).alias("content_digest")))
    assert buckets.count() == 1 and again.count() == 0
    rows = jobs.reconciliation(seen, buckets).collect()
    assert [(r.provider, r.classification) for r in rows] == [("anthropic", "counter_mismatch"), ("openai", "local_only")]
    imports = spark.createDataFrame([(1, "d", None)], "import_id long, content_digest string, imported_at timestamp")
    assert reconcile.with_imports(buckets, imports).first().content_digest == "d"


def test_bill(spark):
    once = spark.createDataFrame([("c", "p", "api_charge", 5)], "id string, provider string, category string, n int").select("id", "provider", "category", F.col("n").cast("decimal(18,6)").alias("amount_usd"), F.lit("2026-01-05").cast("timestamp").alias("charged_at"), F.lit("2026-01-06").cast("timestamp").alias("attested_at"))
    plans = spark.createDataFrame([], documents.RECURRING)
    attest = spark.createDataFrame([], documents.COMPLETENESS)
    rows, status = jobs.bill(once, plans, attest, "2026-01-01", "2026-02-01")
    assert rows.first().recorded_cash_usd == 5 and status.first().status == "open_provider_scope"
    assert jobs.bill(once, plans, attest, "2026-01-01", "2026-02-01", ["p", "q"])[1].first().status == "incomplete_evidence"


def test_drift_hides_the_keys(spark):
    rows = spark.createDataFrame([('{"a": 1, "secret": 2}',), ('{"secret": 1}',), ('{"a": 1}',), ("nope",)], "text string")
    got = quality.drift(rows, ["a"]).collect()
    assert [(r.records, r.unknown_keys) for r in got] == [(2, 1)] and "secret" not in got[0].fingerprint
