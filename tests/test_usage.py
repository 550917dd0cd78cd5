"""Operators of the accounting on small hand-made inputs."""

import datetime as dt
import hashlib
import json
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from usagebook.functions import ids, values
from usagebook.operators import billing, canonical, catalog, coverage, incremental, ordered, pricing, reconcile, reports
from usagebook.plans import views
from usagebook.sources import common, documents, exports, log_a, log_b, sinks
from usagebook.streaming import logs

DAY = dt.datetime(2026, 7, 10)


def interval(start="2026-01-01T00:00:00Z", end=None):
    return {"effective_from": start, "effective_to": end}


def rate(name, model, numbers, provider="anthropic", kind="usd_api_equivalent", **more):
    keys = ("input", "cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "output")
    return {"id": name, "provider": provider, "canonical_model": model, "kind": kind, "unit_scale": 1000000, **interval(), "rates": dict(zip(keys, numbers, strict=True)), "tool_rates": {}, "dimension_policies": {}, "source_ids": ["s1"], **more}


GEO = {"inference_geo": {"allowed": ["global", "us"], "default": "global", "aliases": {"usa": "us"}}}
TIER = {"service_tier": {"allowed": ["standard", "fast"], "default": "standard", "aliases": {}}}
TOOLS = {"web_search_requests": {"rate": "10", "per_units": 1000, "explicit_free": False}, "web_fetch_requests": {"rate": "0", "per_units": 1, "explicit_free": True}}
CATALOG = {
    "schema_version": 1, "revision": "r1", "published_at": "2026-07-10T00:00:00Z", "verified_at": "2026-07-10T00:00:00Z", "stale_after_days": 30,
    "sources": [{"id": "s1", "title": "t", "url": "https://example.com", "retrieved_at": "2026-07-10T00:00:00Z", "note": ""}],
    "aliases": [{"id": f"a-{raw}", "provider": p, "raw_model": raw, "canonical_model": c, **interval(), "source_ids": ["s1"]} for p, raw, c in (("anthropic", "fable", "fable"), ("anthropic", "geo", "geo"), ("openai", "sol", "sol"), ("openai", "sol-latest", "sol"), ("openai", "capped", "capped"), ("openai", "tiny", "tiny"))],
    "rates": [
        rate("r-fable", "fable", ("10", "1", "12.5", "12.5", "20", "50"), tool_rates=TOOLS),
        rate("r-geo", "geo", ("10", "1", "12.5", "12.5", "20", "50"), dimension_policies=GEO),
        rate("r-sol", "sol", ("5", "0.5", "6.25", None, None, "30"), "openai", cache_write_observation_required=True),
        rate("c-sol", "sol", ("125", "12.5", None, None, None, "750"), "openai", "codex_credits", dimension_policies=TIER),
        rate("r-capped", "capped", ("5", "0.5", "6.25", None, None, "30"), "openai", max_input_tokens_exclusive=272000),
        rate("r-tiny", "tiny", ("2.5", "0", None, None, None, "15"), "openai"),
    ],
    "modifiers": [
        {"id": "m-us", "provider": "anthropic", "canonical_model": "geo", "kind": "usd_api_equivalent", **interval(), "selectors": {"inference_geo": "us"}, "multiplier": "1.1", "scope": "token_rates", "source_ids": ["s1"]},
        {"id": "m-fast", "provider": "openai", "canonical_model": "sol", "kind": "codex_credits", **interval(), "selectors": {"service_tier": "fast"}, "multiplier": "2.5", "scope": "token_rates", "source_ids": ["s1"]},
    ],
}


@pytest.fixture(scope="module")
def document(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "prices.json"
    path.write_text(json.dumps(CATALOG))
    return str(path)


COLUMNS = "client string, event_key string, session_id string, provider string, raw_model string, occurred_at timestamp, auth_mode string, auth_mode_provenance string, service_tier string, inference_geo string, cache_write_data_complete boolean, input_subset_accounting_consistent boolean, coverage string, quality_rank int, warning string, source_id string, line_number long, " + ", ".join(f"{c} long" for c in values.COUNTERS)


def event(model, provider="anthropic", client=None, when=DAY, auth="chatgpt", provenance="source_observed", tier=None, geo=None, complete=True, consistent=True, uncached=0, cached=0, unknown=0, w5=0, w1=0, out=0, search=0, fetch=0, total=None, key="k"):
    client = client or ("openai_codex" if provider == "openai" else "claude_code")
    counters = (uncached + cached + unknown + w5 + w1 if total is None else total, uncached, cached, w5, w1, unknown, out, 0, search, fetch)
    return (client, key, "s", provider, model, when, auth, provenance, tier, geo, complete, consistent, "complete", 3, None, "f", 1, *counters)


def priced(spark, document, *events, overrides=None):
    return pricing.price(spark.createDataFrame(list(events), COLUMNS), documents.catalog(spark, document, overrides)).collect()


M = 1_000_000


def test_golden_prices(spark, document):
    d = Decimal
    cases = [
        (event("fable", uncached=M, cached=M, w5=M, w1=M, out=M, search=1000, fetch=3), "exact", d("103.5"), d("103.5"), "unavailable", None),
        (event("sol", "openai", uncached=M, cached=M, out=M), "exact", d("35.5"), d("35.5"), "bounded", d("887.5")),
        (event("sol", "openai", uncached=M, cached=M, out=M, tier="standard"), "exact", d("35.5"), d("35.5"), "exact", d("887.5")),
        (event("sol-latest", "openai", uncached=M, cached=M, unknown=M, out=M, tier="standard"), "exact", d("41.75"), d("41.75"), "exact", d("1012.5")),
        (event("sol", "openai", uncached=M, cached=M, complete=None, tier="standard"), "bounded", d("5.5"), d("6.75"), "exact", d("137.5")),
        (event("sol", "openai", uncached=M, cached=M, complete=None, consistent=False, tier="standard"), "partial", d("5.5"), None, "exact", d("137.5")),
        (event("sol", "openai", uncached=M, auth="chatgpt", provenance="current_profile_inferred", tier="standard"), "exact", d("5"), d("5"), "bounded", d("0")),
        (event("sol", "openai", uncached=M, cached=M, out=M, tier="fast"), "exact", d("35.5"), d("35.5"), "exact", d("2218.75")),
        (event("sol", "openai", uncached=M, auth="OPENAI_API_KEY"), "exact", d("5"), d("5"), "unavailable", None),
        (event("capped", "openai", uncached=272000), "unpriced", None, None, "unpriced", None),
        (event("capped", "openai", uncached=271999), "exact", d("1.359995"), d("1.359995"), "unpriced", None),
        (event("tiny", "openai", uncached=1), "exact", d("0.0000025"), d("0.0000025"), "unpriced", None),
        (event("tiny", "openai", cached=7, unknown=5), "partial", None, None, "unpriced", None),
        (event("geo", uncached=M, out=M), "bounded", d("60"), d("66"), "unavailable", None),
        (event("geo", uncached=M, out=M, geo="USA"), "exact", d("66"), d("66"), "unavailable", None),
        (event("geo", uncached=M, out=M, geo="moon"), "unpriced", None, None, "unavailable", None),
        (event("fable"), "exact", d("0"), d("0"), "unavailable", None),
        (event("nobody", uncached=5), "unpriced", None, None, "unavailable", None),
        (event("fable", when=dt.datetime(2025, 1, 1), uncached=5), "unpriced", None, None, "unavailable", None),
    ]
    keyed = [(*e[:1], f"k{k:02d}", *e[2:]) for k, (e, *_) in enumerate(cases)]
    for r, (_, *want) in zip(sorted(priced(spark, document, *keyed), key=lambda r: r.event_key), cases, strict=True):
        assert [r.usd_status, r.usd_lower, r.usd_upper, r.credits_status, r.credits_lower] == want, r


def test_overrides_hold_in_their_interval(spark, document):
    own = spark.createDataFrame([("o1", "Anthropic", "geo", "inference_geo", "global", dt.datetime(2026, 7, 1), dt.datetime(2026, 8, 1))], "id string, provider string, canonical_model string, dimension string, value string, effective_from timestamp, effective_to timestamp")
    rows = priced(spark, document, event("geo", uncached=M, out=M, key="in"), event("geo", uncached=M, out=M, when=dt.datetime(2026, 8, 1), key="out"), overrides=own)
    got = {r.event_key: (r.usd_status, r.usd_lower, r.usd_upper) for r in rows}
    assert got == {"in": ("exact", Decimal(60), Decimal(60)), "out": ("bounded", Decimal(60), Decimal(66))}
    assert catalog.override_issues(own, documents.catalog(spark, document)).count() == 0


def test_group_bounds_add_up(spark, document):
    events = spark.createDataFrame([event("geo", uncached=M, out=M, key="a"), event("sol", "openai", uncached=M, cached=M, complete=None, tier="standard", key="b")], COLUMNS).withColumns({"event_id": F.col("event_key"), "warnings": F.array(F.lit("w"))})
    out = reports.usage_summary(pricing.price(events, documents.catalog(spark, document))).first()
    assert (out.requests, out.sessions, out.usd_status, out.usd_lower, out.usd_upper) == (2, 2, "bounded", Decimal("65.5"), Decimal("72.75"))
    rows = reports.usage_report(pricing.price(events, documents.catalog(spark, document)), ("model", "session"), evidence=True).collect()
    assert {tuple(r.event_ids) for r in rows} == {("a",), ("b",)}
    with pytest.raises(ValueError):
        reports.usage_report(events, ("colour",))


def test_catalog_checks(spark, document):
    known = documents.catalog(spark, document)
    assert catalog.catalog_issues(known).count() == 0 and catalog.catalog_overlaps(known).count() == 0
    double = pricing.Catalog(known.aliases.unionAll(known.aliases.withColumn("id", F.concat("id", F.lit("-2")))), known.rates, known.policies, known.modifiers)
    assert {r.code for r in catalog.catalog_overlaps(double).collect()} == {"overlapping_alias"}
    assert pricing.price(spark.createDataFrame([event("fable", uncached=5)], COLUMNS), double).first().usd_status == "unpriced"
    status = catalog.catalog_status(known, "r1", "2026-07-10", 30, "2026-09-01").first()
    assert (status.freshness, status.rates, status.issues) == ("stale", 6, 0)
    revisions = spark.createDataFrame([("r0", dt.datetime(2026, 6, 1), "x"), ("r1", dt.datetime(2026, 7, 10), "y"), ("r1", dt.datetime(2026, 7, 10), "z")], "revision string, published_at timestamp, sha256 string")
    assert catalog.previous_revision(revisions, "2026-07-10", "r1").first().revision == "r0"
    assert catalog.chosen_revision(revisions, "r1").first().selection == "ambiguous"
    assert {r.sha256: r.relation for r in catalog.candidate_relation(revisions, "r1", "2026-07-10", "y").collect()} == {"x": "downgrade", "y": "current", "z": "conflict"}
    rows = pricing.price(spark.createDataFrame([event("fable", uncached=5)], COLUMNS), known)
    found = catalog.evidence(rows, known.rates, documents.catalog_sources(spark, document)).first().evidence
    assert [(e.record_id, e.url) for e in found] == [("r-fable", "https://example.com")]


LOG_A = [
    {"type": "user", "timestamp": "2026-07-10T12:00:00Z", "message": {"content": "PRIVATE-CANARY"}},
    {"type": "assistant", "timestamp": "2026-07-10T13:00:05Z", "sessionId": "s", "message": {"id": "m1", "model": "fable", "content": "PRIVATE-CANARY", "usage": {"input_tokens": 100, "cache_read_input_tokens": 40, "cache_creation_input_tokens": 30, "output_tokens": 20, "cache_creation": {"ephemeral_5m_input_tokens": 20, "ephemeral_1h_input_tokens": 10}, "server_tool_use": {"web_search_requests": 1, "web_fetch_requests": 1}}}},
    {"type": "assistant", "timestamp": "2026-07-10T13:00:00Z", "sessionId": "s", "message": {"id": "m1", "model": "fable", "usage": {"input_tokens": 100, "cache_read_input_tokens": 40, "output_tokens": 25}}},
    {"type": "assistant", "sessionId": "s", "message": {"id": "m2", "usage": {"input_tokens": 1}}},
    {"type": "assistant", "timestamp": "yesterday", "message": {"id": "m3", "usage": {"input_tokens": 1}}},
    {"type": "assistant", "timestamp": "2026-07-10T13:00:00Z", "message": {"id": "m4"}},
    {"type": "assistant", "timestamp": "2026-07-10T13:00:00Z", "message": {"id": "m5", "usage": {}}},
    {"type": "assistant", "timestamp": "2026-07-10T13:00:00Z", "message": {"id": "m6", "usage": {"input_tokens": 1.5, "output_tokens": 2}}},
]


def test_log_a(spark, tmp_path):
    folder = tmp_path / "projects" / "p" / "session" / "subagents"
    folder.mkdir(parents=True)
    (folder / "x.JSONL").write_text("\n".join([*map(json.dumps, LOG_A), "{broken", ""]) + json.dumps(LOG_A[1]))
    files, seen, warnings = log_a.read(spark, str(tmp_path))
    rows = sorted(seen.collect(), key=lambda r: r.line_number)
    r = rows[0]
    assert (r.input_tokens_uncached, r.input_tokens_cached, r.cache_write_5m_tokens, r.cache_write_1h_tokens, r.cache_write_unknown_tokens, r.input_tokens_total, r.output_tokens_total) == (100, 40, 20, 10, 0, 170, 25)
    assert (r.web_search_requests, r.web_fetch_requests, r.occurred_at) == (1, 1, dt.datetime(2026, 7, 10, 13))
    assert len(rows) == 2 and rows[1].warning == "invalid_counter" and rows[1].coverage == "partial"
    codes = sorted(w.code for w in warnings.collect())
    assert codes == sorted(["claude_missing_timestamp", "claude_invalid_timestamp", "claude_missing_usage", "claude_empty_usage", "claude_malformed_record", "incomplete_tail"])
    seen.write.parquet(str(tmp_path / "out"))
    assert not any(b"PRIVATE-CANARY" in p.read_bytes() for p in (tmp_path / "out").iterdir())
    assert common.sources(files, log_a.CLIENT).count() == 1


def count_line(at, *totals, time=True):
    names = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
    return {"timestamp": f"2026-07-10T13:00:{at:02d}Z" if time else "never", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": dict(zip(names, totals, strict=True))}}}


LOG_B = [
    {"timestamp": "2026-07-10T13:00:00Z", "type": "session_meta", "payload": {"id": "t1", "cli_version": "0.9", "model_provider": "openai", "auth_mode": "chatgpt"}},
    {"timestamp": "2026-07-10T13:00:00Z", "type": "turn_context", "payload": {"model": "gpt-alpha", "service_tier": "fast"}},
    count_line(1, 100, 20, 10, 4),
    count_line(2, 100, 20, 10, 4),
    count_line(3, 160, 50, 25, 7),
    {"timestamp": "2026-07-10T13:00:04Z", "type": "turn_context", "payload": {"model": "gpt-beta", "service_tier": None}},
    count_line(5, 220, 70, 35, 9),
    count_line(6, 10, 2, 1, 0),
    {"type": "event_msg", "payload": {}}, {"type": "novel"}, {"payload": {}}, {"type": "response_item"},
]


def b_lines(spark, *files):
    return spark.createDataFrame([(name, k + 1, x if isinstance(x, str) else json.dumps(x)) for name, log in files for k, x in enumerate(log)], "source_id string, line_number long, text string").withColumn("path", F.col("source_id"))


def test_log_b(spark):
    seen, warnings = log_b.observations(b_lines(spark, ("f1", LOG_B), ("f2", LOG_B[:5]), ("bad", ["{"])))
    rows = sorted((r for r in seen.collect() if r.source_id == "f1"), key=lambda r: r.line_number)
    assert [(r.raw_model, r.input_tokens_total, r.input_tokens_cached, r.input_tokens_uncached, r.output_tokens_total, r.reasoning_output_tokens) for r in rows] == [("gpt-alpha", 100, 20, 80, 10, 4), ("gpt-alpha", 60, 30, 30, 15, 3), ("gpt-beta", 60, 20, 40, 10, 2), ("gpt-beta", 10, 2, 8, 1, 0)]
    assert [r.service_tier for r in rows] == ["fast", "fast", None, None] and {r.auth_mode for r in rows} == {"chatgpt"}
    assert sorted(w.code for w in warnings.collect()) == sorted(["codex_missing_event_type", "codex_unknown_record_type", "codex_missing_record_type", "codex_counter_reset", "codex_malformed_record"])
    copies = canonical.fold(seen).where("copies = 2").collect()
    assert len(copies) == 2  # the forked file repeats two events


def test_a_line_without_a_time_keeps_the_baseline(spark):
    seen, warnings = log_b.observations(b_lines(spark, ("f", [*LOG_B[:3], count_line(3, 130, 30, 15, 5, time=False), count_line(4, 160, 50, 25, 7)])))
    assert sorted((r.line_number, r.input_tokens_total) for r in seen.collect()) == [(3, 100), (5, 60)]
    assert [w.code for w in warnings.collect()] == ["codex_invalid_usage_timestamp"]


def test_profiles_are_marked_as_inferred(spark):
    """A profile belongs to the folder above the nearest one of logs, so nested roots give one row; what a line states, even nothing, ends the inference."""
    log = [{"type": "session_meta", "payload": {"id": "t"}}, *LOG_B[1:3]]
    cleared = [*log, {"type": "turn_context", "payload": {"auth_mode": None}}, count_line(7, 170, 50, 25, 7)]
    profiles = spark.createDataFrame([("/h", "chatgpt"), ("/h/sessions/x", "apikey"), ("/other", "apikey"), ("/h/sessions/x", "apikey"), ("/h", " ")], "root string, auth_mode string")
    lines = b_lines(spark, ("f1", log), ("f2", cleared), ("f3", log)).withColumn("path", F.when(F.col("source_id") == "f3", "/h/archived_sessions/a.jsonl").otherwise("/h/sessions/x/Sessions/y/b.jsonl"))
    seen = log_b.observations(lines, profiles)[0]
    got = sorted((r.source_id, r.line_number, r.auth_mode, r.auth_mode_provenance, "auth_mode_inferred_from_current_profile" in r.notes) for r in seen.collect())
    assert got == [("f1", 3, "apikey", "current_profile_inferred", True), ("f2", 3, "apikey", "current_profile_inferred", True), ("f2", 5, None, None, False), ("f3", 3, "chatgpt", "current_profile_inferred", True)]
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_plain_files_replace_compressed_ones(spark):
    files = spark.createDataFrame([("a/rollout-1.jsonl",), ("a/rollout-1.jsonl.zst",), ("a/rollout-2.jsonl.zst",)], "path string")
    assert sorted(r.path for r in common.prefer_plain(files).collect()) == ["a/rollout-1.jsonl", "a/rollout-2.jsonl.zst"]


def test_ids_equal_their_definition(spark):
    parts = [("a", "bé"), ("", "x" * 300), ("日本", "")]
    got = spark.createDataFrame(parts, "a string, b string").select("a", "b", ids.stable_id(F.col("a"), F.col("b")).alias("id")).collect()
    for r in got:
        raw = b"".join(struct.pack("<Q", len(p.encode())) + p.encode() for p in (r.a, r.b))
        assert r.id == "evt_" + hashlib.sha256(raw).hexdigest()[:24]


def test_day_bounds(spark):
    frame = spark.createDataFrame([("2026-03-08", "America/New_York", 23), ("2026-11-01", "America/New_York", 25), ("2018-11-04", "America/Sao_Paulo", 23)], "d string, z string, hours int")
    for r in frame.collect():
        start, end = values.day_bounds(F.lit(r.d).cast("date"), F.lit(r.d).cast("date"), r.z)
        got = spark.range(1).select(((end.cast("long") - start.cast("long")) / 3600).alias("h")).first().h
        assert got == r.hours


def test_value_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(values.money_text(F.lit("0.1250005").cast("decimal(20,9)"))) == "0.125" and one(values.money_text(F.lit("0.1250015").cast("decimal(20,9)"))) == "0.125002"
    assert one(values.rfc3339(F.lit("2026-07-10"))) is None and one(values.flexible_instant(F.lit("0"))) == dt.datetime(1970, 1, 1)
    assert one(values.resolved(F.lit(" N/A "))) is None and one(values.provider_name(F.lit("Open-AI"))) == "openai"
    assert one(values.sanitised(F.lit("a b"))) == "redacted" and one(values.is_api_key(F.lit("Api-Key"))) is True


EXPORT_A = {"object": "page", "has_more": False, "data": [{"start_time": 1783641600, "end_time": 1783728000, "results": [{"model": "sol", "input_tokens": 120, "input_cached_tokens": 20, "output_tokens": 7, "num_model_requests": 2, "project_id": "CANARY"}]}]}
EXPORT_B = {"has_more": False, "data": [{"starting_at": "2026-07-10T00:00:00Z", "ending_at": "2026-07-11T00:00:00Z", "model": "fable", "uncached_input_tokens": "10", "cache_read_input_tokens": "20", "cache_creation": {"ephemeral_5m_input_tokens": "3", "ephemeral_1h_input_tokens": "4"}, "output_tokens": "5", "inference_geo": "global"}]}
EXPORT_C = {"schema_version": 1, "source_kind": "own", "buckets": [{"bucket_start": "2026-07-10T00:00:00Z", "bucket_end": "2026-07-11T00:00:00Z", "provider": "Anthropic", "model": None, "request_count": 0, "amount": {"value": "1.5", "currency": "usd"}}]}


def test_exports(spark, tmp_path):
    files = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate((EXPORT_A, EXPORT_B, EXPORT_C))], "import_id long, value string")
    a, b, c = sorted(exports.buckets(files).collect(), key=lambda r: r.import_id)
    assert (a.input_tokens_uncached, a.input_tokens_cached, a.output_tokens, a.request_count) == (100, 20, 7, 2)
    assert (b.input_tokens_uncached, b.input_tokens_cached, b.cache_write_5m_tokens, b.cache_write_1h_tokens, b.output_tokens, b.inference_geo) == (10, 20, 3, 4, 5, "global")
    assert (c.provider, c.model, c.request_count, c.provider_metered_usd) == ("anthropic", None, 0, Decimal("1.5"))
    assert reconcile.bucket_issues(exports.buckets(files)).count() == 0
    (tmp_path / "b.csv").write_text("Bucket Start,bucket-end,PROVIDER,model,request_count,output_tokens,source_kind\n2026-07-10T00:00:00Z,2026-07-11T00:00:00Z,openai,sol,2,,own\n")
    row = exports.canonical_csv(spark, str(tmp_path / "b.csv")).first()
    assert (row.bucket_start, row.request_count, row.output_tokens) == (DAY, 2, None)


def test_reconciliation_classes(spark):
    names = "bucket_id string, source_kind string, provider string, model string, bucket_start timestamp, bucket_end timestamp, request_count long, input_tokens_uncached long, provider_metered_usd decimal(18,6), inference_geo string"
    end = DAY + dt.timedelta(days=1)
    rows = [("match", "k", "anthropic", "FABLE", DAY, end, 1, 5, None, "us"), ("off", "k", "anthropic", "fable", DAY, end, 1, 6, None, "us"), ("route", "k", "anthropic", "fable", DAY, end, 1, 5, None, None), ("cost", "k", "anthropic", "fable", DAY, end, None, None, Decimal(1), None), ("zero", "k", "openai", "sol", DAY, end, 0, 0, None, None), ("gone", "k", "openai", "sol", DAY, end, 3, None, None, None), ("edge", "k", "anthropic", "fable", DAY - dt.timedelta(days=1), DAY, 1, 5, None, None)]
    events = spark.createDataFrame([event("fable", uncached=5, geo="us", key="a", when=DAY)], COLUMNS)
    buckets = spark.createDataFrame(rows, names)
    got = {r.bucket_id: r.classification for r in reconcile.reconcile(events, buckets).collect()}
    assert got == {"match": "matched", "off": "counter_mismatch", "route": "route_unknown", "cost": "route_unknown", "zero": "matched", "gone": "provider_only", "edge": "time_boundary"}
    assert reconcile.local_only(events, buckets.where("bucket_id in ('cost', 'edge')"), "UTC").count() == 1
    assert reconcile.contained(buckets, str(DAY), str(end)).count() == 6


def test_billing(spark):
    plans = spark.createDataFrame([("r", "p", Decimal(20), "monthly", dt.datetime(2024, 1, 31, 9), None)], "id string, provider string, amount_usd decimal(18,6), cadence string, effective_from timestamp, effective_to timestamp")
    got = sorted(r.charged_at for r in billing.recurring_charges(plans, "2024-01-01", "2024-04-01").collect())
    assert got == [dt.datetime(2024, 1, 31, 9), dt.datetime(2024, 2, 29, 9), dt.datetime(2024, 3, 31, 9)]
    once = spark.createDataFrame([("c", "p", "refund", Decimal(-5), dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 2))], documents.ONE_TIME.replace(", source_note string", ""))
    attest = spark.createDataFrame([("t1", "p", dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1), dt.datetime(2024, 5, 1)), ("t2", "p", dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 1), dt.datetime(2024, 5, 1))], "id string, provider string, effective_from timestamp, effective_to timestamp, attested_at timestamp")
    scope = spark.createDataFrame([("p",), ("q",)], "provider string")
    rows = billing.cash_rollup(once, plans, attest, scope, "2024-01-01", "2024-04-01")
    p, q = sorted(rows.collect(), key=lambda r: r.provider)
    assert (p.recorded_cash_usd, p.actual_billed_usd, p.charges, p.by_category["refund"]) == (Decimal(55), Decimal(55), 4, Decimal(-5))
    assert (q.recorded_cash_usd, q.actual_billed_usd) == (Decimal(0), None)
    assert billing.billing_status(rows, True).first().status == "incomplete_evidence" and billing.billing_status(rows, False).first().actual_billed_usd is None
    assert billing.billing_issues(once, plans, attest).count() == 0


def test_incremental_ingest(spark):
    schema = "source_id string, file_size long, content_hash string"
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w")], schema)
    now = spark.createDataFrame([("a", 1, "x"), ("b", 5, "yy"), ("c", 2, "q"), ("e", 1, "n")], schema)
    changes = incremental.source_changes(now, stored)
    assert {r.source_id: r.state for r in changes.collect()} == {"a": "unchanged", "b": "appended", "c": "rewritten", "d": "vanished", "e": "new"}
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "source_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("e", 2)], "source_id string, v int")
    assert {(r.source_id, r.v) for r in incremental.replaced(old, changes, new).collect()} == {("a", 1), ("d", 1), ("b", 2), ("c", 2), ("e", 2)}
    assert incremental.run_summary(changes, new, new.where("1 = 0"), 7).first().provisional is False
    again = incremental.source_changes(now, now)
    assert {r.state for r in again.collect()} == {"unchanged"}


def test_coverage_and_health(spark, document, sf):
    o = spark.createDataFrame([event("fable", uncached=1, key="a")], COLUMNS)
    e = canonical.fold(o)
    cover = coverage.client_coverage(o, e)
    assert {r.client: r.window_status for r in cover.collect()} == {"claude_code": "observed_window", "openai_codex": "no_sources"}
    states = {r.client: r.status for r in coverage.query_coverage(cover, e, "2026-07-01", "2026-08-01").collect()}
    assert states == {"claude_code": "matching_events", "openai_codex": "no_sources"}
    known = documents.catalog(spark, document)
    lines = {r.check: r.status for r in coverage.health(o, pricing.unresolved_models(pricing.price(e, known)), catalog.catalog_issues(known)).collect()}
    assert lines["unresolved_models"] == "ok" and lines["catalog_issues"] == "ok"
    runs = spark.createDataFrame([(1, DAY), (2, None), (3, DAY)], "run_id long, completed_at timestamp")
    warned = spark.createDataFrame([(1, "f", "old"), (2, "f", "fresh_one"), (2, None, "Bad Code!")], "run_id long, source_id string, code string")
    counts = {(r.client, r.code): r.n for r in coverage.warning_counts(warned, spark.createDataFrame([("f", "claude_code")], "source_id string, client string")).collect()}
    assert counts == {("claude_code", "fresh_one"): 1, (None, "unrecognised"): 1}
    assert [r.run_id for r in coverage.latest_runs(runs).orderBy("age").collect()] == [3, 1]


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([(1, ["a", "b"], {"k": 1.5})], "n int, tags array<string>, more map<string, double>")
    sinks.write_csv(report, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()
    assert json.loads(back.tags) == ["a", "b"] and json.loads(back.more) == {"k": 1.5}
    sinks.write_json(report, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().tags == ["a", "b"]
    kinds = [r.record_type for r in sinks.envelope(report, {"zone": "UTC"}).orderBy(F.desc("record_type")).collect()]
    assert kinds == ["metadata", "data"]
    assert sinks.document({"schema": "v1"}, rows=report).first().rows[0].n == 1


def test_stream_deltas_resume(spark, tmp_path):
    source, schema = tmp_path / "in", "source_id string, line_number long, input_tokens long, output_tokens long"
    source.mkdir()
    batches = [[("s", 1, 10, 1), ("s", 2, 25, 2)], [("s", 3, 5, 1), ("t", 1, 7, 0), ("s", 2, 25, 2)], [("s", 4, 9, 1)]]
    got = []
    for k, batch in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("source_id", "line_number", "input_tokens", "output_tokens"), r, strict=True))) for r in batch))
        stream = logs.stream_deltas(spark.readStream.schema(schema).json(str(source)))
        run = stream.writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert sorted((r.source_id, r.line_number, r.delta_input, r.epoch) for r in got) == [("s", 1, 10, 0), ("s", 2, 15, 0), ("s", 3, 5, 1), ("s", 4, 4, 1), ("t", 1, 7, 0)]


def test_streamed_daily_usage_equals_batch(spark, tmp_path, sf):
    rows = views.view(spark, sf, views.OBSERVATIONS).select("client", "event_key", "raw_model", "occurred_at", "input_tokens_total", "output_tokens_total").dropDuplicates(["client", "event_key"])
    rows.coalesce(3).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = logs.daily_usage(spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in")), "America/New_York", "100000 days")
    stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start().awaitTermination()
    want = stored.groupBy(values.local_date(F.col("occurred_at"), "America/New_York").alias("day"), "client", "raw_model").agg(F.count("*").alias("requests"), F.sum("input_tokens_total").alias("input_tokens_total"), F.sum("output_tokens_total").alias("output_tokens_total"))
    got = spark.table("daily").select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    single = logs.without_repeats(spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in")))
    single.writeStream.outputMode("append").format("memory").queryName("single").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("single").count() == stored.count()


def test_first_warning_per_key(spark):
    rows = spark.createDataFrame([("f", "k", 3), ("f", "k", 1), ("f", "j", 2)], "source_id string, code string, line_number long")
    assert sorted((r.code, r.line_number) for r in ordered.once_per_key(rows, ["source_id", "code"]).collect()) == [("j", 2), ("k", 1)]


def test_records_of_log_a_are_parsed_once(spark):
    rows = spark.createDataFrame([("s", "p", 1, "{}")], "source_id string, path string, line_number long, text string")
    for out in log_a.observations(rows):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_copies_of_events_move_once(spark, sf):
    """The fold has one exchange, of the copies as they are, though it counts distinct sources."""
    plan = canonical.fold(views.view(spark, sf, views.OBSERVATIONS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(client") == 1 and plan.count("Exchange ") == 1


def test_events_are_matched_with_buckets_once(spark, sf):
    """What meets its bucket is stored: the plan reads the events only for what is left."""
    from usagebook.plans import queries

    e, b = queries.both_sides(spark, sf)
    plan = reconcile.reconcile(e, b)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x and "occurred_at" in x for x in plan.splitlines()) == 1


def test_amounts_in_whole_numbers_equal_decimals(spark, sf, monkeypatch):
    """Scenarios written out as columns, and those of amounts beyond whole numbers, give what the walk over scenarios does; no generated method stays interpreted."""
    from usagebook.plans import queries

    grown = {c: F.when(F.crc32("event_key") % 5 == 0, F.col(c) * 10**13).otherwise(F.col(c)) for c in ("input_tokens_total", "input_tokens_uncached", "output_tokens_total")}
    events = queries.events(spark, sf).where("event_key like '%-1' and event_key not like '%5-1'").withColumns(grown).cache()
    found = lambda: sorted(repr(r) for r in pricing.price(events, queries.price_catalog(spark)).drop("warnings").collect())
    written_out = found()
    monkeypatch.setattr(pricing, "WRITTEN_OUT", 0)
    assert len(written_out) > 500 and written_out == found()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_scenarios_are_rows_that_events_meet(spark, sf, monkeypatch):
    """Scenarios come from the catalog's cells by a join, not from each event's own dimensions; rows of both ways are the same, also of amounts beyond whole numbers and of none."""
    from usagebook.plans import queries

    plan = queries.scenario_expansion(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "Generate explode(flatten" not in plan
    grown = {c: F.when(F.crc32("event_key") % 5 == 0, F.col(c) * 10**13).when(F.crc32("event_key") % 5 == 1, F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("input_tokens_total", "input_tokens_uncached", "cache_write_unknown_tokens")}
    events = queries.events(spark, sf).where("event_key like '%-1' and event_key not like '%5-1'").withColumns(grown).cache()
    for kind in pricing.KINDS:
        found = lambda: sorted(repr(r) for r in pricing.scenarios(events, queries.price_catalog(spark), kind).collect())  # noqa: B023, E731
        rows = found()
        with monkeypatch.context() as m:
            m.setattr(pricing, "_held", lambda cut: {"most": pricing.MAX_SCENARIOS + 1, "all": 1})
            assert len(rows) > 100 and rows == found()
