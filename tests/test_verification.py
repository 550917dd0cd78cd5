"""Catalog documents and overrides: every rule, the composed catalog jobs, health and run summary, and an empty period."""

import copy
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_usage import CATALOG, COLUMNS, DAY, event

from usagebook.operators import canonical, coverage, incremental, pricing, reports, verification
from usagebook.plans import jobs
from usagebook.sources import documents


def changed(**parts):
    """The sound catalog with parts put in place of its own; a function gets a copy of the part."""
    out = copy.deepcopy(CATALOG)
    for name, value in parts.items():
        out[name] = value(out[name]) if callable(value) else value
    return out


def first(field, value, at=0):
    """Sets a field of a record."""

    def put(records):
        records[at][field] = value
        return records

    return put


def policy(**fields):
    def put(rates):
        rates[1]["dimension_policies"]["inference_geo"] |= fields
        return rates

    return put


def twice(**fields):
    """Adds a copy of the first record."""
    return lambda records: [*records, records[0] | fields]


def tool(**fields):
    def put(rates):
        rates[0]["tool_rates"]["web_search_requests"] |= fields
        return rates

    return put


BEFORE = "2025-01-01T00:00:00Z"
CASES = {
    "sound": ({}, set()),
    "schema": (dict(schema_version=2), {("schema_version", "", 1)}),
    "revision": (dict(revision=" \t"), {("empty_revision", "", 1)}),
    "verified": (dict(verified_at="2026-07-09T00:00:00Z"), {("verification_before_publication", "", 1)}),
    "window": (dict(stale_after_days=0), {("zero_stale_window", "", 1)}),
    "source_twice": (dict(sources=lambda s: s * 3), {("duplicate_source", "s1", 2)}),
    "url": (dict(sources=first("url", "http://example.com")), {("source_url", "s1", 1)}),
    "no_id": (dict(aliases=first("id", "")), {("empty_record_id", "", 1)}),
    "id_twice": (dict(rates=first("id", "a-fable")), {("duplicate_record_id", "a-fable", 1)}),
    "interval": (dict(aliases=first("effective_to", BEFORE)), {("invalid_effective_interval", "a-fable", 1)}),
    "uncited": (dict(aliases=first("source_ids", [])), {("missing_source", "a-fable", 1)}),
    "cited_wrongly": (dict(aliases=first("source_ids", ["s1", "s9"])), {("unknown_source", "a-fable", 1)}),
    "alias_field": (dict(aliases=first("raw_model", "")), {("empty_alias_field", "a-fable", 1)}),
    "alias_overlap": (dict(aliases=twice(id="a-other")), {("overlapping_alias", "a-fable", 1)}),
    "alias_copy": (dict(aliases=twice()), {("overlapping_alias", "a-fable", 1), ("duplicate_record_id", "a-fable", 1)}),
    "scale": (dict(rates=first("unit_scale", 0)), {("zero_unit_scale", "r-fable", 1)}),
    "tokens": (dict(rates=lambda r: first("max_input_tokens_exclusive", 5)(first("min_input_tokens", 5)(r))), {("invalid_context_interval", "r-fable", 1)}),
    "negative": (dict(rates=first("rates", {"input": "-1"})), {("negative_rate", "r-fable", 1)}),
    "large": (dict(rates=first("rates", {"input": "1000000000.000000001", "output": "1000000000"})), {("rate_magnitude", "r-fable", 1)}),
    "huge": (dict(rates=first("rates", {"input": "9" * 60})), {("rate_magnitude", "r-fable", 1)}),
    "no_number": (dict(rates=first("rates", {"input": "many"})), {("rate_magnitude", "r-fable", 1)}),
    "tool_scale": (dict(rates=tool(per_units=0)), {("zero_tool_scale", "r-fable", 1)}),
    "tool_free": (dict(rates=tool(rate="0")), {("invalid_tool_rate", "r-fable", 1)}),
    "tool_large": (dict(rates=tool(rate="2000000000")), {("tool_rate_magnitude", "r-fable", 1)}),
    "policy_empty": (dict(rates=policy(allowed=[], default=None, aliases={})), {("empty_dimension_policy", "r-geo", 1), ("unreachable_modifier", "m-us", 1)}),
    "policy_twice": (dict(rates=policy(allowed=["us", "global", "us"])), {("duplicate_dimension_value", "r-geo", 1)}),
    "policy_default": (dict(rates=policy(default="moon")), {("invalid_dimension_default", "r-geo", 1)}),
    "policy_alias": (dict(rates=policy(aliases={"eu": "europe", "usa": "us"})), {("invalid_dimension_alias", "r-geo", 1)}),
    "rate_overlap": (dict(rates=twice(id="r-other")), {("overlapping_rate", "r-fable", 1)}),
    "rate_beside": (dict(rates=lambda r: first("max_input_tokens_exclusive", 9)(twice(id="r-other", min_input_tokens=9)(r))), set()),
    "multiplier": (dict(modifiers=first("multiplier", "0")), {("invalid_modifier", "m-us", 1)}),
    "multiplier_large": (dict(modifiers=first("multiplier", "1000000001")), {("modifier_magnitude", "m-us", 1)}),
    "selectors": (dict(modifiers=first("selectors", {})), {("empty_modifier_selector", "m-us", 1)}),
    "orphan": (dict(modifiers=first("canonical_model", "nobody")), {("orphan_modifier", "m-us", 1), ("unreachable_modifier", "m-us", 1)}),
    "too_early": (dict(modifiers=lambda m: first("effective_from", BEFORE)(first("effective_to", "2025-02-01T00:00:00Z")(m))), {("orphan_modifier", "m-us", 1), ("unreachable_modifier", "m-us", 1)}),
    "unreachable": (dict(modifiers=first("selectors", {"inference_geo": "usa"})), {("unreachable_modifier", "m-us", 1)}),
    "stacked": (dict(modifiers=twice(id="m-z")), {("duplicate_modifier", "m-us", 1)}),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A document for each case, and one that is no JSON."""
    out = tmp_path_factory.mktemp("catalogs")
    for name, (parts, _) in CASES.items():
        (out / f"{name}.json").write_text(json.dumps(changed(**parts)))
    (out / "broken.json").write_text("{")
    return out


def test_every_rule_in_one_job(spark, folder):
    rows, issues = jobs.catalog_report(spark, str(folder), "2026-07-20")
    found = {}
    for r in issues.collect():
        found.setdefault(r.document.rsplit("/", 1)[1][:-5], set()).add((r.code, r.record_id, r.n))
    broken = found.pop("broken")
    assert broken == {(c, "", 1) for c in ("schema_version", "empty_revision", "zero_stale_window")}
    assert found == {name: want for name, (_, want) in CASES.items() if want}
    status = {r.document.rsplit("/", 1)[1][:-5]: r for r in rows.collect()}
    assert set(status) == {*CASES, "broken"}
    assert {name for name, r in status.items() if r.valid} == {"sound", "rate_beside"}
    sound = status["sound"]
    assert (sound.revision, sound.freshness, sound.sources, sound.aliases, sound.rates, sound.modifiers, sound.issues) == ("r1", "fresh", 1, 6, 6, 2, 0)
    assert status["window"].freshness == "stale" and status["id_twice"].issues == 1


def test_no_records_and_the_limit(spark, folder):
    records = documents.catalog_records(spark, str(folder / "sound.json"))
    none = verification.Records(*[df.where("1 = 0") for df in (records.headers, records.sources, records.aliases, records.rates, records.modifiers)])
    assert verification.verify(none).count() == 0 and verification.status(none, verification.verify(none), "2026-07-20").count() == 0
    assert {(r.record_id, r.detail) for r in verification.verify(records, limit=5).collect()} == {("aliases", "6"), ("rates", "6")}
    wider = verification.Records(*[df.withColumn("row", F.lit(1)).withColumn("a_id", F.lit("x")) for df in (records.headers, records.sources, records.aliases, records.rates, records.modifiers)])
    assert verification.verify(wider).count() == 0


def test_changes_and_candidates(spark, folder, tmp_path):
    later = changed(revision="r2", published_at="2026-07-15T00:00:00Z", verified_at="2026-07-15T00:00:00Z", aliases=lambda a: a[1:], modifiers=first("multiplier", "1.2"), sources=lambda s: [*s, s[0] | {"id": "s2"}])
    (tmp_path / "later.json").write_text(json.dumps(later))
    (tmp_path / "same.json").write_text(json.dumps(CATALOG))
    (tmp_path / "twisted.json").write_text(json.dumps(changed(stale_after_days=31)))
    got = {tuple(r) for r in jobs.catalog_changes(spark, str(folder / "sound.json"), str(tmp_path / "later.json")).collect()}
    assert got == {("metadata", "revision", "changed"), ("metadata", "published_at", "changed"), ("metadata", "verified_at", "changed"), ("aliases", "a-fable", "removed"), ("modifiers", "m-us", "changed"), ("sources", "s2", "added")}
    rows = jobs.catalog_candidates(spark, str(tmp_path), str(folder / "sound.json"), "2026-07-20").collect()
    assert {r.document.rsplit("/", 1)[1]: r.relation for r in rows} == {"later.json": "newer", "same.json": "current", "twisted.json": "conflict"}
    assert [r.id for r in jobs.catalog_list(spark, str(tmp_path / "same.json")).collect()][:2] == ["r-fable", "r-geo"]


def test_override_rules(spark, folder):
    rates = documents.catalog_records(spark, str(folder / "sound.json")).rates.withColumn("document", F.lit("d"))
    a, b, c = (dt.datetime(2026, m, 1) for m in (2, 3, 4))
    rows = [
        ("d", "ok", "Anthropic", "geo", " Inference_Geo", "USA", a, b), ("d", "next", "anthropic", "geo", "inference_geo", "us", b, c),
        ("d", "blank", "anthropic", "geo", "inference_geo", " ", dt.datetime(2027, 1, 1), dt.datetime(2027, 2, 1)), ("d", "undated", "anthropic", "geo", "inference_geo", "us", None, b),
        ("d", "backwards", "anthropic", "geo", "inference_geo", "us", dt.datetime(2028, 2, 1), dt.datetime(2028, 1, 1)), ("d", "colour", "anthropic", "geo", "colour", "red", a, b),
        ("d", "na", "anthropic", "geo", "inference_geo", "N/A", dt.datetime(2029, 1, 1), dt.datetime(2029, 2, 1)), ("d", "moon", "anthropic", "geo", "inference_geo", "moon", dt.datetime(2030, 1, 1), dt.datetime(2030, 2, 1)),
        ("d", "early", "anthropic", "geo", "inference_geo", "us", dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)), ("d", "same", "openai", "sol", "Service_Tier", "fast", a, b), ("d", "same", "OpenAI", "sol", "service_tier", "fast", a, c),
        ("other", "same", "openai", "sol", "service_tier", "fast", a, b), ("d", None, None, None, None, None, None, None),
    ]
    own = spark.createDataFrame(rows, "document string, id string, provider string, canonical_model string, dimension string, value string, effective_from timestamp, effective_to timestamp")
    got = {(r.document, r.code, r.record_id, r.detail, r.n) for r in verification.override_issues(own, rates).collect()}
    named = {("d", "override_empty_field", "", f, 1) for f in ("id", "provider", "canonical_model", "dimension", "value")}
    assert got == named | {
        ("d", "override_empty_interval", "", "", 1), ("d", "override_empty_field", "blank", "value", 1), ("d", "override_empty_interval", "undated", "", 1), ("d", "override_undocumented", "undated", "", 1),
        ("d", "override_empty_interval", "backwards", "", 1), ("d", "override_unsupported_dimension", "colour", "", 1), ("d", "override_undocumented", "colour", "", 1),
        ("d", "override_unresolved_value", "na", "", 1), ("d", "override_unsupported_value", "moon", "moon", 1), ("d", "override_undocumented", "early", "", 1),
        ("d", "override_duplicate_id", "same", "", 1), ("d", "override_overlap", "same", "same", 1), ("other", "override_undocumented", "same", "", 1),
    }
    assert verification.override_issues(own.where("1 = 0"), rates).count() == 0


def test_health_names_what_needs_attention(spark, folder):
    path = str(folder / "sound.json")
    prices = documents.catalog(spark, path)
    o = spark.createDataFrame([event("fable", uncached=1, key="a"), event("nobody", uncached=1, key="b")], COLUMNS)
    changes = spark.createDataFrame([("s1", "new"), ("s2", "rewritten"), ("s3", "unchanged"), ("s4", "vanished")], "source_id string, state string")
    warned = spark.createDataFrame([("s1", "malformed"), ("s1", "other")], "source_id string, code string")
    summary = incremental.run_summary(changes, o, warned, 3)
    row = summary.first()
    assert (row.discovered, row.scanned, row.unchanged, row.reset, row.incomplete, row.warnings, row.observations, row.status) == (3, 2, 1, 1, 1, 2, 2, "partial")
    sources = spark.createDataFrame([("claude_code", True), ("claude_code", False)], "client string, compressed boolean")
    catalogs = jobs.catalog_report(spark, path, "2027-01-01")[0]
    models = pricing.unresolved_models(pricing.price(canonical.fold(o), prices))
    none = verification.verify(documents.catalog_records(spark, path))
    found = {r.check: (r.status, r.detail) for r in coverage.health(o, models, none, summary, sources, catalogs).collect()}
    assert found["unresolved_models"] == ("attention", "nobody") and found["catalog_issues"] == ("ok", "0")
    assert found["run_warnings"] == ("attention", "2") and found["last_run"] == ("attention", "partial")
    assert found["sources:claude_code"] == ("ok", "2 sources, 1 compressed") and found["sources:openai_codex"] == ("attention", "0 sources, 0 compressed")
    assert found["catalog:r1"] == ("attention", "stale valid") and found["overall"] == ("attention", "3")
    calm = coverage.health(o, models.where("1 = 0"), none, catalogs=catalogs)
    assert {r.check: r.status for r in calm.collect()}["overall"] == "ok"


def test_a_period_without_events_has_a_total(spark, folder):
    o = spark.createDataFrame([event("fable", uncached=5)], COLUMNS)
    prices = documents.catalog(spark, str(folder / "sound.json"))
    (total,) = jobs.cost_report(o, prices, "2020-01-01", "2020-02-01").collect()
    assert (total.grouping, total.requests, total.sessions, total.input_tokens_total, total.usd_status, total.usd_lower, total.client) == (1, 0, 0, 0, "unavailable", None, None)
    whole = reports.cost_report(pricing.price(canonical.fold(o), prices)).collect()
    assert sorted((r.grouping, r.requests) for r in whole) == [(0, 1), (1, 1)] and DAY == dt.datetime(2026, 7, 10)
