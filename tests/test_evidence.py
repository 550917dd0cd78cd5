"""Evidence of amounts, and the fixed columns of usage rows."""

import csv

import pytest
from pyspark.sql import functions as F

from usagebook.operators import pricing, reports
from usagebook.plans import queries
from usagebook.sources import sinks


@pytest.fixture(scope="module")
def priced(spark, sf):
    rows = queries.events(spark, sf).where("event_key like '%1-1' or event_key like '%2-2'")
    return pricing.price(rows, queries.price_catalog(spark)).cache()


def test_evidence_equals_a_plain_list(priced):
    rows = priced.withColumn("said", reports.explained()).collect()
    got = {(r.client, r.model): r for r in reports.evidence(priced, ("client", "model"), most=3).collect()}
    groups = {}
    for r in rows:
        groups.setdefault((r.client, r.canonical_model or r.raw_model), []).append(r)
    assert got.keys() == groups.keys() and len(got) > 3
    for key, own in groups.items():
        r, texts, gone = got[key], [t for x in own for t in x.said], {}
        for m in (m for x in own for m in x.missing):
            gone.setdefault(m.component, []).append(m.quantity)
        assert (r.explanations or []) == sorted(set(texts))[:3] and r.explanation_count == len(texts) and r.omitted_explanation_count == len(texts) - min(3, len(set(texts)))
        assert [(m.kind, m.component, m.quantity) for m in r.missing_components or []] == sorted(("usd", c, None if None in q else sum(q)) for c, q in gone.items())
        assert r.exact_events == sum(x.usd_status == "exact" for x in own) and r.unpriced_events == sum(x.usd_status == "unpriced" for x in own)
    plan = reports.evidence(priced)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan


def test_fixed_columns(priced, tmp_path):
    report = reports.usage_report(priced, ("day", "client"), "UTC", evidence=True)
    rows = sinks.usage_rows(report)
    assert tuple(rows.columns) == sinks.ROW_COLUMNS and len(sinks.ROW_COLUMNS) == 32 and len(sinks.CONTEXT_COLUMNS) == 14
    by = {(r.day, r.client): r for r in rows.collect()}
    for r in report.collect():
        own = by[str(r.day), r.client]
        assert (own.model, own.requests, own.quality) == ("", str(r.requests), r.quality or "")
        assert (own.api_equivalent_usd != "") == (r.usd_status == "exact") and (own.known_api_equivalent_usd != "") == (r.usd_status != "exact" and r.usd_lower is not None)
        assert own.provider_unit_name == ("" if r.credits_status == "unavailable" else "credits") and (own.provider_units_json == "{}") == (r.credits_status != "exact")
    whole = sinks.usage_document(report, {"timezone": "UTC", "catalog_revision": 'r"1'}, '{"coverage": "best"}')
    assert tuple(whole.columns) == (*sinks.CONTEXT_COLUMNS, *sinks.ROW_COLUMNS)
    sinks.write_csv(whole.coalesce(1), str(tmp_path / "d"))
    found = list(csv.DictReader(next((tmp_path / "d").glob("*.csv")).open(newline="")))
    meta = [r for r in found if r["record_type"] == "metadata"]
    assert len(found) == report.count() + 1 and len(meta) == 1 and meta[0]["coverage_json"] == '{"coverage": "best"}' and {r["catalog_revision"] for r in found} == {'r"1'}
    assert all(r["coverage_json"] == "" for r in found if r["record_type"] == "data")
    with pytest.raises(ValueError):
        sinks.usage_document(report, {"zone": "UTC"}, "")
    assert report.where(F.lit(False)).transform(sinks.usage_rows).count() == 0


def test_prices_by_cells_equal_those_by_expressions(spark, sf):
    events = queries.events(spark, sf).where("event_key like '%1-1' or event_key like '%2-2'").cache()
    for overrides in (True, False):
        own = queries.price_catalog(spark, overrides)
        cut = pricing.cells(own)
        one, other = pricing.price(events, own), pricing._by_expressions(events.withColumns({"provider_route": F.lit(None).cast("string"), "speed": F.lit(None).cast("string")}), own)
        names = ["event_key", "usd_status", "usd_lower", "usd_upper", "usd_matches", "missing", "matched_ids", "scenario_count"]
        assert one.select(names).exceptAll(other.select(names)).isEmpty() and other.select(names).exceptAll(one.select(names)).isEmpty()
        assert one.where("usd_status = 'bounded'").count() > 0 and cut.where("_matches > 1").isEmpty()
