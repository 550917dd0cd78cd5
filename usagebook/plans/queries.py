"""Named queries over the test tables, and their SQL.

Instants are given in microseconds, amounts in whole billionths, days and lists
as text, so that engines agree on types.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagebook.functions.ids import stable_id
from usagebook.functions.tables import shared_dir, written
from usagebook.functions.values import COUNTERS, local_date, nano
from usagebook.operators import billing, canonical, catalog, coverage, incremental, ledger, ordered, pricing, quality, reconcile, reports
from usagebook.plans import catalogs as C
from usagebook.plans import oracle as O
from usagebook.plans import views as V
from usagebook.sources import common, log_a, log_b

ZONE = "America/New_York"
QUERIES: dict = dict(C.QUERIES)
ORACLE_SQL: dict[str, str] = dict(C.ORACLE_SQL)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def us(c: str | Column) -> Column:
    return F.unix_micros(c)


def observations(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.OBSERVATIONS)


def events(spark: SparkSession, d: str) -> DataFrame:
    return canonical.fold(observations(spark, d))


def price_catalog(spark: SparkSession, overrides: bool = True) -> pricing.Catalog:
    none = F.expr("cast(map() as map<string, string>)")
    modifiers = V.view(spark, "", V.MODIFIERS).withColumn("selectors", F.create_map("dimension", "value")).drop("dimension", "value")
    policies = V.view(spark, "", V.POLICIES).select("rate_id", "dimension", F.array("allowed_a", "allowed_b").alias("allowed"), "default_value", none.alias("value_aliases"))
    return pricing.Catalog(V.view(spark, "", V.ALIASES), V.view(spark, "", V.RATES).drop("dims", "default_geo", "default_tier"), policies, modifiers, V.view(spark, "", V.OVERRIDES) if overrides else None)


def priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price(events(spark, d), price_catalog(spark))


def nanos(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({f"{n}_{x}": nano(F.col(f"{n}_{x}")) for n in names for x in ("lower", "upper")})


_FOLD = ["client", "event_key", *COUNTERS, "quality_rank", "coverage", "source_count", "copies"]


@query("canonical_fold", f"{O.EVENTS} SELECT {', '.join(_FOLD)}, epoch_us(occurred_at) AS at_us FROM canonical")
def canonical_fold(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(*_FOLD, us("occurred_at").alias("at_us"))


_BEST = ["client", "event_key", "source_id", "line_number", "raw_model", "session_id", "coverage", "quality_rank", "input_tokens_total", "output_tokens_total"]


@query("canonical_best_copy", f"WITH {O.OBS}, {O.RANKED} SELECT {', '.join(_BEST)} FROM ranked WHERE place = 1")
def canonical_best_copy(spark: SparkSession, d: str) -> DataFrame:
    return canonical.ranked_copies(observations(spark, d)).where("place = 1").select(*_BEST)


_GROWN = ", ".join(f"{c} // 3 AS {c}" for c in COUNTERS)


@query("ledger_merge", f"""WITH {O.OBS}, r AS (SELECT client, source_id, event_key, occurred_at, coverage, quality_rank, {", ".join(COUNTERS)} FROM obs WHERE line_number % 3 <> 0
  UNION ALL SELECT client, source_id, event_key, occurred_at + INTERVAL 1 HOUR, 'partial', quality_rank, {_GROWN} FROM obs),
g AS (SELECT client, source_id, event_key, min(occurred_at) AS seen_at, max(CASE coverage WHEN 'unavailable' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END) AS cov, max(quality_rank) AS quality_rank, {", ".join(f"max({c}) AS {c}" for c in COUNTERS)},
  greatest(max(cache_write_5m_tokens + cache_write_1h_tokens + cache_write_unknown_tokens), max(cache_write_5m_tokens) + max(cache_write_1h_tokens)) AS w FROM r GROUP BY ALL)
SELECT client, source_id, event_key, epoch_us(seen_at) AS at_us, quality_rank, CASE cov WHEN 0 THEN 'unavailable' WHEN 1 THEN 'partial' ELSE 'complete' END AS coverage,
  CASE client WHEN 'claude_code' THEN input_tokens_uncached + input_tokens_cached + w ELSE input_tokens_total END AS input_tokens_total, CASE client WHEN 'claude_code' THEN input_tokens_uncached ELSE greatest(input_tokens_total - input_tokens_cached - w, 0) END AS input_tokens_uncached,
  input_tokens_cached, cache_write_5m_tokens, cache_write_1h_tokens, w - cache_write_5m_tokens - cache_write_1h_tokens AS cache_write_unknown_tokens, output_tokens_total, reasoning_output_tokens, web_search_requests, web_fetch_requests FROM g""")
def ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two runs into one ledger: all events half grown, then most of them as they ended."""
    seen, path = observations(spark, d), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    early = seen.withColumns({c: F.expr(f"{c} div 3") for c in COUNTERS} | {"coverage": F.lit("partial"), "occurred_at": F.expr("occurred_at + interval 1 hour")})
    born = written(seen.groupBy("source_id").agg(F.to_date(F.date_trunc("month", F.min("occurred_at"))).alias("born")), "born")
    for run, rows in enumerate((early, seen.where("line_number % 3 <> 0")), 1):
        ledger.merge(spark, path, rows, born, run)
    return ledger.read(spark, path).select("client", "source_id", "event_key", us("occurred_at").alias("at_us"), "quality_rank", "coverage", *COUNTERS)


@query("warning_union", f"{O.EVENTS} SELECT client, event_key, warnings FROM canonical WHERE warnings <> ''")
def warning_union(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("size(warnings) > 0").select("client", "event_key", F.array_join("warnings", ",").alias("warnings"))


@query("event_window", f"{O.EVENTS} SELECT client, event_key, epoch_us(occurred_at) AS at_us FROM canonical WHERE occurred_at >= timestamp '1995-03-01 05:00:00' AND occurred_at < timestamp '1995-04-01 05:00:00'")
def event_window(spark: SparkSession, d: str) -> DataFrame:
    return canonical.in_window(events(spark, d), "1995-03-01 05:00:00", "1995-04-01 05:00:00").select("client", "event_key", us("occurred_at").alias("at_us"))


def _usage(df: DataFrame) -> DataFrame:
    out = nanos(df, "usd", "credits").drop(*[f"{n}_{s}_events" for n in ("usd", "credits") for s in ("exact", "bounded", "partial", "unpriced", "unavailable")])
    return out.withColumn("day", F.col("day").cast("string")) if "day" in out.columns else out


@query("usage_by_day_model_client", f"{O.PRICED} SELECT CAST({O.local_day(ZONE)} AS VARCHAR) AS day, client, coalesce(canonical_model, raw_model) AS model, {O.USAGE} FROM final GROUP BY 1, 2, 3")
def usage_by_day_model_client(spark: SparkSession, d: str) -> DataFrame:
    return _usage(reports.usage_report(priced(spark, d), ("day", "client", "model"), ZONE))


@query("usage_by_day", f"{O.PRICED} SELECT CAST({O.local_day(ZONE)} AS VARCHAR) AS day, {O.USAGE} FROM final GROUP BY 1")
def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    return _usage(reports.usage_report(priced(spark, d), ("day",), ZONE))


@query("usage_by_model", f"{O.PRICED} SELECT coalesce(canonical_model, raw_model) AS model, {O.USAGE} FROM final GROUP BY 1")
def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    return _usage(reports.usage_report(priced(spark, d), ("model",), ZONE))


@query("usage_summary", f"{O.PRICED} SELECT {O.USAGE} FROM final")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return _usage(reports.usage_summary(priced(spark, d)))


@query("usage_filtered", f"{O.PRICED} SELECT client, coalesce(canonical_model, raw_model) AS model, {O.USAGE} FROM final WHERE client = 'claude_code' AND (lower(raw_model) IN ('aspen', 'm-r') OR coalesce(lower(canonical_model) IN ('aspen', 'm-r'), false)) GROUP BY 1, 2")
def usage_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _usage(reports.usage_report(reports.report_filter(priced(spark, d), ["claude_code"], ["ASPEN", "M-r"]), ("client", "model"), ZONE))


@query("session_rollup", f"{O.EVENTS} SELECT client, session_id, epoch_us(min(occurred_at)) AS first_us, epoch_us(max(occurred_at)) AS last_us, count(*) AS requests, string_agg(DISTINCT raw_model, ',' ORDER BY raw_model) AS models, CAST(sum(input_tokens_total) AS BIGINT) AS input_tokens_total, CAST(sum(output_tokens_total) AS BIGINT) AS output_tokens_total FROM canonical GROUP BY client, session_id")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.session_report(events(spark, d)).select("client", "session_id", us("first_event").alias("first_us"), us("last_event").alias("last_us"), "requests", F.array_join("models", ",").alias("models"), "input_tokens_total", "output_tokens_total")


@query("model_rollup", f"{O.EVENTS} SELECT client, raw_model, count(*) AS events, {O.SUMS} FROM canonical GROUP BY client, raw_model")
def model_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.model_report(events(spark, d))


@query("alias_temporal_join", f"{O.EVENTS}, {O.CAT}, {O.RESOLVED} SELECT client, event_key, canonical_model, alias_id FROM ev")
def alias_temporal_join(spark: SparkSession, d: str) -> DataFrame:
    return pricing.resolve_models(events(spark, d), price_catalog(spark).aliases).select("client", "event_key", "canonical_model", "alias_id")


@query("rate_temporal_range_join", f"{O.PRICED} SELECT e.client, e.event_key, CAST((SELECT count(*) FROM rated_usd r WHERE r.client = e.client AND r.event_key = e.event_key) AS INTEGER) AS usd_matches, CAST((SELECT count(*) FROM rated_credits r WHERE r.client = e.client AND r.event_key = e.event_key) AS INTEGER) AS credits_matches FROM ev e")
def rate_temporal_range_join(spark: SparkSession, d: str) -> DataFrame:
    return pricing.with_rates(events(spark, d), price_catalog(spark)).select("client", "event_key", "usd_matches", "credits_matches")


@query("scenario_expansion", f"{O.PRICED} SELECT client, event_key, val AS choice, status, CAST(known AS BIGINT) AS known, CAST(upper AS BIGINT) AS upper FROM scen_usd")
def scenario_expansion(spark: SparkSession, d: str) -> DataFrame:
    rows = pricing.scenarios(events(spark, d), price_catalog(spark))
    return rows.select("client", "event_key", F.coalesce(F.get(F.map_values("dimensions"), F.lit(0)), F.lit("-")).alias("choice"), "status", nano(F.col("known")).alias("known"), nano(F.col("upper")).alias("upper"))


@query("modifier_product", f"{O.EVENTS}, {O.CAT}, {O.RESOLVED}, {O._kind('usd')} SELECT g.client, g.event_key, g.val AS choice, coalesce(string_agg(m.id, ',' ORDER BY m.id), '') AS modifiers FROM grown_usd g LEFT JOIN modifiers m ON m.kind = 'usd' AND m.provider = g.rp AND m.canonical_model = g.canonical_model AND m.dimension = g.dims AND m.value = g.val AND m.effective_from <= g.occurred_at AND (m.effective_to IS NULL OR g.occurred_at < m.effective_to) GROUP BY 1, 2, 3")
def modifier_product(spark: SparkSession, d: str) -> DataFrame:
    rows = pricing.scenarios(events(spark, d), price_catalog(spark))
    return rows.select("client", "event_key", F.coalesce(F.get(F.map_values("dimensions"), F.lit(0)), F.lit("-")).alias("choice"), F.array_join(F.array_sort("modifier_ids"), ",").alias("modifiers"))


@query("override_lookup", f"{O.PRICED} SELECT client, event_key, attested FROM rated_usd WHERE attested IS NOT NULL")
def override_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = pricing.with_rates(events(spark, d), price_catalog(spark)).where("_rate_usd is not null")
    return rows.withColumn("attested", F.expr("get(filter(transform(_rate_usd.policies, p -> try_element_at(_override, p.dimension)), x -> x is not null), 0)")).where("attested is not null").select("client", "event_key", "attested")


@query("event_estimate", f"{O.PRICED} SELECT client, event_key, canonical_model, usd_status, CAST(usd_lower AS BIGINT) AS usd_lower, CAST(usd_upper AS BIGINT) AS usd_upper, credits_status, CAST(credits_lower AS BIGINT) AS credits_lower, CAST(credits_upper AS BIGINT) AS credits_upper, legacy_status, CAST(scenario_count AS INTEGER) AS scenario_count FROM final")
def event_estimate(spark: SparkSession, d: str) -> DataFrame:
    return nanos(priced(spark, d), "usd", "credits").select("client", "event_key", "canonical_model", "usd_status", "usd_lower", "usd_upper", "credits_status", "credits_lower", "credits_upper", "legacy_status", "scenario_count")


@query("measure_rollup", f"{O.PRICED} SELECT client, {O.measure('usd')}, {O.measure('credits')} FROM final GROUP BY client")
def measure_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.usage_report(priced(spark, d), ("client",), ZONE)
    return nanos(rows, "usd", "credits").select("client", *[f"{n}_{x}" for n in ("usd", "credits") for x in ("status", "lower", "upper")])


@query("provider_units", f"{O.PRICED} SELECT client, 'credits' AS unit, count(*) AS expected, count(*) FILTER (WHERE credits_status = 'exact') AS exact_events, CAST(CASE WHEN count(*) = count(*) FILTER (WHERE credits_status = 'exact') THEN sum(credits_lower) END AS BIGINT) AS exact_units, CAST(CASE WHEN count(*) > count(*) FILTER (WHERE credits_status = 'exact') AND sum(credits_lower) <> 0 THEN sum(credits_lower) END AS BIGINT) AS known_units FROM final WHERE credits_status <> 'unavailable' GROUP BY client")
def provider_units(spark: SparkSession, d: str) -> DataFrame:
    return reports.provider_units(priced(spark, d)).withColumns({c: nano(F.col(c)) for c in ("exact_units", "known_units")})


_COST = f"count(*) AS requests, count(DISTINCT client || '|' || session_id) AS sessions, {O.SUMS}, {O.measure('usd')}, {O.measure('credits')}"


@query("cost_by_model_with_total", f"{O.PRICED} SELECT client, lower(trim(provider)) AS provider_name, coalesce(canonical_model, raw_model) AS model, 0 AS grouping, {_COST} FROM final GROUP BY 1, 2, 3 UNION ALL SELECT NULL, NULL, NULL, 1, {_COST} FROM final")
def cost_by_model_with_total(spark: SparkSession, d: str) -> DataFrame:
    out = nanos(reports.cost_report(priced(spark, d)), "usd", "credits")
    return out.drop(*[f"{n}_{s}_events" for n in ("usd", "credits") for s in ("exact", "bounded", "partial", "unpriced", "unavailable")])


@query("missing_components", f"""{O.PRICED}, gone AS (SELECT s.client, s.event_key, s.need, r.* EXCLUDE (client, event_key) FROM scen_usd s JOIN rated_usd r USING (client, event_key) WHERE s.is_default)
SELECT 'usd' AS kind, component, count(*) AS events, CAST(CASE WHEN count(quantity) = count(*) THEN sum(quantity) END AS BIGINT) AS quantity FROM (
  SELECT 'cache_write_unknown' AS component, cache_write_unknown_tokens AS quantity FROM gone WHERE cache_write IS NULL AND cache_write_unknown_tokens > 0
  UNION ALL SELECT 'web_fetch_requests', web_fetch_requests FROM gone WHERE web_fetch IS NULL AND web_fetch_requests > 0
  UNION ALL SELECT 'cache_write_observation', NULL FROM gone WHERE need = 1) m GROUP BY component""")
def missing_components(spark: SparkSession, d: str) -> DataFrame:
    return reports.missing_components(priced(spark, d))


_GONE = """gone AS (SELECT s.client, s.event_key, s.need, r.* EXCLUDE (client, event_key) FROM scen_usd s JOIN rated_usd r USING (client, event_key) WHERE s.is_default),
miss AS (SELECT client, event_key, 'cache_write_unknown' AS component, cache_write_unknown_tokens AS quantity FROM gone WHERE cache_write IS NULL AND cache_write_unknown_tokens > 0
  UNION ALL SELECT client, event_key, 'web_fetch_requests', web_fetch_requests FROM gone WHERE web_fetch IS NULL AND web_fetch_requests > 0 UNION ALL SELECT client, event_key, 'cache_write_observation', NULL FROM gone WHERE need = 1)"""
_USED = " UNION ALL ".join(f"SELECT client, event_key, '{n}' AS component FROM final WHERE usd_status <> 'unpriced' AND {q} > 0" for n, q in [(n, q) for n, q, _ in pricing.TOKENS] + [(q, q) for q, _ in pricing.TOOLS])


@query("cost_evidence", f"""{O.PRICED}, {_GONE}, used AS ({_USED}),
said AS (SELECT client, 'no price in effect' AS t FROM final WHERE usd_status = 'unpriced' UNION ALL SELECT client, component || ': summed over events' FROM used u WHERE NOT EXISTS (SELECT 1 FROM miss m WHERE m.client = u.client AND m.event_key = u.event_key AND m.component = u.component)
  UNION ALL SELECT f.client, 'cache writes not reported: bounded by the input counter' FROM final f JOIN miss m USING (client, event_key) WHERE f.usd_status = 'bounded' AND m.component = 'cache_write_observation'
  UNION ALL SELECT client, component || ': ' || CASE component WHEN 'cache_write_observation' THEN 'not_observed' ELSE 'no_rate' END FROM miss),
parts AS (SELECT client, component || '=' || coalesce(CAST(CASE WHEN count(quantity) = count(*) THEN sum(quantity) END AS VARCHAR), '?') AS part FROM miss GROUP BY client, component)
SELECT client, count(*) FILTER (WHERE usd_status = 'exact') AS exact_events, count(*) FILTER (WHERE usd_status = 'bounded') AS bounded_events, count(*) FILTER (WHERE usd_status = 'partial') AS partial_events, count(*) FILTER (WHERE usd_status = 'unpriced') AS unpriced_events,
  (SELECT count(*) FROM said s WHERE s.client = f.client) AS explanation_count, (SELECT string_agg(DISTINCT t, '|' ORDER BY t) FROM said s WHERE s.client = f.client) AS explanations, coalesce((SELECT string_agg(part, '|' ORDER BY part) FROM parts p WHERE p.client = f.client), '') AS missing
FROM final f GROUP BY client""")
def cost_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.evidence(priced(spark, d))
    gaps = F.transform(F.coalesce("missing_components", F.expr("cast(array() as array<struct<kind: string, component: string, reason: string, quantity: bigint>>)")), lambda m: F.concat(m["component"], F.lit("="), F.coalesce(m["quantity"].cast("string"), F.lit("?"))))
    return rows.select("client", "exact_events", "bounded_events", "partial_events", "unpriced_events", F.col("explanation_count").cast("long").alias("explanation_count"), F.array_join("explanations", "|").alias("explanations"), F.array_join(gaps, "|").alias("missing"))


@query("unresolved_models", f"{O.PRICED} SELECT DISTINCT client, raw_model FROM final f WHERE NOT EXISTS (SELECT 1 FROM rated_usd r WHERE r.client = f.client AND r.event_key = f.event_key) AND NOT EXISTS (SELECT 1 FROM rated_credits r WHERE r.client = f.client AND r.event_key = f.event_key) ORDER BY 1, 2 LIMIT 20")
def unresolved_models(spark: SparkSession, d: str) -> DataFrame:
    return pricing.unresolved_models(priced(spark, d))


@query("counter_delta", f"""{O.LOG}, b AS (SELECT *, lag(input_tokens) OVER w AS pi, lag(cached_tokens) OVER w AS pc, lag(output_tokens) OVER w AS po FROM log WINDOW w AS (PARTITION BY source_id ORDER BY line_number)),
r AS (SELECT *, CASE WHEN input_tokens < pi OR cached_tokens < pc OR output_tokens < po THEN 1 ELSE 0 END AS reset FROM b),
x AS (SELECT *, CASE WHEN reset = 1 THEN input_tokens ELSE input_tokens - coalesce(pi, 0) END AS di, CASE WHEN reset = 1 THEN cached_tokens ELSE cached_tokens - coalesce(pc, 0) END AS dc, CASE WHEN reset = 1 THEN output_tokens ELSE output_tokens - coalesce(po, 0) END AS dout FROM r)
SELECT source_id, CAST(line_number AS BIGINT) AS line_number, CAST(di AS BIGINT) AS delta_input, CAST(dc AS BIGINT) AS delta_cached, CAST(dout AS BIGINT) AS delta_output, CAST(sum(reset) OVER (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch,
  CASE WHEN di > 0 OR dc > 0 OR dout > 0 THEN CAST(sum(CASE WHEN di > 0 OR dc > 0 OR dout > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS ordinal FROM x""")
def counter_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.counter_deltas(V.view(spark, d, V.COUNTER_LOG))
    return rows.select("source_id", F.col("line_number").cast("long").alias("line_number"), F.col("delta_input_tokens").cast("long").alias("delta_input"), F.col("delta_cached_tokens").cast("long").alias("delta_cached"), F.col("delta_output_tokens").cast("long").alias("delta_output"), F.col("epoch").cast("long").alias("epoch"), F.col("ordinal").cast("long").alias("ordinal"))


@query("context_carry_forward", f"""{O.LOG} SELECT source_id, CAST(line_number AS BIGINT) AS line_number, last_value(model_mark IGNORE NULLS) OVER w AS model,
  (SELECT l.tier_mark FROM log l WHERE l.source_id = log.source_id AND l.line_number = (SELECT max(k.line_number) FROM log k WHERE k.source_id = log.source_id AND k.line_number <= log.line_number AND k.tier_set = 1)) AS tier
FROM log WINDOW w AS (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING)""")
def context_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.carried(V.view(spark, d, V.COUNTER_LOG), {"model_mark": None, "tier_mark": "tier_set"})
    return rows.select("source_id", F.col("line_number").cast("long").alias("line_number"), F.col("model_mark").alias("model"), F.col("tier_mark").alias("tier"))


def _text_a(spark: SparkSession, d: str) -> DataFrame:
    """Client A's observations as the JSON lines of its logs; some lines are cut, some lack a time."""
    o = observations(spark, d).where("client = 'claude_code'").withColumn("line_number", F.row_number().over(Window.partitionBy("source_id").orderBy("line_number", "input_tokens_cached", "output_tokens_total", "input_tokens_total")).cast("long"))
    usage = F.struct(F.col("input_tokens_uncached").alias("input_tokens"), F.col("input_tokens_cached").alias("cache_read_input_tokens"), F.col("output_tokens_total").alias("output_tokens"), F.struct(F.col("cache_write_5m_tokens").alias("ephemeral_5m_input_tokens"), F.col("cache_write_1h_tokens").alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    time = F.when(F.col("input_tokens_cached") % 17 > 0, F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    record = F.to_json(F.struct(F.when(F.col("input_tokens_cached") % 19 > 0, "assistant").otherwise("user").alias("type"), time.alias("timestamp"), F.col("session_id").alias("sessionId"), F.struct(F.col("event_key").alias("id"), F.col("raw_model").alias("model"), usage.alias("usage"), F.lit("private words").alias("content")).alias("message")))
    return o.withColumn("text", F.when(F.col("input_tokens_cached") % 23 > 0, record).otherwise(F.substring(record, 1, 40)))


@query("json_log_a_parse", f"""WITH {O.OBS}, a AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_number, input_tokens_cached, output_tokens_total, input_tokens_total) AS n FROM obs WHERE client = 'claude_code'),
g AS (SELECT * FROM a WHERE input_tokens_cached % 17 > 0 AND input_tokens_cached % 19 > 0 AND input_tokens_cached % 23 > 0)
SELECT source_id, CAST(min(n) AS BIGINT) AS line_number, epoch_us(min(occurred_at)) AS at_us, max(input_tokens_uncached) AS input_tokens_uncached, max(input_tokens_cached) AS input_tokens_cached, max(cache_write_5m_tokens) AS cache_write_5m_tokens, max(cache_write_1h_tokens) AS cache_write_1h_tokens, max(output_tokens_total) AS output_tokens_total,
  max(input_tokens_uncached) + max(input_tokens_cached) + max(cache_write_5m_tokens) + max(cache_write_1h_tokens) AS input_tokens_total, min_by(raw_model, n) AS raw_model FROM g GROUP BY source_id, event_key""")
def json_log_a_parse(spark: SparkSession, d: str) -> DataFrame:
    seen, _ = log_a.observations(common.lines_of(_text_a(spark, d), "text"))
    return seen.select("source_id", "line_number", us("occurred_at").alias("at_us"), "input_tokens_uncached", "input_tokens_cached", "cache_write_5m_tokens", "cache_write_1h_tokens", "output_tokens_total", "input_tokens_total", "raw_model")


@query("json_log_a_warnings", f"""WITH {O.OBS}, a AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_number, input_tokens_cached, output_tokens_total, input_tokens_total) AS n FROM obs WHERE client = 'claude_code')
SELECT source_id, CAST(n AS BIGINT) AS line_number, CASE WHEN input_tokens_cached % 23 = 0 THEN 'claude_malformed_record' ELSE 'claude_missing_timestamp' END AS code FROM a WHERE input_tokens_cached % 23 = 0 OR (input_tokens_cached % 19 > 0 AND input_tokens_cached % 17 = 0)""")
def json_log_a_warnings(spark: SparkSession, d: str) -> DataFrame:
    return log_a.observations(common.lines_of(_text_a(spark, d), "text"))[1]


def _text_b(spark: SparkSession, d: str) -> DataFrame:
    """The counter log as the JSON lines of client B's logs: a context line where a model is set, then a count."""
    log = V.view(spark, d, V.COUNTER_LOG)
    stamp = F.date_format(F.timestamp_micros("occurred_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    context = F.when(F.col("model_mark").isNotNull(), F.to_json(F.struct(stamp.alias("timestamp"), F.lit("turn_context").alias("type"), F.struct(F.col("model_mark").alias("model")).alias("payload"))))
    totals = F.struct(F.col("input_tokens").cast("long").alias("input_tokens"), F.col("cached_tokens").cast("long").alias("cached_input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"))
    count = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(totals.alias("total_token_usage")).alias("info")).alias("payload")))
    rows = log.select("source_id", "line_number", F.posexplode(F.array_compact(F.array(context, count))).alias("k", "text"))
    return rows.select("source_id", (F.col("line_number") * 2 + F.col("k")).cast("long").alias("line_number"), "text")


@query("json_log_b_parse", f"""{O.LOG}, b AS (SELECT *, last_value(model_mark IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS model, lag(input_tokens) OVER w AS pi, lag(cached_tokens) OVER w AS pc, lag(output_tokens) OVER w AS po FROM log WINDOW w AS (PARTITION BY source_id ORDER BY line_number)),
r AS (SELECT *, coalesce(input_tokens < pi OR cached_tokens < pc OR output_tokens < po, false) AS reset FROM b),
x AS (SELECT *, CASE WHEN reset THEN input_tokens ELSE input_tokens - coalesce(pi, 0) END AS di, CASE WHEN reset THEN cached_tokens ELSE cached_tokens - coalesce(pc, 0) END AS dc, CASE WHEN reset THEN output_tokens ELSE output_tokens - coalesce(po, 0) END AS dout FROM r)
SELECT source_id, CAST(line_number * 2 + CASE WHEN model_mark IS NULL THEN 0 ELSE 1 END AS BIGINT) AS line_number, CAST(occurred_at AS BIGINT) AS at_us, model AS raw_model, CAST(di AS BIGINT) AS input_tokens_total, CAST(dc AS BIGINT) AS input_tokens_cached, CAST(greatest(di - dc, 0) AS BIGINT) AS input_tokens_uncached, CAST(dout AS BIGINT) AS output_tokens_total FROM x WHERE di > 0 OR dc > 0 OR dout > 0""")
def json_log_b_parse(spark: SparkSession, d: str) -> DataFrame:
    seen, _ = log_b.observations(common.lines_of(_text_b(spark, d), "text"))
    return seen.select("source_id", "line_number", us("occurred_at").alias("at_us"), "raw_model", "input_tokens_total", "input_tokens_cached", "input_tokens_uncached", "output_tokens_total")


def _text_b_reported(spark: SparkSession, d: str) -> DataFrame:
    """Client B's logs with all counters, of which lines report some and leave out others; some lines are cut, some hold a counter as text, an unknown field or a context window that is no number."""
    n, long = F.col("line_number"), lambda e: F.expr(e).cast("long")
    log = V.view(spark, d, V.COUNTER_LOG)
    stamp = F.date_format(F.timestamp_micros("occurred_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    context = F.when(F.col("model_mark").isNotNull(), F.to_json(F.struct(stamp.alias("timestamp"), F.lit("turn_context").alias("type"), F.struct(F.col("model_mark").alias("model")).alias("payload"))))
    given = {
        "input_tokens": F.when(n % 29 > 0, long("input_tokens")), "cached_input_tokens": F.when(n % 7 > 0, long("cached_tokens")), "output_tokens": long("output_tokens"), "reasoning_output_tokens": F.when(n % 5 > 0, long("floor(output_tokens / 2) + floor(cached_tokens / 9)")),
        "total_tokens": F.when(n % 3 > 0, long("input_tokens + output_tokens + if(line_number % 11 = 0, 5, 0)")), "cache_write_5m_tokens": F.when(~(n % 13).isin(4, 5), long("floor(cached_tokens / 3)")),
        "cache_creation_1h_input_tokens": F.when((n % 13).isin(5, 6, 7), long("floor(cached_tokens / 5)")), "cache_write_tokens": F.when(n % 4 != 1, long("floor(input_tokens / 10)")), "beta_tokens": F.when(n % 19 == 0, F.lit(1)),
    }
    info = F.struct(F.struct(*[v.alias(k) for k, v in given.items()]).alias("total_token_usage"), F.when(n % 23 == 0, "wide").alias("model_context_window"))
    count = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))
    rows = log.select("source_id", "line_number", F.posexplode(F.array_compact(F.array(context, F.when(n % 31 > 0, count).otherwise(F.substring(count, 1, 40))))).alias("k", "text"))
    return rows.select("source_id", (n * 2 + F.col("k")).cast("long").alias("line_number"), "text")


_REPORTED = f"""{O.LOG}, g AS (SELECT source_id, line_number AS n, CAST(line_number * 2 + CASE WHEN model_mark IS NULL THEN 0 ELSE 1 END AS BIGINT) AS line_number, line_number % 31 > 0 AS whole, line_number % 29 > 0 AS sound,
    last_value(model_mark IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS model, CAST(input_tokens AS BIGINT) AS i, CAST(output_tokens AS BIGINT) AS o,
    CASE WHEN line_number % 7 > 0 THEN CAST(cached_tokens AS BIGINT) END AS c, CASE WHEN line_number % 5 > 0 THEN CAST(output_tokens // 2 + cached_tokens // 9 AS BIGINT) END AS r,
    CASE WHEN line_number % 3 > 0 THEN CAST(input_tokens + output_tokens + CASE WHEN line_number % 11 = 0 THEN 5 ELSE 0 END AS BIGINT) ELSE CAST(input_tokens + output_tokens AS BIGINT) END AS t,
    CASE WHEN line_number % 13 NOT IN (4, 5) THEN CAST(cached_tokens // 3 AS BIGINT) END AS w5, CASE WHEN line_number % 13 IN (5, 6, 7) THEN CAST(cached_tokens // 5 AS BIGINT) END AS w1, CASE WHEN line_number % 4 <> 1 THEN CAST(input_tokens // 10 AS BIGINT) END AS w FROM log),
s AS (SELECT source_id, n, line_number, model, i, o, t, c IS NOT NULL AS kc, r IS NOT NULL AS kr, coalesce(w5, w1, w) IS NOT NULL AS kw, coalesce(c, 0) AS c, coalesce(r, 0) AS r, coalesce(w5, 0) AS w5, coalesce(w1, 0) AS w1, CASE WHEN coalesce(w5, w1) IS NULL THEN coalesce(w, 0) ELSE 0 END AS wo FROM g WHERE whole AND sound),
b AS (SELECT *, lag(ROW(i, o, t, c, r, w5, w1, wo)) OVER v AS was, ROW(i, o, t, c, r, w5, w1, wo) AS now_is, {", ".join(f"lag({x}) OVER v AS p_{x}" for x in ("i", "o", "t", "c", "r", "w5", "w1", "wo", "kc", "kr", "kw"))} FROM s WINDOW v AS (PARTITION BY source_id ORDER BY n)),
f AS (SELECT *, coalesce(i < p_i OR o < p_o OR t < p_t OR c < p_c OR r < p_r OR (kw AND p_kw AND (w5 < p_w5 OR w1 < p_w1 OR wo < p_wo)), false) AS reset FROM b),
h AS (SELECT *, p_i IS NULL OR reset AS fresh, coalesce(was = now_is, false) AS same FROM f),
x AS (SELECT *, {", ".join(f"CASE WHEN fresh THEN {x} ELSE {x} - p_{x} END AS d_{x}" for x in ("i", "o", "t"))}, {", ".join(f"CASE WHEN fresh THEN {x} WHEN {k} AND p_{k} THEN {x} - p_{x} ELSE 0 END AS d_{x}" for x, k in (("c", "kc"), ("r", "kr"), ("w5", "kw"), ("w1", "kw"), ("wo", "kw")))},
    {", ".join(f"{k} AND (fresh OR p_{k}) AS d_{k}" for k in ("kc", "kr", "kw"))} FROM h),
e AS (SELECT *, NOT same AND (d_i <> 0 OR d_o <> 0 OR d_c <> 0 OR d_w5 <> 0 OR d_w1 <> 0 OR d_wo <> 0) AS event, d_c + d_w5 + d_w1 + d_wo AS parts FROM x)"""


@query("json_log_b_reported", f"""{_REPORTED} SELECT source_id, line_number, model AS raw_model, CAST(sum(CASE WHEN event THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS usage_event_index, d_i AS input_tokens_total,
  greatest(d_i - parts, 0) AS input_tokens_uncached, d_c AS input_tokens_cached, d_w5 AS cache_write_5m_tokens, d_w1 AS cache_write_1h_tokens, d_wo AS cache_write_unknown_tokens, d_o AS output_tokens_total, d_r AS reasoning_output_tokens,
  CASE WHEN d_kc AND d_kr AND d_kw AND parts <= d_i AND d_r <= d_o THEN 'complete' ELSE 'partial' END AS coverage, d_kw AS cache_write_data_complete, parts <= d_i AS input_subset_accounting_consistent,
  concat_ws(',', CASE WHEN NOT d_kc THEN '{log_b.NOTES[0]}' END, CASE WHEN NOT d_kw THEN '{log_b.NOTES[1]}' END, CASE WHEN NOT d_kr THEN '{log_b.NOTES[2]}' END, CASE WHEN parts > d_i THEN '{log_b.NOTES[3]}' END, CASE WHEN d_r > d_o THEN '{log_b.NOTES[4]}' END, CASE WHEN d_t <> d_i + d_o THEN '{log_b.NOTES[5]}' END) AS notes
FROM e QUALIFY event""")
def json_log_b_reported(spark: SparkSession, d: str) -> DataFrame:
    seen, _ = log_b.observations(common.lines_of(_text_b_reported(spark, d), "text"))
    counters = [c for c in COUNTERS if c not in ("web_search_requests", "web_fetch_requests")]
    return seen.select("source_id", "line_number", "raw_model", "usage_event_index", *counters, "coverage", "cache_write_data_complete", "input_subset_accounting_consistent", F.array_join("notes", ",").alias("notes"))


@query("json_log_b_warnings", f"""{_REPORTED}, first AS (SELECT source_id, min(line_number) AS line_number, min(CASE WHEN model IS NULL THEN line_number END) AS unnamed FROM e WHERE event GROUP BY source_id),
told AS (SELECT source_id, line_number, unnest(list_filter([CASE WHEN reset THEN 'codex_counter_reset' END, CASE WHEN event AND parts > d_i THEN 'codex_invalid_input_subsets' END, CASE WHEN event AND d_r > d_o THEN 'codex_invalid_reasoning_subset' END], lambda c: c IS NOT NULL)) AS code FROM e
  UNION ALL SELECT source_id, line_number, CASE WHEN whole THEN 'codex_unsupported_usage_schema' ELSE 'codex_malformed_record' END FROM g WHERE NOT (whole AND sound)
  UNION ALL SELECT source_id, min(line_number), 'codex_invalid_context_window' FROM g WHERE whole AND n % 23 = 0 GROUP BY source_id UNION ALL SELECT source_id, min(line_number), 'codex_format_drift' FROM g WHERE whole AND n % 19 = 0 GROUP BY source_id
  UNION ALL SELECT source_id, line_number, 'codex_usage_without_session_meta' FROM first UNION ALL SELECT source_id, unnamed, 'codex_usage_without_model_context' FROM first WHERE unnamed IS NOT NULL)
SELECT source_id, line_number, code FROM told""")
def json_log_b_warnings(spark: SparkSession, d: str) -> DataFrame:
    return log_b.observations(common.lines_of(_text_b_reported(spark, d), "text"))[1]


def buckets(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.BUCKETS, canonical=events(spark, d))


def both_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events and buckets, each computed once however often reconciliation reads them."""
    e = events(spark, d)
    e = written(e.select(*[c for c in reconcile.EVENT if c in e.columns]), "events")
    return e, written(V.view(spark, d, V.BUCKETS, canonical=e), "buckets")


_B = ("request_count", "input_tokens_uncached", "input_tokens_cached", "output_tokens")


@query("bucket_normalize", f"{O.BUCKETS} SELECT source_kind, provider, model, epoch_us(bucket_start) AS start_us, " + ", ".join(f"CAST(CASE WHEN count({c}) = count(*) THEN sum({c}) END AS BIGINT) AS {c}" for c in _B) + ", CAST(sum(provider_metered_usd) AS BIGINT) AS usd, count(*) AS parts FROM buckets GROUP BY 1, 2, 3, bucket_start, bucket_end")
def bucket_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = reconcile.normalised_buckets(buckets(spark, d))
    return rows.select("source_kind", "provider", "model", us("bucket_start").alias("start_us"), *_B, F.col("provider_metered_usd").cast("long").alias("usd"), "parts")


_JOINED = f"""{O.BUCKETS}, hit AS (SELECT b.bucket_id, e.client, e.event_key, e.input_tokens_uncached AS u, e.input_tokens_cached AS c, e.output_tokens_total AS o, e.cache_write_5m_tokens AS w5, coalesce(e.cache_write_data_complete, false) AS done FROM buckets b JOIN canonical e ON e.provider = b.provider AND (b.model IS NULL OR lower(b.model) = lower(e.raw_model)) AND e.occurred_at >= b.bucket_start AND e.occurred_at < b.bucket_end),
side AS (SELECT bucket_id, count(*) AS n, CAST(sum(u) AS BIGINT) AS u, CAST(sum(c) AS BIGINT) AS c, CAST(sum(o) AS BIGINT) AS o, CAST(sum(CASE WHEN w5 > 0 OR done THEN w5 END) AS BIGINT) AS w5 FROM hit GROUP BY bucket_id)"""


@query("bucket_match", f"{_JOINED} SELECT bucket_id, n AS request_count, u AS input_tokens_uncached, c AS input_tokens_cached, o AS output_tokens, w5 AS cache_write_5m_tokens FROM side")
def bucket_match(spark: SparkSession, d: str) -> DataFrame:
    e, b = both_sides(spark, d)
    rows = reconcile.local_side(reconcile.matches(e, reconcile.full_buckets(b)), "l")
    return rows.select("bucket_id", *[F.col(f"l_{c}").alias(c) for c in (*_B, "cache_write_5m_tokens")])


@query("bucket_boundary", f"{O.BUCKETS} SELECT b.bucket_id, count(*) AS request_count FROM buckets b JOIN canonical e ON e.provider = b.provider AND (b.model IS NULL OR lower(b.model) = lower(e.raw_model)) AND NOT (e.occurred_at >= b.bucket_start AND e.occurred_at < b.bucket_end) AND e.occurred_at >= b.bucket_start - to_hours(1) AND e.occurred_at <= b.bucket_end + to_hours(1) GROUP BY 1")
def bucket_boundary(spark: SparkSession, d: str) -> DataFrame:
    e, b = both_sides(spark, d)
    return reconcile.matches(e, reconcile.full_buckets(b), boundary=True).groupBy("bucket_id").agg(F.count("*").alias("request_count"))


_CLASS = f"""{_JOINED}, near AS (SELECT DISTINCT b.bucket_id FROM buckets b JOIN canonical e ON e.provider = b.provider AND (b.model IS NULL OR lower(b.model) = lower(e.raw_model)) AND e.occurred_at >= b.bucket_start - to_hours(1) AND e.occurred_at <= b.bucket_end + to_hours(1)),
classes AS (SELECT b.*, s.n AS ln, s.u AS lu, s.c AS lc, s.o AS lo, CASE
  WHEN s.n IS NULL AND coalesce(request_count, input_tokens_uncached, input_tokens_cached, output_tokens) IS NOT NULL AND coalesce(request_count, 0) = 0 AND coalesce(input_tokens_uncached, 0) = 0 AND coalesce(input_tokens_cached, 0) = 0 AND coalesce(output_tokens, 0) = 0 THEN 'matched'
  WHEN s.n IS NULL AND k.bucket_id IS NOT NULL AND coalesce(request_count, input_tokens_uncached, input_tokens_cached, output_tokens) IS NOT NULL THEN 'time_boundary'
  WHEN s.n IS NULL THEN 'provider_only' WHEN coalesce(request_count, input_tokens_uncached, input_tokens_cached, output_tokens) IS NULL THEN 'route_unknown'
  WHEN coalesce(request_count <> s.n, false) OR coalesce(input_tokens_uncached <> s.u, false) OR coalesce(input_tokens_cached <> s.c, false) OR coalesce(output_tokens <> s.o, false) THEN 'counter_mismatch'
  ELSE 'route_unknown' END AS classification FROM buckets b LEFT JOIN side s USING (bucket_id) LEFT JOIN near k USING (bucket_id))"""


@query("reconcile_classify", f"{_CLASS} SELECT bucket_id, classification, ln AS local_request_count, lu AS local_input_tokens_uncached, input_tokens_uncached - lu AS delta_input_tokens_uncached FROM classes")
def reconcile_classify(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile(*both_sides(spark, d)).select("bucket_id", "classification", "local_request_count", "local_input_tokens_uncached", "delta_input_tokens_uncached")


_LOCAL = f"""{_JOINED}, covered AS (SELECT DISTINCT client, event_key FROM hit JOIN buckets USING (bucket_id) WHERE coalesce(request_count, buckets.input_tokens_uncached, buckets.input_tokens_cached, output_tokens) IS NOT NULL),
alone AS (SELECT * FROM canonical e WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.client = e.client AND c.event_key = e.event_key))"""


@query("local_only", f"{_LOCAL} SELECT CAST({O.local_day(ZONE)} AS VARCHAR) AS local_day, provider AS provider_name, raw_model AS model, count(*) AS request_count, CAST(sum(input_tokens_uncached) AS BIGINT) AS input_tokens_uncached, epoch_us(timezone('UTC', timezone('{ZONE}', CAST({O.local_day(ZONE)} AS TIMESTAMP)))) AS start_us FROM alone GROUP BY {O.local_day(ZONE)}, provider, raw_model")
def local_only(spark: SparkSession, d: str) -> DataFrame:
    rows = reconcile.local_only(*both_sides(spark, d), ZONE)
    return rows.select(F.col("local_day").cast("string").alias("local_day"), "provider_name", "model", "request_count", "input_tokens_uncached", us("bucket_start").alias("start_us"))


@query("reconcile_summary", f"{_CLASS}, covered AS (SELECT DISTINCT client, event_key FROM hit JOIN buckets USING (bucket_id) WHERE coalesce(request_count, buckets.input_tokens_uncached, buckets.input_tokens_cached, output_tokens) IS NOT NULL), loc AS (SELECT DISTINCT {O.local_day(ZONE)} AS dd, provider, raw_model FROM canonical e WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.client = e.client AND c.event_key = e.event_key)), names(classification) AS (VALUES ('matched'), ('provider_only'), ('local_only'), ('time_boundary'), ('route_unknown'), ('counter_mismatch')) SELECT classification, CAST(CASE classification WHEN 'local_only' THEN (SELECT count(*) FROM loc) ELSE (SELECT count(*) FROM classes c WHERE c.classification = names.classification) END AS BIGINT) AS n FROM names")
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    e, b = both_sides(spark, d)
    return reconcile.summary(reconcile.reconcile(e, b), reconcile.local_only(e, b, ZONE))


def cash(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-time charges from orders, plans from customers, attestations from suppliers."""
    orders, customers, suppliers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "supplier"))
    amount = F.round("o_totalprice", 2).cast("decimal(18,6)")
    refund = F.col("o_orderstatus") == "P"
    once = orders.select(F.concat(F.lit("c"), "o_orderkey").alias("id"), F.concat(F.lit("p"), F.col("o_custkey") % 5).alias("provider"), F.when(refund, "refund").when(F.col("o_custkey") % 2 == 0, "api_charge").otherwise("credit_purchase").alias("category"), F.when(refund & (F.col("o_orderkey") % 97 > 0), -amount).otherwise(amount).alias("amount_usd"), F.col("o_orderdate").cast("timestamp").alias("charged_at"), (F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(cast(o_orderkey % 3 as int) - 1)")).alias("attested_at"))
    anchor = F.expr("timestamp'1995-01-01 06:00:00' + make_dt_interval(cast(c_custkey % 31 as int))")
    plans = customers.select(F.concat(F.lit("r"), "c_custkey").alias("id"), F.concat(F.lit("p"), F.col("c_custkey") % 5).alias("provider"), (F.col("c_custkey") % 50 + 10).cast("decimal(18,6)").alias("amount_usd"), F.when(F.col("c_custkey") % 3 == 0, "quarterly").otherwise("monthly").alias("cadence"), anchor.alias("effective_from"), F.when(F.col("c_custkey") % 4 == 0, F.lit("1995-09-15").cast("timestamp")).alias("effective_to"))
    k = F.col("s_suppkey")
    start = F.expr("timestamp'1995-01-01 00:00:00' + make_dt_interval(cast(s_suppkey div 5 * 60 as int))")
    attest = suppliers.where(F.col("s_suppkey") % 5 < 4).select(F.concat(F.lit("t"), "s_suppkey").alias("id"), F.concat(F.lit("p"), k % 5).alias("provider"), start.alias("effective_from"), (start + F.expr("make_dt_interval(cast(if(s_suppkey % 5 = 2 and s_suppkey > 10, 59, 61) as int))")).alias("effective_to"), (start + F.expr("make_dt_interval(cast(60 + s_suppkey % 3 as int))")).alias("attested_at"))
    return once, plans, attest


_CASH = """WITH once AS (SELECT 'c' || o_orderkey AS id, 'p' || (o_custkey % 5) AS provider, CASE WHEN o_orderstatus = 'P' THEN 'refund' WHEN o_custkey % 2 = 0 THEN 'api_charge' ELSE 'credit_purchase' END AS category,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 97 > 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice, 2) * 100 AS BIGINT) AS cents, CAST(o_orderdate AS TIMESTAMP) AS charged_at, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 3 - 1 AS INTEGER)) AS attested_at FROM orders),
plans AS (SELECT 'r' || c_custkey AS id, 'p' || (c_custkey % 5) AS provider, (c_custkey % 50 + 10) * 100 AS cents, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 1 END AS step, timestamp '1995-01-01 06:00:00' + to_days(CAST(c_custkey % 31 AS INTEGER)) AS f, CASE WHEN c_custkey % 4 = 0 THEN timestamp '1995-09-15' END AS e FROM customer),
series AS (SELECT id, provider, cents, k, f + to_months(CAST(k * step AS INTEGER)) AS charged_at FROM plans, range(0, 40) r(k) WHERE f + to_months(CAST(k * step AS INTEGER)) < least(coalesce(e, timestamp '1996-03-01'), timestamp '1996-03-01') AND f + to_months(CAST(k * step AS INTEGER)) >= timestamp '1995-02-01'),
att AS (SELECT 't' || s_suppkey AS id, 'p' || (s_suppkey % 5) AS provider, timestamp '1995-01-01' + to_days(CAST(s_suppkey // 5 * 60 AS INTEGER)) AS f, timestamp '1995-01-01' + to_days(CAST(s_suppkey // 5 * 60 + CASE WHEN s_suppkey % 5 = 2 AND s_suppkey > 10 THEN 59 ELSE 61 END AS INTEGER)) AS e, timestamp '1995-01-01' + to_days(CAST(s_suppkey // 5 * 60 + 60 + s_suppkey % 3 AS INTEGER)) AS a FROM supplier WHERE s_suppkey % 5 < 4),
reach AS (SELECT *, max(e) OVER (PARTITION BY provider ORDER BY f, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM att),
islands AS (SELECT *, sum(CASE WHEN f <= r THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY f, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
done AS (SELECT provider, bool_or(a <= timestamp '1995-02-01' AND b >= timestamp '1996-03-01') AS complete FROM (SELECT provider, island, min(f) AS a, max(e) AS b FROM islands GROUP BY 1, 2) s GROUP BY 1)"""
_WINDOW = ("1995-02-01", "1996-03-01")


@query("recurring_charges", f"{_CASH} SELECT id, provider, CAST(cents AS BIGINT) AS cents, epoch_us(charged_at) AS at_us FROM series")
def recurring_charges(spark: SparkSession, d: str) -> DataFrame:
    return billing.recurring_charges(cash(spark, d)[1], *_WINDOW).select("id", "provider", (F.col("amount_usd") * 100).cast("long").alias("cents"), us("charged_at").alias("at_us"))


@query("attestation_coverage", f"{_CASH} SELECT provider, complete FROM done")
def attestation_coverage(spark: SparkSession, d: str) -> DataFrame:
    return billing.attested(cash(spark, d)[2], *_WINDOW)


@query("cash_rollup", f"""{_CASH}, charges AS (SELECT provider, category, cents, 0 AS rec FROM once WHERE charged_at >= timestamp '1995-02-01' AND charged_at < timestamp '1996-03-01' UNION ALL SELECT provider, 'subscription_plan', cents, 1 FROM series)
SELECT p.provider, CAST(coalesce(sum(cents), 0) AS BIGINT) AS recorded_cents, CAST(count(cents) AS BIGINT) AS charges, CAST(coalesce(sum(rec), 0) AS BIGINT) AS recurring_charges, coalesce(max(d.complete), false) AS attested_complete, CAST(CASE WHEN coalesce(max(d.complete), false) THEN coalesce(sum(cents), 0) END AS BIGINT) AS actual_cents FROM (VALUES ('p0'), ('p1'), ('p2'), ('p3'), ('p4'), ('none')) AS p(provider) LEFT JOIN charges c ON c.provider = p.provider LEFT JOIN done d ON d.provider = p.provider GROUP BY p.provider""")
def cash_rollup(spark: SparkSession, d: str) -> DataFrame:
    scope = spark.createDataFrame([(f"p{k}",) for k in range(5)] + [("none",)], "provider string")
    rows = billing.cash_rollup(*cash(spark, d), scope, *_WINDOW)
    cents = lambda c: (F.col(c) * 100).cast("long")
    return rows.select("provider", cents("recorded_cash_usd").alias("recorded_cents"), "charges", "recurring_charges", "attested_complete", cents("actual_billed_usd").alias("actual_cents"))


@query("billing_issues", f"""{_CASH} SELECT code, id AS record_id FROM (
  SELECT 'amount_sign' AS code, id FROM once WHERE (category = 'refund' AND cents >= 0) OR (category <> 'refund' AND cents < 0)
  UNION ALL SELECT 'attested_before_charge', id FROM once WHERE attested_at < charged_at UNION ALL SELECT 'empty_interval', id FROM plans WHERE e <= f
  UNION ALL SELECT 'attested_before_end', id FROM att WHERE a < e UNION ALL SELECT 'overlapping_attestation', id FROM reach WHERE f < r) x""")
def billing_issues(spark: SparkSession, d: str) -> DataFrame:
    return billing.billing_issues(*cash(spark, d))




@query("client_coverage", f"""{O.EVENTS}, s AS (SELECT client, count(DISTINCT source_id) AS sources, count(*) AS observations, count(warning) AS warnings FROM obs GROUP BY client),
e AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY occurred_at, event_key) AS a, row_number() OVER (PARTITION BY client ORDER BY occurred_at DESC, event_key DESC) AS z, count(*) OVER (PARTITION BY client) AS n FROM canonical)
SELECT s.client, sources, observations, f.n AS events, s.warnings AS warnings, 'observed_window' AS window_status, f.event_key AS first_key, epoch_us(f.occurred_at) AS first_us, l.event_key AS last_key, epoch_us(l.occurred_at) AS last_us FROM s JOIN e f ON f.client = s.client AND f.a = 1 JOIN e l ON l.client = s.client AND l.z = 1""")
def client_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return coverage.client_coverage(o, canonical.fold(o)).select("client", "sources", "observations", "events", "warnings", "window_status", "first_key", us("first_at").alias("first_us"), "last_key", us("last_at").alias("last_us"))


@query("query_coverage", f"{O.EVENTS} SELECT client, CASE WHEN count(*) FILTER (WHERE occurred_at >= timestamp '2030-01-01' AND occurred_at < timestamp '2030-02-01') > 0 THEN 'matching_events' WHEN timestamp '2030-02-01' <= min(occurred_at) OR timestamp '2030-01-01' > max(occurred_at) THEN 'outside_observed_window' ELSE 'no_events_within_observed_window' END AS status, count(*) FILTER (WHERE occurred_at >= timestamp '2030-01-01' AND occurred_at < timestamp '2030-02-01') AS matching_events FROM canonical GROUP BY client")
def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    e = canonical.fold(o)
    return coverage.query_coverage(coverage.client_coverage(o, e), canonical.in_window(e, "2030-01-01", "2030-02-01"), "2030-01-01", "2030-02-01")


@query("ledger_stats", f"WITH {O.OBS} SELECT count(DISTINCT source_id) AS sources, count(*) AS observations, count(DISTINCT client || '|' || event_key) AS events, count(warning) AS warnings FROM obs")
def ledger_stats(spark: SparkSession, d: str) -> DataFrame:
    return coverage.ledger_stats(observations(spark, d))


@query("warning_counts", f"WITH {O.OBS} SELECT client, warning AS code, count(*) AS n FROM obs WHERE warning IS NOT NULL GROUP BY 1, 2")
def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).where("warning is not null")
    return coverage.warning_counts(o.select("source_id", "client", F.col("warning").alias("code")))


@query("daily_activity", f"{O.EVENTS} SELECT CAST({O.local_day('Asia/Tokyo')} AS VARCHAR) AS day, client, count(*) AS events FROM canonical GROUP BY 1, 2")
def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    return coverage.daily_activity(events(spark, d), "Asia/Tokyo").withColumn("day", F.col("day").cast("string"))


@query("event_provenance", f"WITH {O.OBS} SELECT client, event_key, count(*) AS observations, count(*) - 1 AS duplicates, count(DISTINCT source_id) AS sources, epoch_us(min(occurred_at)) AS first_us, epoch_us(max(occurred_at)) AS last_us FROM obs GROUP BY client, event_key")
def event_provenance(spark: SparkSession, d: str) -> DataFrame:
    return canonical.provenance(observations(spark, d)).select("client", "event_key", "observations", "duplicates", "sources", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


def inventories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents as a source inventory."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    k = F.col("doc_id")
    renamed = lambda n, mark: F.concat(F.when(k % n == 0, mark).otherwise(""), k.cast("string")).alias("source_id")  # noqa: E731  so some sources vanish and others are new
    before = docs.select(renamed(7, "old-"), F.octet_length("text").cast("long").alias("file_size"), F.sha2("text", 256).alias("content_hash"))
    text = F.when(k % 5 == 0, F.concat("text", F.lit("+"))).when(k % 11 == 0, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    after = docs.select(renamed(13, "new-"), F.octet_length(text).cast("long").alias("file_size"), F.sha2(text, 256).alias("content_hash"))
    return after, before


@query("source_snapshot_diff", """WITH b AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'old-' ELSE '' END || doc_id AS doc_id, octet_length(encode(text)) AS n, sha256(text) AS h FROM documents),
a AS (SELECT doc_id, octet_length(encode(t)) AS n, sha256(t) AS h FROM (SELECT CASE WHEN doc_id % 13 = 0 THEN 'new-' ELSE '' END || doc_id AS doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '+' WHEN doc_id % 11 = 0 THEN '#' || substr(text, 2) ELSE text END AS t FROM documents) x)
SELECT coalesce(a.doc_id, b.doc_id) AS source_id, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'vanished' WHEN a.h = b.h AND a.n = b.n THEN 'unchanged' WHEN a.n > b.n THEN 'appended' ELSE 'rewritten' END AS state, CAST(b.n AS BIGINT) AS size_before, CAST(a.n AS BIGINT) AS size_now FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def source_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return incremental.source_changes(*inventories(spark, d))


@query("incremental_observations", f"""WITH {O.OBS} SELECT source_id, line_number, client, event_key, CAST(CASE WHEN CAST(substr(source_id, 2) AS BIGINT) % 3 = 0 THEN output_tokens_total + 1 ELSE output_tokens_total END AS BIGINT) AS output_tokens_total FROM obs""")
def incremental_observations(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    third = F.substring("source_id", 2, 20).cast("long") % 3 == 0
    changes = o.select("source_id").distinct().withColumn("state", F.when(third, "rewritten").otherwise("unchanged"))
    new = o.where(third).withColumn("output_tokens_total", F.col("output_tokens_total") + 1)
    return incremental.replaced(o, changes, new).select("source_id", "line_number", "client", "event_key", "output_tokens_total")


@query("idempotent_import", "SELECT count(*) AS new_documents FROM (SELECT DISTINCT sha256(CASE WHEN page_id % 3 = 0 THEN html || '+' ELSE html END) AS h FROM pages) n WHERE h NOT IN (SELECT sha256(html) FROM pages)")
def idempotent_import(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    again = pages.select(F.sha2(F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("+"))).otherwise(F.col("html")), 256).alias("content_digest"))
    return reconcile.new_imports(again, pages.select(F.sha2("html", 256).alias("content_digest"))).agg(F.count("*").alias("new_documents"))


@query("catalog_diff", """WITH a AS (SELECT p_partkey + CASE WHEN p_partkey % 9 = 0 THEN 1000000000 ELSE 0 END AS id, p_name, p_brand, p_size FROM part),
b AS (SELECT p_partkey + CASE WHEN p_partkey % 8 = 0 THEN 2000000000 ELSE 0 END AS id, p_name, p_brand, p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS p_size FROM part)
SELECT CAST(coalesce(a.id, b.id) AS BIGINT) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.p_size <> b.p_size""")
def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two revisions of all parts; a ninth of them has other ids in the old one and an eighth in the new one, so those are removed and added."""
    part = spark.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey").cast("long")
    old = part.select((key + F.when(key % 9 == 0, 1_000_000_000).otherwise(0)).alias("id"), "p_name", "p_brand", "p_size")
    size = F.when(key % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("int")
    new = part.select((key + F.when(key % 8 == 0, 2_000_000_000).otherwise(0)).alias("id"), "p_name", "p_brand", size.alias("p_size"))
    return catalog.catalog_diff(old, new)


def part_catalog(spark: SparkSession, d: str) -> pricing.Catalog:
    """Parts as a catalog with the defects that a real one may have."""
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("p_partkey", F.col("p_partkey").cast("long"))
    family = F.floor(F.col("p_partkey") / 600).cast("string")  # so that names grow with the table
    at = lambda c: F.timestamp_seconds(F.lit(788918400) + c * 86400)
    start, end = (F.col("p_partkey") % 400), (F.col("p_partkey") % 400) + F.col("p_size") - 2
    base = [F.concat(F.lit("k"), "p_partkey").alias("id"), F.lit("anthropic").alias("provider"), F.concat(F.lit("m"), F.col("p_partkey") % 60, F.lit("-"), family).alias("canonical_model"), at(start).alias("effective_from"), at(end).alias("effective_to")]
    aliases = part.select(*base, F.concat(F.lit("x"), F.col("p_partkey") % 40, F.lit("-"), family).alias("raw_model"))
    money = [F.lit("1").cast("decimal(18,9)").alias(c) for c in ("cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "output", "web_search", "web_fetch")]
    rates = part.where("p_partkey % 60 < 50").select(*base, F.lit("usd").alias("kind"), F.when(F.col("p_partkey") % 30 == 0, 0).otherwise(1000000).cast("long").alias("unit_scale"), F.lit(0).cast("long").alias("min_input_tokens"), F.lit(None).cast("long").alias("max_input_tokens_exclusive"), F.when(F.col("p_partkey") % 21 == 0, -1).otherwise(1).cast("decimal(18,9)").alias("input"), *money, F.lit(1).cast("long").alias("tool_per_units"), F.lit(False).alias("cache_write_observation_required"))
    policies = rates.select(F.col("id").alias("rate_id"), F.lit("speed").alias("dimension"), F.array(F.lit("fast"), F.lit("standard")).alias("allowed"), F.lit("standard").alias("default_value"), F.expr("cast(map() as map<string, string>)").alias("value_aliases"))
    modifiers = part.where("p_partkey % 15 = 0").select(*base, F.lit("usd").alias("kind"), F.lit("all").alias("scope"), F.lit("2").cast("decimal(9,4)").alias("multiplier"), F.create_map(F.lit("speed"), F.when(F.col("p_partkey") % 2 == 0, "fast").otherwise("slow")).alias("selectors"))
    return pricing.Catalog(aliases, rates, policies, modifiers)


_PART = """WITH p AS (SELECT 'k' || p_partkey AS id, p_partkey AS k, 'm' || (p_partkey % 60) || '-' || (p_partkey // 600) AS model, 'x' || (p_partkey % 40) || '-' || (p_partkey // 600) AS raw, p_partkey % 400 AS f, p_partkey % 400 + p_size - 2 AS e FROM part),
r AS (SELECT * FROM p WHERE k % 60 < 50), m AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'fast' ELSE 'slow' END AS v FROM p WHERE k % 15 = 0)"""


@query("catalog_overlaps", f"""{_PART} SELECT 'overlapping_alias' AS code, a.id AS first_id, b.id AS second_id FROM p a JOIN p b ON a.raw = b.raw AND a.id < b.id AND a.f < b.e AND b.f < a.e
UNION ALL SELECT 'overlapping_rate', a.id, b.id FROM r a JOIN r b ON a.model = b.model AND a.id < b.id AND a.f < b.e AND b.f < a.e UNION ALL SELECT 'stacked_modifier', a.id, b.id FROM m a JOIN m b ON a.model = b.model AND a.v = b.v AND a.id < b.id AND a.f < b.e AND b.f < a.e""")
def catalog_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_overlaps(part_catalog(spark, d))


@query("catalog_issues", f"""{_PART} SELECT 'alias_empty_interval' AS code, id AS record_id FROM p WHERE e <= f UNION ALL SELECT 'rate_empty_interval', id FROM r WHERE e <= f UNION ALL SELECT 'modifier_empty_interval', id FROM m WHERE e <= f
UNION ALL SELECT 'rate_zero_scale', id FROM r WHERE k % 30 = 0 UNION ALL SELECT 'rate_negative', id FROM r WHERE k % 21 = 0 UNION ALL SELECT 'alias_without_rate', id FROM p WHERE model NOT IN (SELECT model FROM r)
UNION ALL SELECT 'modifier_orphan', id FROM m WHERE model NOT IN (SELECT model FROM r) UNION ALL SELECT 'modifier_unreachable', id FROM m WHERE model IN (SELECT model FROM r) AND v = 'slow'""")
def catalog_issues(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_issues(part_catalog(spark, d))


@query("latest_import", f"{O.BUCKETS} SELECT source_kind, count(*) AS imports_buckets, CAST(max(imp) AS BIGINT) AS latest FROM (SELECT *, CAST(extract(year from bucket_start) AS BIGINT) AS imp, max(CAST(extract(year from bucket_start) AS BIGINT)) OVER (PARTITION BY source_kind) AS top FROM buckets) x WHERE imp = top GROUP BY source_kind")
def latest_import(spark: SparkSession, d: str) -> DataFrame:
    rows = reconcile.latest_imports(buckets(spark, d).withColumn("import_id", F.year("bucket_start").cast("long")))
    return rows.groupBy("source_kind").agg(F.count("*").alias("imports_buckets"), F.max("import_id").alias("latest"))


@query("import_status", f"{O.BUCKETS} SELECT source_kind, count(DISTINCT extract(year from bucket_start)) AS imports, count(*) AS buckets, count(DISTINCT provider) AS providers, epoch_us(min(bucket_start)) AS first_us, epoch_us(max(bucket_end)) AS last_us, CAST(max(extract(year from bucket_start)) AS BIGINT) AS latest_import FROM buckets GROUP BY 1")
def import_status(spark: SparkSession, d: str) -> DataFrame:
    rows = reconcile.import_status(buckets(spark, d).withColumn("import_id", F.year("bucket_start").cast("long")))
    return rows.select("source_kind", "imports", "buckets", "providers", us("first_start").alias("first_us"), us("last_end").alias("last_us"), "latest_import")


@query("stable_ids", "SELECT CAST(c_custkey AS VARCHAR) AS part, 'evt_' || substr(sha256(encode(chr(octet_length(encode(CAST(c_custkey AS VARCHAR)))::INTEGER)) || '\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB || encode(CAST(c_custkey AS VARCHAR))), 1, 24) AS id FROM customer")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return spark.read.parquet(f"{d}/customer.parquet").select(key.alias("part"), stable_id(key).alias("id"))


@query("observation_issues", f"""WITH {O.OBS}, t AS (SELECT *, input_tokens_cached % 9 AS m FROM obs), b AS (SELECT client, event_key, source_id, line_number, input_tokens_cached AS c, cache_write_5m_tokens + cache_write_1h_tokens + cache_write_unknown_tokens AS w, input_tokens_uncached AS u, cache_write_5m_tokens AS w5, cache_write_1h_tokens AS w1, cache_write_unknown_tokens AS wu, web_search_requests AS ws, web_fetch_requests AS wf, CASE WHEN m = 0 THEN input_tokens_total - input_tokens_uncached - 1 ELSE input_tokens_total END AS total, CASE WHEN m = 1 THEN output_tokens_total + 1 ELSE reasoning_output_tokens END AS r, output_tokens_total AS o, CASE WHEN m = 2 THEN NULL ELSE raw_model END AS raw_model FROM t)
SELECT client, event_key, source_id, line_number, 'subsets_exceed_input' AS code FROM b WHERE c + w > total UNION ALL SELECT client, event_key, source_id, line_number, 'reasoning_exceeds_output' FROM b WHERE r > o
UNION ALL SELECT client, event_key, source_id, line_number, 'input_not_additive' FROM b WHERE client = 'claude_code' AND u + c + w <> total UNION ALL SELECT client, event_key, source_id, line_number, 'missing_model' FROM b WHERE raw_model IS NULL
UNION ALL SELECT client, event_key, source_id, line_number, 'negative_counter' FROM b WHERE least(total, u, c, w5, w1, wu, o, r, ws, wf) < 0""")
def observation_issues(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("input_tokens_cached") % 9
    o = observations(spark, d).withColumns({"input_tokens_total": F.when(m == 0, F.col("input_tokens_total") - F.col("input_tokens_uncached") - 1).otherwise(F.col("input_tokens_total")), "reasoning_output_tokens": F.when(m == 1, F.col("output_tokens_total") + 1).otherwise(F.col("reasoning_output_tokens")), "raw_model": F.when(m != 2, F.col("raw_model"))})
    return quality.observation_issues(o)


@query("reconcile_scope", f"{_CLASS}, names(classification) AS (VALUES ('matched'), ('provider_only'), ('local_only'), ('time_boundary'), ('route_unknown'), ('counter_mismatch')) SELECT classification, CAST((SELECT count(*) FROM classes c WHERE c.classification = names.classification AND provider = 'openai' AND (model IS NULL OR lower(model) IN ('m-a', 'm-n'))) AS BIGINT) AS n FROM names")
def reconcile_scope(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.scope_summary(reconcile.reconcile(*both_sides(spark, d)), ["openai"], ["M-A", "m-n"])


@query("cost_period", f"{O.EVENTS} SELECT CAST(min({O.local_day(ZONE)}) AS VARCHAR) AS first_day, CAST(max({O.local_day(ZONE)}) AS VARCHAR) AS last_day FROM canonical")
def cost_period(spark: SparkSession, d: str) -> DataFrame:
    return reports.period(events(spark, d), ZONE).select(*[F.col(c).cast("string").alias(c) for c in ("first_day", "last_day")])


@query("provider_scope", f"{O.EVENTS} SELECT DISTINCT lower(trim(provider)) AS provider FROM canonical")
def provider_scope(spark: SparkSession, d: str) -> DataFrame:
    return reports.provider_scope(events(spark, d))


@query("format_drift", "SELECT CAST(count(*) AS BIGINT) AS records FROM events WHERE props IS NOT NULL AND EXISTS (SELECT 1 FROM unnest(json_keys(props)) k(key) WHERE key <> 'n')")
def format_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("props").alias("text"))
    return quality.drift(rows, ["n"]).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and list price of each local day, model and client, copies counted once."""
    return reports.usage_report(priced(spark, d), ("day", "client", "model"), ZONE)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "local_date"]
