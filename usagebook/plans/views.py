"""Usage-shaped views of the test tables, as SQL that two engines share.

Each view is one SELECT over the tables; only how a timestamp is put together
differs between dialects. `frames` gives them as DataFrames, `ctes` as the WITH
clause of an oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {"event_ts": "cast(l_shipdate as timestamp) + make_dt_interval(0, l_linenumber, cast(l_partkey % 60 as int), 0)", "us": "unix_micros({})", "order_ts": "cast(o_orderdate as timestamp)", "add_days": "{} + make_dt_interval(cast({} as int), 0, 0, 0)", "stamp": "timestamp'{} 00:00:00'"}
DUCK = {"event_ts": "l_shipdate + to_hours(l_linenumber) + to_minutes(cast(l_partkey % 60 as int))", "us": "epoch_us({})", "order_ts": "cast(o_orderdate as timestamp)", "add_days": "{} + to_days(cast({} as int))", "stamp": "timestamp '{} 00:00:00'"}

OBSERVATIONS = """
SELECT concat('s', cast(l_suppkey as {string})) AS source_id, cast(l_orderkey as bigint) * 8 + l_linenumber AS line_number,
  CASE l_linestatus WHEN 'F' THEN 'claude_code' ELSE 'openai_codex' END AS client,
  concat(cast(l_orderkey as {string}), '-', cast(l_linenumber as {string})) AS event_key,
  cast(l_orderkey as {string}) AS session_id,
  CASE l_linestatus WHEN 'F' THEN 'anthropic' ELSE 'openai' END AS provider,
  CASE WHEN l_partkey % 11 = 0 THEN concat('x-', l_returnflag) ELSE concat('m-', l_returnflag) END AS raw_model,
  {event_ts} AS occurred_at,
  cast(l_quantity as bigint) * 100 + l_partkey + l_suppkey + l_partkey % 7 + l_suppkey % 3 AS input_tokens_total,
  cast(l_quantity as bigint) * 100 AS input_tokens_uncached,
  cast(l_partkey as bigint) AS input_tokens_cached,
  cast(l_suppkey as bigint) AS cache_write_5m_tokens,
  cast(l_partkey % 7 as bigint) AS cache_write_1h_tokens,
  cast(l_suppkey % 3 as bigint) AS cache_write_unknown_tokens,
  cast(l_quantity as bigint) * 10 AS output_tokens_total,
  cast(l_quantity as bigint) AS reasoning_output_tokens,
  cast(CASE WHEN l_linestatus = 'F' THEN l_partkey % 3 ELSE 0 END as bigint) AS web_search_requests,
  cast(CASE WHEN l_linestatus = 'F' THEN l_suppkey % 2 ELSE 0 END as bigint) AS web_fetch_requests,
  CASE l_suppkey % 5 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'partial' ELSE 'complete' END AS coverage,
  cast(l_partkey % 4 as int) AS quality_rank,
  CASE l_partkey % 4 WHEN 0 THEN 'api_key' WHEN 1 THEN 'chatgpt' WHEN 2 THEN 'chatgpt' END AS auth_mode,
  CASE l_partkey % 4 WHEN 1 THEN 'current_profile_inferred' WHEN 3 THEN cast(NULL as {string}) ELSE 'source_observed' END AS auth_mode_provenance,
  CASE l_partkey % 6 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' WHEN 2 THEN 'unknown' END AS service_tier,
  CASE l_suppkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'global' WHEN 2 THEN 'not_available' END AS inference_geo,
  l_partkey % 5 <> 0 AS cache_write_data_complete,
  l_partkey % 13 <> 0 AS input_subset_accounting_consistent,
  CASE l_partkey % 10 WHEN 0 THEN 'clock_skew' WHEN 1 THEN 'ttl_sum' END AS warning
FROM lineitem
"""

COUNTER_LOG = """
SELECT source_id, line_number, occurred_at, reset_mark, model_mark, tier_set, tier_mark,
  sum(step) OVER (PARTITION BY source_id, era ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS input_tokens,
  sum(step % 7) OVER (PARTITION BY source_id, era ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS cached_tokens,
  sum(step % 3) OVER (PARTITION BY source_id, era ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS output_tokens
FROM (
  SELECT *, sum(reset_mark) OVER (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS era FROM (
    SELECT concat('u', cast(user_id as {string})) AS source_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_number,
      {us_ts} AS occurred_at,
      CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS reset_mark,
      CASE event_type WHEN 'signup' THEN 'gpt-alpha' WHEN 'view' THEN 'gpt-beta' END AS model_mark,
      CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END AS tier_set,
      CASE event_type WHEN 'signup' THEN 'fast' END AS tier_mark,
      CASE WHEN event_type = 'error' THEN 1 WHEN event_id % 9 = 0 THEN 0 ELSE cast(floor(value) as bigint) END AS step
    FROM events) marked) eras
"""

ALIASES = """
SELECT id, provider, raw_model, canonical_model, {stamp_from} AS effective_from, {stamp_to} AS effective_to FROM (VALUES
  ('a1', 'anthropic', 'm-A', 'alder', '1990-01-01', '1994-01-01'), ('a2', 'anthropic', 'm-A', 'aspen', '1994-01-01', '1999-01-01'),
  ('a3', 'anthropic', 'm-N', 'nutmeg', '1992-01-01', NULL), ('a4', 'anthropic', 'm-R', 'rowan', '1990-01-01', NULL),
  ('a5', 'openai', 'm-A', 'oak', '1990-01-01', NULL), ('a6', 'openai', 'm-N', 'olive', '1996-06-01', NULL),
  ('a7', 'openai', 'm-R', 'oak', '1990-01-01', '1997-01-01')
) AS t(id, provider, raw_model, canonical_model, f, e)
"""

RATES = """
SELECT id, provider, canonical_model, kind, cast(scale as bigint) AS unit_scale, {stamp_from} AS effective_from, {stamp_to} AS effective_to,
  cast(low as bigint) AS min_input_tokens, cast(high as bigint) AS max_input_tokens_exclusive,
  cast(r1 as decimal(18,9)) AS input, cast(r2 as decimal(18,9)) AS cache_read, cast(r3 as decimal(18,9)) AS cache_write,
  cast(r4 as decimal(18,9)) AS cache_write_5m, cast(r5 as decimal(18,9)) AS cache_write_1h, cast(r6 as decimal(18,9)) AS output,
  cast(search as decimal(18,9)) AS web_search, cast(fetch_rate as decimal(18,9)) AS web_fetch, cast(per as bigint) AS tool_per_units,
  need AS cache_write_observation_required, dims, default_geo, default_tier
FROM (VALUES
  ('r1', 'anthropic', 'alder', 'usd', 1000000, '1990-01-01', NULL, 0, NULL, '10', '1', '12.5', '12.5', '20', '50', '0.01', '0', 1, false, 'inference_geo', 'global', NULL),
  ('r2', 'anthropic', 'aspen', 'usd', 1000000, '1994-01-01', '1997-06-01', 0, NULL, '3', '0.3', '3.75', '3.75', '6', '15', '0.01', NULL, 1, false, 'inference_geo', NULL, NULL),
  ('r3', 'anthropic', 'aspen', 'usd', 1000000, '1997-06-01', NULL, 0, NULL, '2.5', '0.25', NULL, '3', '5', '12', '0.01', '0', 1, false, 'none', NULL, NULL),
  ('r4', 'anthropic', 'rowan', 'usd', 1000000, '1990-01-01', NULL, 0, 4000, '1', '0.1', '1.25', '1.25', '2', '5', '0.01', '0', 1, false, 'none', NULL, NULL),
  ('r5', 'openai', 'oak', 'usd', 1000000, '1990-01-01', NULL, 0, NULL, '5', '0.5', '6.25', '6.25', '6.25', '30', '0.01', '0', 1, true, 'service_tier', NULL, 'standard'),
  ('r6', 'openai', 'oak', 'credits', 1000000, '1990-01-01', NULL, 0, NULL, '125', '12.5', NULL, NULL, NULL, '750', NULL, NULL, 1, false, 'service_tier', NULL, 'standard'),
  ('r7', 'openai', 'olive', 'usd', 1000000, '1996-01-01', NULL, 0, NULL, '2.5', '0.25', '2.5', '2.5', '2.5', '15', '0.01', '0', 1, false, 'none', NULL, NULL)
) AS t(id, provider, canonical_model, kind, scale, f, e, low, high, r1, r2, r3, r4, r5, r6, search, fetch_rate, per, need, dims, default_geo, default_tier)
"""

MODIFIERS = """
SELECT id, provider, canonical_model, kind, {stamp_from} AS effective_from, {stamp_to} AS effective_to, dimension, value, cast(multiplier as decimal(9,4)) AS multiplier, scope FROM (VALUES
  ('x1', 'anthropic', 'alder', 'usd', '1990-01-01', NULL, 'inference_geo', 'us', '1.1', 'token_rates'),
  ('x2', 'anthropic', 'aspen', 'usd', '1995-01-01', NULL, 'inference_geo', 'us', '1.1', 'all'),
  ('x3', 'openai', 'oak', 'usd', '1990-01-01', NULL, 'service_tier', 'fast', '2', 'token_rates'),
  ('x4', 'openai', 'oak', 'credits', '1990-01-01', NULL, 'service_tier', 'fast', '2', 'token_rates'),
  ('x5', 'openai', 'oak', 'usd', '1996-01-01', '1997-01-01', 'service_tier', 'fast', '1.25', 'token_rates')
) AS t(id, provider, canonical_model, kind, f, e, dimension, value, multiplier, scope)
"""

POLICIES = """
SELECT rate_id, dimension, allowed_a, allowed_b, default_value FROM (VALUES
  ('r1', 'inference_geo', 'global', 'us', 'global'), ('r2', 'inference_geo', 'global', 'us', NULL),
  ('r5', 'service_tier', 'fast', 'standard', 'standard'), ('r6', 'service_tier', 'fast', 'standard', 'standard')
) AS t(rate_id, dimension, allowed_a, allowed_b, default_value)
"""

OVERRIDES = """
SELECT id, provider, canonical_model, dimension, value, {stamp_from} AS effective_from, {stamp_to} AS effective_to FROM (VALUES
  ('o1', 'Anthropic', 'alder', 'Inference_Geo', 'us', '1992-06-01', '1993-01-01'), ('o2', 'openai', 'oak', 'service_tier', 'standard', '1995-01-01', '1995-07-01'),
  ('o3', 'openai', 'oak', 'auth_mode', 'chatgpt', '1996-01-01', '1996-03-01')
) AS t(id, provider, canonical_model, dimension, value, f, e)
"""

BUCKETS = """
SELECT concat('b', cast(extract(year from d) as {string}), '-', cast(extract(month from d) as {string}), '-', provider, '-', raw_model) AS bucket_id,
  CASE WHEN extract(month from d) % 2 = 0 THEN 'usage_api' ELSE 'usage_csv' END AS source_kind, provider,
  CASE WHEN extract(month from d) = 5 THEN cast(NULL as {string}) WHEN extract(month from d) = 6 THEN upper(raw_model) ELSE raw_model END AS model,
  d AS bucket_start, {month_end} AS bucket_end,
  CASE WHEN extract(month from d) IN (7, 8) THEN cast(NULL as bigint) ELSE n END AS request_count,
  CASE WHEN extract(month from d) = 7 THEN cast(NULL as bigint) WHEN extract(month from d) = 3 THEN u + 1 ELSE u END AS input_tokens_uncached,
  CASE WHEN extract(month from d) IN (7, 8) THEN cast(NULL as bigint) ELSE c END AS input_tokens_cached,
  CASE WHEN extract(month from d) = 7 THEN cast(NULL as bigint) ELSE o END AS output_tokens,
  cast(u as decimal(18,6)) AS provider_metered_usd
FROM (SELECT provider, raw_model, d, cast(count(*) as bigint) AS n, cast(sum(uncached) as bigint) AS u, cast(sum(cached) as bigint) AS c, cast(sum(output) as bigint) AS o
  FROM (SELECT provider, raw_model, {month_start} AS d, input_tokens_uncached AS uncached, input_tokens_cached AS cached, output_tokens_total AS output FROM canonical) m
  GROUP BY provider, raw_model, d) g
WHERE extract(month from d) <> 11
"""


def _text(view: str, dialect: str) -> str:
    kind, string = (SPARK, "string") if dialect == "spark" else (DUCK, "varchar")
    stamp = "cast({} as timestamp)"
    if dialect == "spark":
        month = {"month_start": "date_trunc('month', occurred_at)", "month_end": "add_months(cast(d as date), 1)", "us_ts": "unix_micros(cast(ts as timestamp))"}
        month["month_end"] = f"cast({month['month_end']} as timestamp)"
    else:
        month = {"month_start": "cast(date_trunc('month', occurred_at) as timestamp)", "month_end": "d + to_months(1)", "us_ts": "epoch_us(ts)"}
    return view.format(string=string, event_ts=kind["event_ts"], stamp_from=stamp.format("f"), stamp_to=stamp.format("e"), **month)


def view(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """A view as a DataFrame; tables are read from sf_dir, other names are given."""
    sql = _text(text, "spark")
    for name in re.findall(r"FROM (\w+)\b(?!\()", sql):
        if name in ("lineitem", "events", "orders", "customer", "documents", "pages", "part", "supplier"):
            frames.setdefault(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    for name in frames:
        sql = re.sub(rf"FROM {name}\b", f"FROM {{{name}}}", sql)
    return spark.sql(sql, **frames) if frames else spark.sql(sql)


def duck(text: str) -> str:
    """A view as DuckDB SQL."""
    return _text(text, "duck").strip()
