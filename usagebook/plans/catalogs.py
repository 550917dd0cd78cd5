"""Queries that check catalog documents and overrides: parts as the records of many documents, customers as overrides.

A document holds the records of 400 parts, so documents grow with the table. The
records have every defect that the checks know, by the part's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.operators import verification
from usagebook.operators.verification import Records

# What both dialects read alike; {string_div} and the tables are filled in for each.
_PARTS = """SELECT {string_div} AS document, k, k % 400 AS f, k % 400 + size - 2 AS e, 's' || (k % 397) AS source,
  CASE WHEN k % 29 = 0 THEN 0 WHEN k % 31 = 0 THEN 2 ELSE 1 END AS cited FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_size AS size FROM {part}) q"""
_ALIASES = """SELECT document, CASE WHEN k % 97 = 0 THEN ' ' WHEN k % 53 = 0 THEN 'a' || (k - 1) ELSE 'a' || k END AS id, 'anthropic' AS provider, 'x' || (k % 40) AS raw_model,
  CASE WHEN k % 71 = 0 THEN ' ' ELSE 'm' || (k % 60) END AS canonical_model, f, e, source, cited FROM parts"""
_RATES = """SELECT document, k, CASE WHEN k % 61 = 0 THEN 'a' || k ELSE 'r' || k END AS id, 'm' || (k % 60) AS canonical_model, CASE WHEN k % 30 = 0 THEN 0 ELSE 1000000 END AS unit_scale, (k * 7) % 400 AS f, (k * 7) % 400 + e - f AS e,
  (k % 5) * 100 AS low, CASE WHEN k % 7 > 0 THEN (k % 3) * 200 END AS high, CASE WHEN k % 21 = 0 THEN '-1' WHEN k % 23 = 0 THEN '1000000001' ELSE '1' END AS input,
  CASE WHEN k % 17 = 0 THEN '0' WHEN k % 101 = 0 THEN '-2000000000' ELSE '10' END AS tool, CASE WHEN k % 19 = 0 THEN 0 ELSE 1000 END AS per_units, k % 2 = 0 AS free,
  CASE WHEN k % 13 = 0 THEN 0 WHEN k % 14 = 0 THEN 1 ELSE 2 END AS policy, CASE WHEN k % 37 = 0 THEN 'slow' ELSE 'fast' END AS target, source, cited FROM parts"""
_MODIFIERS = """SELECT document, 'm' || k AS id, 'm' || (k % 74) AS canonical_model, (k * 11) % 400 AS f, (k * 11) % 400 + e - f + 2 AS e,
  CASE WHEN k % 43 = 0 THEN '0' WHEN k % 47 = 0 THEN '2000000000' ELSE '2' END AS multiplier, CASE WHEN k % 59 > 0 THEN CASE WHEN k % 2 = 0 THEN 'fast' ELSE 'slow' END END AS speed, source, cited FROM parts"""
_HEADS = """SELECT document, CASE WHEN d % 5 = 1 THEN 2 ELSE 1 END AS schema_version, CASE WHEN d % 7 = 2 THEN ' ' ELSE 'rev-' || d END AS revision, d AS published,
  CASE WHEN d % 3 = 1 THEN d - 1 ELSE d + 1 END AS verified, d % 4 * 10 AS days FROM (SELECT document, CAST(substr(document, 2) AS BIGINT) AS d FROM parts) q GROUP BY document, d"""
_OVERRIDES = """SELECT {string_div} AS document, CASE WHEN k % 33 = 0 THEN 'o' || (k - 1) WHEN k % 83 = 0 THEN '' ELSE 'o' || k END AS id, CASE WHEN k % 2 = 0 THEN 'Anthropic' ELSE 'anthropic' END AS provider,
  CASE WHEN k % 70 = 0 THEN ' ' ELSE 'm' || (k % 60) END AS canonical_model,
  CASE k % 6 WHEN 0 THEN 'service_tier' WHEN 1 THEN 'Speed' WHEN 2 THEN 'colour' ELSE 'speed' END AS dimension,
  CASE k % 7 WHEN 0 THEN 'QUICK' WHEN 1 THEN 'slow' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'standard' WHEN 4 THEN '' ELSE 'fast' END AS value, (k * 7) % 400 AS f, (k * 7) % 400 + k % 31 - 1 AS e
  FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM {customer}) q"""
_DUCK = {"string_div": "'d' || (k // 400)", "part": "part", "customer": "customer"}
_SPARK = {"string_div": "concat('d', k div 400)"}
_WITH = f"""WITH parts AS ({_PARTS.format(**_DUCK)}), a AS ({_ALIASES}), r AS ({_RATES}), m AS ({_MODIFIERS}), h AS ({_HEADS}), s AS (SELECT document, source AS id, k FROM parts),
p AS (SELECT *, unnest(CASE policy WHEN 0 THEN [] WHEN 1 THEN ['fast'] ELSE ['fast', 'standard'] END) AS value FROM r),
c AS (SELECT document, id, f, e, source, cited FROM a UNION ALL SELECT document, id, f, e, source, cited FROM r UNION ALL SELECT document, id, f, e, source, cited FROM m)"""
_PAIR = "SELECT a.document, '{}' AS code, least(a.id, b.id) AS record_id, greatest(a.id, b.id) AS detail, count(*) AS n FROM {} a JOIN {} b ON a.document = b.document AND a.rn < b.rn AND a.f < b.e AND b.f < a.e AND {} GROUP BY 1, 3, 4"
_NUMBERED = "(SELECT *, row_number() OVER () AS rn FROM {})"
_ISSUES = f"""{_WITH}, na AS MATERIALIZED {_NUMBERED.format('a')}, nr AS MATERIALIZED {_NUMBERED.format('r')}, nm AS MATERIALIZED {_NUMBERED.format('m')},
single AS (
  SELECT document, 'schema_version' AS code, '' AS id, '' AS detail FROM h WHERE schema_version <> 1 UNION ALL SELECT document, 'empty_revision', '', '' FROM h WHERE trim(revision) = ''
  UNION ALL SELECT document, 'verification_before_publication', '', '' FROM h WHERE verified < published UNION ALL SELECT document, 'zero_stale_window', '', '' FROM h WHERE days = 0
  UNION ALL SELECT document, 'source_url', id, '' FROM s WHERE k % 41 = 0 UNION ALL SELECT document, 'empty_record_id', id, '' FROM c WHERE trim(id) = ''
  UNION ALL SELECT document, 'invalid_effective_interval', id, '' FROM c WHERE e <= f UNION ALL SELECT document, 'missing_source', id, '' FROM c WHERE cited = 0
  UNION ALL SELECT document, 'empty_alias_field', id, '' FROM a WHERE trim(canonical_model) = '' UNION ALL SELECT document, 'zero_unit_scale', id, '' FROM r WHERE unit_scale = 0
  UNION ALL SELECT document, 'invalid_context_interval', id, '' FROM r WHERE high <= low UNION ALL SELECT document, 'negative_rate', id, 'input' FROM r WHERE CAST(input AS BIGINT) < 0
  UNION ALL SELECT document, 'rate_magnitude', id, 'input' FROM r WHERE abs(CAST(input AS BIGINT)) > 1000000000 UNION ALL SELECT document, 'zero_tool_scale', id, 'web_search_requests' FROM r WHERE per_units = 0
  UNION ALL SELECT document, 'invalid_tool_rate', id, 'web_search_requests' FROM r WHERE CAST(tool AS BIGINT) < 0 OR (CAST(tool AS BIGINT) = 0 AND NOT free)
  UNION ALL SELECT document, 'tool_rate_magnitude', id, 'web_search_requests' FROM r WHERE abs(CAST(tool AS BIGINT)) > 1000000000
  UNION ALL SELECT document, 'empty_dimension_policy', id, 'speed' FROM r WHERE policy = 0 UNION ALL SELECT document, 'duplicate_dimension_value', id, 'speed' FROM r WHERE policy = 1
  UNION ALL SELECT document, 'invalid_dimension_default', id, 'speed' FROM r WHERE policy < 2 UNION ALL SELECT document, 'invalid_dimension_alias', id, 'speed=' || target FROM r WHERE policy = 0 OR target = 'slow'
  UNION ALL SELECT document, 'invalid_modifier', id, '' FROM m WHERE multiplier = '0' UNION ALL SELECT document, 'modifier_magnitude', id, '' FROM m WHERE multiplier = '2000000000'
  UNION ALL SELECT document, 'empty_modifier_selector', id, '' FROM m WHERE speed IS NULL
  UNION ALL SELECT document, 'orphan_modifier', id, '' FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.document = m.document AND r.canonical_model = m.canonical_model AND r.f < m.e AND m.f < r.e)
  UNION ALL SELECT document, 'unreachable_modifier', id, 'speed=' || speed FROM m WHERE speed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.document = m.document AND p.canonical_model = m.canonical_model AND p.value = m.speed AND p.f < m.e AND m.f < p.e)),
issues AS (SELECT document, code, id AS record_id, detail, 1 AS n FROM single UNION ALL SELECT document, 'duplicate_source', id, '', count(*) - 1 FROM s GROUP BY 1, 3 HAVING count(*) > 1
  UNION ALL SELECT document, 'duplicate_record_id', id, '', count(*) - 1 FROM c WHERE trim(id) <> '' GROUP BY 1, 3 HAVING count(*) > 1
  UNION ALL SELECT document, 'unknown_source', id, 'zz', count(*) FROM c WHERE cited = 2 GROUP BY 1, 3
  UNION ALL SELECT document, 'collection_limit', name, CAST(count(*) AS VARCHAR), 1 FROM (SELECT document, unnest(['sources', 'aliases', 'rates', 'modifiers']) AS name FROM parts) q GROUP BY 1, 3 HAVING count(*) > 390
  UNION ALL {_PAIR.format('overlapping_alias', 'na', 'na', 'a.raw_model = b.raw_model')}
  UNION ALL {_PAIR.format('overlapping_rate', 'nr', 'nr', 'a.canonical_model = b.canonical_model AND (b.high IS NULL OR a.low < b.high) AND (a.high IS NULL OR b.low < a.high)')}
  UNION ALL {_PAIR.format('duplicate_modifier', 'nm', 'nm', 'a.canonical_model = b.canonical_model AND a.speed IS NOT DISTINCT FROM b.speed')})"""

#: A document of the test tables has at most 400 records of a kind; the limit is such that most exceed it.
LIMIT = 390


def _day(c: str) -> Column:
    return F.timestamp_seconds(F.lit(788918400) + F.col(c) * 86400)


def part_records(spark: SparkSession, d: str) -> Records:
    """Parts as the records of documents."""
    parts = spark.sql(_PARTS.format(string_div=_SPARK["string_div"], part="{part}"), part=spark.read.parquet(f"{d}/part.parquet"))
    made = lambda text: spark.sql(text.replace("FROM parts", "FROM {parts}"), parts=parts)
    span = [_day("f").alias("effective_from"), _day("e").alias("effective_to")]
    cited = F.when(F.col("cited") == 0, F.array().cast("array<string>")).when(F.col("cited") == 1, F.array("source")).otherwise(F.array(F.col("source"), F.lit("zz"))).alias("source_ids")
    fixed = [F.lit("anthropic").alias("provider"), "canonical_model", F.lit("usd_api_equivalent").alias("kind"), *span, cited]
    text = lambda *values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    allowed = F.when(F.col("policy") == 0, text()).when(F.col("policy") == 1, text("fast", "fast")).otherwise(text("fast", "standard"))
    policy = F.struct(allowed.alias("allowed"), F.lit("standard").alias("default"), F.create_map(F.lit("quick"), "target").alias("aliases"))
    tool = F.struct(F.col("tool").alias("rate"), F.col("per_units").cast("long").alias("per_units"), F.col("free").alias("explicit_free"))
    heads = made(_HEADS).select("document", "schema_version", "revision", F.sha2("document", 256).alias("sha256"), _day("published").alias("published_at"), _day("verified").alias("verified_at"), F.col("days").alias("stale_after_days"))
    sources = parts.select("document", F.col("source").alias("id"), F.concat(F.when(F.col("k") % 41 == 0, "http").otherwise("https"), F.lit("://example.com")).alias("url"))
    aliases = made(_ALIASES).select("document", "id", "provider", "raw_model", "canonical_model", *span, cited)
    rates = made(_RATES).select(
        "document", "id", *fixed, F.col("unit_scale").cast("long").alias("unit_scale"), F.col("low").alias("min_input_tokens"), F.col("high").alias("max_input_tokens_exclusive"),
        F.create_map(F.lit("input"), "input", F.lit("output"), F.lit("1")).alias("prices"), F.create_map(F.lit("web_search_requests"), tool).alias("tool_rates"), F.create_map(F.lit("speed"), policy).alias("dimension_policies"),
    )
    selectors = F.when(F.col("speed").isNull(), F.expr("cast(map() as map<string, string>)")).otherwise(F.create_map(F.lit("speed"), "speed"))
    modifiers = made(_MODIFIERS).select("document", "id", *fixed, selectors.alias("selectors"), "multiplier", F.lit("all").alias("scope"))
    return Records(heads, sources, aliases, rates, modifiers)


def catalog_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every issue of every document."""
    return verification.verify(part_records(spark, d), LIMIT)


def catalog_documents(spark: SparkSession, d: str) -> DataFrame:
    """A row for each document: freshness, counts, validity."""
    records = part_records(spark, d)
    rows = verification.status(records, verification.verify(records, LIMIT), "1995-01-16")
    dates = [F.unix_micros(c).alias(c) for c in ("published_at", "verified_at", "stale_at")]
    return rows.select("document", "revision", *dates, "freshness", "sources", "aliases", "rates", "modifiers", "issues", "valid")


def override_checks(spark: SparkSession, d: str) -> DataFrame:
    """Customers as overrides, against the rates of the document with the same number."""
    rows = spark.sql(_OVERRIDES.format(string_div=_SPARK["string_div"], customer="{customer}"), customer=spark.read.parquet(f"{d}/customer.parquet"))
    own = rows.select("document", "id", "provider", "canonical_model", "dimension", "value", _day("f").alias("effective_from"), _day("e").alias("effective_to"))
    return verification.override_issues(own, part_records(spark, d).rates)


QUERIES = {"catalog_verify": catalog_verify, "catalog_documents": catalog_documents, "override_checks": override_checks}
_US = "(788918400 + {} * 86400) * 1000000"
_COUNT = "CAST((SELECT count(*) FROM parts q WHERE q.document = h.document) AS BIGINT)"
ORACLE_SQL = {
    "catalog_verify": f"{_ISSUES} SELECT document, code, record_id, detail, CAST(n AS BIGINT) AS n FROM issues",
    "catalog_documents": f"""{_ISSUES} SELECT h.document, revision, {_US.format('published')} AS published_at, {_US.format('verified')} AS verified_at, {_US.format('(verified + days)')} AS stale_at,
CASE WHEN published > 15 THEN 'future_dated' WHEN 15 > verified + days THEN 'stale' ELSE 'fresh' END AS freshness, {_COUNT} AS sources, {_COUNT} AS aliases, {_COUNT} AS rates, {_COUNT} AS modifiers,
CAST(coalesce(i.n, 0) AS BIGINT) AS issues, coalesce(i.n, 0) = 0 AS valid FROM h LEFT JOIN (SELECT document, sum(n) AS n FROM issues GROUP BY document) i ON i.document = h.document""",
    "override_checks": f"""{_WITH}, o AS (SELECT *, lower(dimension) AS dim, lower(value) AS val, row_number() OVER () AS rn FROM ({_OVERRIDES.format(**_DUCK)}) q), met AS (SELECT o.rn, bool_or(NOT (
  CASE WHEN o.val = 'quick' THEN r.target ELSE o.val END IN ('fast', 'standard') AND (r.policy = 2 OR (r.policy = 1 AND CASE WHEN o.val = 'quick' THEN r.target ELSE o.val END = 'fast')))) AS bad
  FROM o JOIN r ON o.document = r.document AND o.canonical_model = r.canonical_model AND o.dim = 'speed' AND o.f < r.e AND r.f < o.e GROUP BY o.rn)
SELECT document, code, record_id, detail, CAST(n AS BIGINT) AS n FROM (
  SELECT document, 'override_empty_field' AS code, id AS record_id, 'id' AS detail, 1 AS n FROM o WHERE id = '' UNION ALL SELECT document, 'override_empty_field', id, 'canonical_model', 1 FROM o WHERE trim(canonical_model) = ''
  UNION ALL SELECT document, 'override_empty_field', id, 'value', 1 FROM o WHERE value = '' UNION ALL SELECT document, 'override_empty_interval', id, '', 1 FROM o WHERE f >= e
  UNION ALL SELECT document, 'override_unsupported_dimension', id, '', 1 FROM o WHERE dimension = 'colour' UNION ALL SELECT document, 'override_unresolved_value', id, '', 1 FROM o WHERE val = 'unknown'
  UNION ALL SELECT document, 'override_duplicate_id', id, '', count(*) - 1 FROM o WHERE id <> '' GROUP BY 1, 3 HAVING count(*) > 1
  UNION ALL SELECT document, 'override_undocumented', id, '', 1 FROM o WHERE rn NOT IN (SELECT rn FROM met)
  UNION ALL SELECT document, 'override_unsupported_value', id, val, 1 FROM o WHERE val NOT IN ('', 'unknown') AND rn IN (SELECT rn FROM met WHERE bad)
  UNION ALL {_PAIR.format('override_overlap', 'o', 'o', 'lower(a.provider) = lower(b.provider) AND a.canonical_model = b.canonical_model AND a.dim = b.dim')}) x""",
}
