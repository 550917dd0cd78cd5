"""The price catalog document, overrides and cash evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.functions.tables import written
from usagebook.operators.pricing import Catalog
from usagebook.operators.verification import Records

_INTERVAL = "effective_from: timestamp, effective_to: timestamp"
CATALOG = f"""
schema_version int, revision string, published_at timestamp, verified_at timestamp, stale_after_days int,
sources array<struct<id: string, title: string, url: string, retrieved_at: timestamp, note: string>>,
aliases array<struct<id: string, provider: string, raw_model: string, canonical_model: string, {_INTERVAL}, source_ids: array<string>>>,
rates array<struct<id: string, provider: string, canonical_model: string, kind: string, unit_scale: bigint, {_INTERVAL}, min_input_tokens: bigint, max_input_tokens_exclusive: bigint,
  rates: struct<input: string, cache_read: string, cache_write: string, cache_write_5m: string, cache_write_1h: string, output: string>,
  tool_rates: map<string, struct<rate: string, per_units: bigint, explicit_free: boolean>>,
  dimension_policies: map<string, struct<allowed: array<string>, `default`: string, aliases: map<string, string>>>,
  cache_write_observation_required: boolean, source_ids: array<string>>>,
modifiers array<struct<id: string, provider: string, canonical_model: string, kind: string, {_INTERVAL}, selectors: map<string, string>, multiplier: string, scope: string, source_ids: array<string>>>
"""
OVERRIDES = "id string, provider string, canonical_model string, dimension string, value string, effective_from timestamp, effective_to timestamp, attested_at timestamp, note string"
ONE_TIME = "id string, provider string, category string, amount_usd decimal(18,6), charged_at timestamp, attested_at timestamp, source_note string"
RECURRING = "id string, provider string, amount_usd decimal(18,6), cadence string, effective_from timestamp, effective_to timestamp, attested_at timestamp, source_note string"
COMPLETENESS = "id string, provider string, effective_from timestamp, effective_to timestamp, attested_at timestamp, source_note string"
COMPONENTS = ("input", "cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "output")
_KINDS = {"usd_api_equivalent": "usd", "codex_credits": "credits"}


def catalog(spark: SparkSession, path: str, overrides: DataFrame | None = None) -> Catalog:
    """A catalog document as tables; decimals are read as text, so none passes through a float."""
    doc = spark.read.json(path, schema=CATALOG, multiLine=True)
    each = lambda c: doc.select(F.explode(c).alias("r"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in _KINDS.items() for x in (F.lit(k), F.lit(v))]), F.col("r.kind")), F.col("r.kind"))
    dec = lambda c, t="decimal(18,9)": F.col(c).cast(t)
    tool = lambda t: F.try_element_at(F.col("r.tool_rates"), F.lit(t))
    rates = each("rates").select(
        "r.id", F.lower("r.provider").alias("provider"), "r.canonical_model", kind.alias("kind"), "r.unit_scale", "r.effective_from", "r.effective_to", "r.min_input_tokens", "r.max_input_tokens_exclusive",
        *[dec(f"r.rates.{c}").alias(c) for c in ("input", "cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "output")],
        # one scale for both tools: a rate for each unit
        *[(tool(f"{t}_requests")["rate"].cast("decimal(18,9)") / tool(f"{t}_requests")["per_units"]).cast("decimal(18,9)").alias(t) for t in ("web_search", "web_fetch")], F.lit(1).cast("long").alias("tool_per_units"),
        F.coalesce("r.cache_write_observation_required", F.lit(False)).alias("cache_write_observation_required"), "r.source_ids",
    )
    policies = each("rates").select(F.col("r.id").alias("rate_id"), F.explode("r.dimension_policies").alias("dimension", "p")).select("rate_id", "dimension", "p.allowed", F.col("p.default").alias("default_value"), F.coalesce("p.aliases", F.expr("cast(map() as map<string, string>)")).alias("value_aliases"))
    scope = F.when(F.col("r.scope") == "all", "all").otherwise(F.col("r.scope"))
    modifiers = each("modifiers").select("r.id", F.lower("r.provider").alias("provider"), "r.canonical_model", kind.alias("kind"), "r.effective_from", "r.effective_to", "r.selectors", dec("r.multiplier", "decimal(9,4)").alias("multiplier"), scope.alias("scope"))
    aliases = each("aliases").select("r.id", F.lower("r.provider").alias("provider"), "r.raw_model", "r.canonical_model", "r.effective_from", "r.effective_to", "r.source_ids")
    return Catalog(aliases, rates, policies, modifiers, overrides)


def catalog_records(spark: SparkSession, path: str) -> Records:
    """The records of catalog documents as they are written, for checks; a document is known by its path.

    Each document is read once and stored parsed. One that is no JSON object has a
    header of nulls and no records.
    """
    files = spark.read.format("binaryFile").load(path)
    parsed = files.select(F.col("path").alias("document"), F.sha2("content", 256).alias("sha256"), F.from_json(F.col("content").cast("string"), CATALOG).alias("doc"))
    docs = written(parsed, "catalogs")
    each = lambda c: docs.select("document", F.explode(f"doc.{c}").alias("r")).select("document", "r.*")
    prices = F.create_map(*[x for c in COMPONENTS for x in (F.lit(c), F.col(f"rates.{c}"))])
    headers = docs.select("document", "sha256", *[f"doc.{c}" for c in ("schema_version", "revision", "published_at", "verified_at", "stale_after_days")])
    return Records(headers, each("sources"), each("aliases"), each("rates").withColumn("prices", prices).drop("rates"), each("modifiers"))


def catalog_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=CATALOG, multiLine=True).select(F.inline("sources"))


def evidence_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Overrides or cash evidence from CSV, JSON lines or Parquet, by the path's ending."""
    if path.endswith(".csv"):
        return spark.read.csv(path, schema=schema, header=True)
    return spark.read.json(path, schema=schema) if path.endswith((".json", ".jsonl")) else spark.read.schema(schema).parquet(path)
