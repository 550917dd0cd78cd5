"""Provider exports: own JSON and CSV form, and two vendors' admin pages, as buckets of one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.functions.values import flexible_instant, provider_name, sanitised
from usagebook.operators.reconcile import COUNTED, ROUTING
from usagebook.sources.common import text_at

#: Names under which forms report a counter (fixed values).
SYNONYMS = {
    "request_count": ("request_count", "num_model_requests", "requests"),
    "input_tokens_uncached": ("input_tokens_uncached", "uncached_input_tokens"),
    "input_tokens_cached": ("input_tokens_cached", "input_cached_tokens", "cache_read_input_tokens", "cached_input_tokens"),
    "cache_write_5m_tokens": ("cache_write_5m_tokens", "cache_creation.ephemeral_5m_input_tokens"),
    "cache_write_1h_tokens": ("cache_write_1h_tokens", "cache_creation.ephemeral_1h_input_tokens"),
    "cache_write_unknown_tokens": ("cache_write_unknown_tokens", "cache_creation_input_tokens"),
    "output_tokens": ("output_tokens",),
}
FORMATS = ("canonical_json", "canonical_csv", "vendor_pages_a", "vendor_pages_b")


def whole(v: str, path: str) -> Column:
    """A non-negative whole number, as a number or as digits."""
    text = F.try_variant_get(v, path, "string")
    return F.when(text.rlike(r"^\d{1,18}$"), text.cast("long"))


def counter(v: str, name: str) -> Column:
    return F.coalesce(*[whole(v, f"$.{s}") for s in SYNONYMS[name]])


def usd(v: str) -> Column:
    """An amount in USD from the places where forms put it; null in another currency."""
    found = F.coalesce(*[F.expr(f"try_cast(try_variant_get({v}, '{p}', 'string') as decimal(18,6))") for p in ("$.provider_metered_usd", "$.amount.value", "$.amount", "$.cost.amount", "$.cost_usd", "$.usd")])
    currency = F.coalesce(text_at(v, "$.amount.currency"), text_at(v, "$.currency"), text_at(v, "$.cost.currency"), F.lit("usd"))
    return F.when((F.lower(currency) == "usd") & (found >= 0), found)


def detected(files: DataFrame) -> DataFrame:
    """Adds v and format to whole documents (value)."""
    head = F.substring(F.ltrim("value"), 1, 1)
    out = files.withColumn("v", F.when(head.isin("{", "["), F.try_parse_json("value")))
    has = lambda p: F.try_variant_get("v", p, "variant").isNotNull()
    kind = (
        F.when(~head.isin("{", "["), "canonical_csv")
        .when(has("$.buckets"), "canonical_json")
        .when(has("$.data[0].results") | has("$.data[0].start_time"), "vendor_pages_a")
        .when(has("$.data[0].starting_at") | has("$.data[0].cache_creation"), "vendor_pages_b")
    )
    return out.withColumn("format", kind)


def _bucket(df: DataFrame, v: str, start: Column, end: Column, provider: Column, kind: Column) -> DataFrame:
    routing = [F.when(text_at(v, f"$.{c}").isNotNull(), sanitised(text_at(v, f"$.{c}"), 64)).alias(c) for c in ROUTING]
    return df.select("import_id", kind.alias("source_kind"), start.alias("bucket_start"), end.alias("bucket_end"), provider_name(provider).alias("provider"), text_at(v, "$.model").alias("model"), *[counter(v, c).alias(c) for c in COUNTED], usd(v).alias("provider_metered_usd"), *routing)


def canonical_json(files: DataFrame) -> DataFrame:
    rows = files.where("format = 'canonical_json'").select("import_id", text_at("v", "$.source_kind").alias("_kind"), F.explode(F.try_variant_get("v", "$.buckets", "array<variant>")).alias("b"))
    return _bucket(rows, "b", flexible_instant(F.try_variant_get("b", "$.bucket_start", "string")), flexible_instant(F.try_variant_get("b", "$.bucket_end", "string")), text_at("b", "$.provider"), F.coalesce(text_at("b", "$.source_kind"), "_kind"))


def vendor_pages_a(files: DataFrame) -> DataFrame:
    """Pages of buckets with nested results; input tokens include cached ones."""
    page = files.where("format = 'vendor_pages_a'").select("import_id", F.explode(F.try_variant_get("v", "$.data", "array<variant>")).alias("p"))
    rows = page.select("import_id", "p", F.explode(F.try_variant_get("p", "$.results", "array<variant>")).alias("r"))
    return rows.select("import_id", F.lit("openai_organization").alias("source_kind"), flexible_instant(F.try_variant_get("p", "$.start_time", "string")).alias("bucket_start"), flexible_instant(F.try_variant_get("p", "$.end_time", "string")).alias("bucket_end"), F.lit("openai").alias("provider"), text_at("r", "$.model").alias("model"), *[F.coalesce(counter("r", c), F.greatest(whole("r", "$.input_tokens") - F.coalesce(counter("r", "input_tokens_cached"), F.lit(0)), F.lit(0)) if c == "input_tokens_uncached" else F.lit(None).cast("long")).alias(c) for c in COUNTED], usd("r").alias("provider_metered_usd"), *[F.lit(None).cast("string").alias(c) for c in ROUTING])


def vendor_pages_b(files: DataFrame) -> DataFrame:
    """Flat pages; counters may be digit strings."""
    rows = files.where("format = 'vendor_pages_b'").select("import_id", F.explode(F.try_variant_get("v", "$.data", "array<variant>")).alias("r"))
    return _bucket(rows, "r", flexible_instant(F.try_variant_get("r", "$.starting_at", "string")), flexible_instant(F.try_variant_get("r", "$.ending_at", "string")), F.lit("anthropic"), F.lit("anthropic_admin"))


def header(name: str) -> str:
    """A CSV header's canonical form."""
    return name.strip().lower().replace("-", "_").replace(" ", "_").lstrip("﻿")


def canonical_csv(spark: SparkSession, path: str, import_id: int = 0) -> DataFrame:
    """A CSV of any column order; blank is unknown."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", nullValue="")
    raw = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(header(c)) for c in raw.columns])
    return _csv_buckets(raw, F.lit(import_id).cast("long"), lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string"))


def _csv_buckets(rows: DataFrame, import_id: Column, col: Callable[[str], Column]) -> DataFrame:
    return rows.select(
        import_id.alias("import_id"), col("source_kind").alias("source_kind"), flexible_instant(col("bucket_start")).alias("bucket_start"), flexible_instant(col("bucket_end")).alias("bucket_end"), provider_name(col("provider")).alias("provider"), col("model").alias("model"),
        *[F.when(col(c).rlike(r"^\d{1,18}$"), col(c).cast("long")).alias(c) for c in COUNTED], col("provider_metered_usd").try_cast("decimal(18,6)").alias("provider_metered_usd"), *[F.when(col(c).isNotNull(), sanitised(col(c), 64)).alias(c) for c in ROUTING],
    )


def _cells(record: Column) -> Column:
    """The trimmed cells of a CSV record, null where blank; quotes may enclose commas, line ends and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',[ \t]*("(?:[^"]++|"")*+"|[^,]*+)'), F.lit(1))
    plain = lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(F.rtrim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(raw, lambda c: F.nullif(F.trim(plain(c)), F.lit("")))


def csv_documents(files: DataFrame) -> DataFrame:
    """CSV documents (value) of any column order and width, each with its own header; blank is unknown."""
    records = F.regexp_extract_all(F.regexp_replace("value", "\r\n?", "\n"), F.lit(r'(?:[^"\n]++|"(?:[^"]++|"")*+")++'), F.lit(0))
    text = files.where("format = 'canonical_csv'").select("import_id", F.filter(records, lambda r: F.trim(r) != "").alias("records"))
    names = F.transform(_cells(F.try_element_at("records", F.lit(1))), lambda c: F.translate(F.lower(F.replace(c, F.lit("\ufeff"), F.lit(""))), "- ", "__"))
    rows = text.select("import_id", names.alias("names"), F.explode(F.slice("records", 2, F.greatest(F.size("records"), F.lit(1)))).alias("record"))
    rows = rows.select("import_id", "names", _cells(F.col("record")).alias("cells"))

    def column(name: str) -> Column:
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.when(at > 0, F.try_element_at("cells", at))

    return _csv_buckets(rows, F.col("import_id"), column)


def buckets(files: DataFrame) -> DataFrame:
    """Buckets of documents (import_id, value) of any form."""
    known = detected(files)
    return canonical_json(known).unionByName(vendor_pages_a(known)).unionByName(vendor_pages_b(known)).unionByName(csv_documents(known))


def import_issues(files: DataFrame) -> DataFrame:
    """(import_id, code) of documents (import_id, value) that can't be imported as they are: no JSON, no known form, no bucket, a negative amount."""
    known = detected(files)
    json = F.substring(F.ltrim("value"), 1, 1).isin("{", "[")
    code = F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty_document").when(json & F.col("v").isNull(), "invalid_json").when(F.col("format").isNull(), "unknown_format")
    unread = known.select("import_id", code.alias("code")).where("code is not null")
    full = buckets(files).select("import_id").distinct()
    bare = known.select("import_id").join(unread, "import_id", "left_anti").join(full, "import_id", "left_anti").select("import_id", F.lit("no_buckets").alias("code"))
    amounts = F.regexp_extract_all("value", F.lit(r'"(?:provider_metered_usd|amount|value|cost_usd|usd)"\s*:\s*"?(-?\d)'), F.lit(1))
    negative = known.where(json & F.exists(amounts, lambda a: a.startswith("-"))).select("import_id", F.lit("negative_amount").alias("code"))
    credit = csv_documents(known).where("provider_metered_usd < 0").select("import_id", F.lit("negative_amount").alias("code"))
    return unread.unionByName(bare).unionByName(negative).unionByName(credit.distinct())
