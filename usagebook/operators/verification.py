"""Whole catalog documents, checked many at a time, and overrides checked against them.

A document is a key of its records, so that one job checks a catalog or all
revisions that a fleet has ever used. Every rule about one record is part of one
projection of its table; only identity, references and overlaps need a shuffle, by
document and key.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from usagebook.functions.values import overlaps
from usagebook.operators.catalog import overlapping

# Fixed values of the catalog's format.
SCHEMA_VERSION = 1
COLLECTION_LIMIT = 2_048
MAGNITUDE = 1_000_000_000
DIMENSIONS = ("auth_mode", "provider_route", "service_tier", "speed", "inference_geo")
UNRESOLVED_VALUES = ("unknown", "not_available", "not-available", "unavailable", "n/a", "null")


@dataclass
class Records:
    """The records of catalog documents, each with the column `document` and as written: nothing cast, nothing dropped.

    headers: schema_version, revision, sha256, published_at, verified_at, stale_after_days. sources: id, url.
    aliases: id, provider, raw_model, canonical_model, effective_from, effective_to, source_ids.
    rates: id, provider, canonical_model, kind, unit_scale, effective_from, effective_to, min_input_tokens, max_input_tokens_exclusive,
    prices (component to text), tool_rates, dimension_policies, source_ids.
    modifiers: id, provider, canonical_model, kind, effective_from, effective_to, selectors, multiplier (text), scope, source_ids.
    """

    headers: DataFrame
    sources: DataFrame
    aliases: DataFrame
    rates: DataFrame
    modifiers: DataFrame


def blank(c: str | Column) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    return text.isNull() | ~text.rlike(r"(?U)\S")


def _number(text: Column) -> Column:
    return text.try_cast("decimal(38,18)")


def _too_large(text: Column) -> Column:
    """Beyond the magnitude, or no number at all."""
    return text.isNotNull() & F.coalesce(F.abs(_number(text)) > MAGNITUDE, F.lit(True))


def _said(code: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail"))


def _one(code: str, rule: Column) -> Column:
    return F.array_compact(F.array(F.when(rule, _said(code))))


def _each(code: str, entries: Column, rule, name=lambda e: e["key"]) -> Column:  # noqa: ANN001
    """An issue for each entry of a list that a rule holds for."""
    return F.transform(F.filter(entries, rule), lambda e: _said(code, name(e)))


def _listed(df: DataFrame, ident: str | None, *rules: Column) -> DataFrame:
    """(document, code, record_id, detail, n) of the rules about single records."""
    found = df.select("document", (F.col(ident) if ident else F.lit("")).alias("record_id"), F.explode(F.flatten(F.array_compact(F.array(*rules)))).alias("i"))
    return found.select("document", "i.code", F.coalesce("record_id", F.lit("")).alias("record_id"), "i.detail", F.lit(1).cast("long").alias("n"))


def _rows(df: DataFrame, code: str, record: str = "id", detail: str | None = None, n: Column | None = None) -> DataFrame:
    return df.select("document", F.lit(code).alias("code"), F.coalesce(record, F.lit("")).alias("record_id"), (F.coalesce(detail, F.lit("")) if detail else F.lit("")).alias("detail"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def _repeated(df: DataFrame, code: str) -> DataFrame:
    """Identifiers that stand more than once, with the number of times too many."""
    return _rows(df.where(~blank("id")).groupBy("document", "id").agg(F.count("*").alias("times")).where("times > 1"), code, n=F.col("times") - 1)


def _numbered(df: DataFrame) -> DataFrame:
    """With a number of the row, so that pairs of records with equal ids are pairs too."""
    return df.withColumn("row", F.monotonically_increasing_id())


def _pairs(df: DataFrame, code: str, keys: list[str], rule: Column | None = None) -> DataFrame:
    """Overlapping pairs of records, one row for each pair of ids, the lesser one first, with the number of such pairs."""
    found = overlapping(_numbered(df), ["document", *keys], ident="row")
    found = found if rule is None else found.where(rule)
    ids = found.select(F.col("a_document").alias("document"), F.least("a_id", "b_id").alias("id"), F.greatest("a_id", "b_id").alias("other"))
    return _rows(ids.groupBy("document", "id", "other").agg(F.count("*").alias("times")), code, detail="other", n=F.col("times"))


def _record(df: DataFrame) -> list[Column]:
    """The rules that hold for every kind of record."""
    return [
        _one("empty_record_id", blank("id")),
        _one("invalid_effective_interval", F.col("effective_to") <= F.col("effective_from")),
        _one("missing_source", F.coalesce(F.size("source_ids"), F.lit(0)) <= 0),
    ]


def _alias_rules(df: DataFrame) -> DataFrame:
    return _listed(df, "id", *_record(df), _one("empty_alias_field", blank("provider") | blank("raw_model") | blank("canonical_model")))


def _rate_rules(df: DataFrame) -> DataFrame:
    prices, tools, policies = (F.map_entries(c) for c in ("prices", "tool_rates", "dimension_policies"))
    allowed = lambda e: F.coalesce(e["value"]["allowed"], F.array().cast("array<string>"))
    default, price = (lambda e: e["value"]["default"]), (lambda e: _number(e["value"]["rate"]))
    targets = F.flatten(F.transform(policies, lambda e: F.transform(F.coalesce(F.map_values(e["value"]["aliases"]), F.array().cast("array<string>")), lambda v: F.struct(e["key"].alias("key"), v.alias("target"), allowed(e).alias("allowed")))))
    return _listed(
        df, "id", *_record(df),
        _one("zero_unit_scale", F.col("unit_scale") == 0),
        _one("invalid_context_interval", F.col("max_input_tokens_exclusive") <= F.col("min_input_tokens")),
        _each("negative_rate", prices, lambda e: _number(e["value"]) < 0),
        _each("rate_magnitude", prices, lambda e: _too_large(e["value"])),
        _each("zero_tool_scale", tools, lambda e: e["value"]["per_units"] == 0),
        _each("invalid_tool_rate", tools, lambda e: (price(e) < 0) | ((price(e) == 0) & ~F.coalesce(e["value"]["explicit_free"], F.lit(False)))),
        _each("tool_rate_magnitude", tools, lambda e: _too_large(e["value"]["rate"])),
        _each("empty_dimension_policy", policies, lambda e: F.size(allowed(e)) == 0),
        _each("duplicate_dimension_value", policies, lambda e: F.size(F.array_distinct(allowed(e))) < F.size(allowed(e))),
        _each("invalid_dimension_default", policies, lambda e: default(e).isNotNull() & ~F.array_contains(allowed(e), default(e))),
        _each("invalid_dimension_alias", targets, lambda e: ~F.array_contains(e["allowed"], e["target"]), lambda e: F.concat_ws("=", e["key"], e["target"])),
    )


def _modifier_rules(df: DataFrame) -> DataFrame:
    return _listed(
        df, "id", *_record(df),
        _one("invalid_modifier", _number(F.col("multiplier")) <= 0),
        _one("modifier_magnitude", _too_large(F.col("multiplier"))),
        _one("empty_modifier_selector", F.coalesce(F.size("selectors"), F.lit(0)) <= 0),
    )


def _header_rules(df: DataFrame) -> DataFrame:
    return _listed(
        df, None,
        _one("schema_version", F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True))),
        _one("empty_revision", blank("revision")),
        _one("verification_before_publication", F.col("verified_at") < F.col("published_at")),
        _one("zero_stale_window", F.coalesce(F.col("stale_after_days") <= 0, F.lit(True))),
    )


def _meets(a: str, b: str, *keys: str) -> Column:
    """Records of one document with equal keys that are in effect at once."""
    same = reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in ("document", *keys)])
    dated = F.col(f"{a}.effective_from").isNotNull() & F.col(f"{b}.effective_from").isNotNull()
    return same & dated & overlaps(F.col(f"{a}.effective_from"), F.col(f"{a}.effective_to"), F.col(f"{b}.effective_from"), F.col(f"{b}.effective_to"))


def _reach(rates: DataFrame, modifiers: DataFrame) -> list[DataFrame]:
    """Modifiers of no rate, and selectors of values that no rate which they meet allows. Each row stops at its first partner."""
    key = ("provider", "canonical_model", "kind")
    base = rates.select("document", *key, "effective_from", "effective_to")
    offered = rates.select("document", *key, "effective_from", "effective_to", F.explode("dimension_policies").alias("dimension", "policy"))
    offered = offered.select("*", F.explode("policy.allowed").alias("value")).drop("policy")
    own = modifiers.select("document", "id", *key, "effective_from", "effective_to", "selectors")
    chosen = own.select("*", F.explode("selectors").alias("dimension", "value")).drop("selectors")
    orphans = own.alias("m").join(base.alias("r"), _meets("m", "r", *key), "left_anti")
    lost = chosen.alias("m").join(offered.alias("r"), _meets("m", "r", *key, "dimension", "value"), "left_anti")
    return [_rows(orphans, "orphan_modifier"), _rows(lost.withColumn("what", F.concat_ws("=", "dimension", "value")), "unreachable_modifier", detail="what")]


def verify(records: Records, limit: int = COLLECTION_LIMIT) -> DataFrame:
    """(document, code, record_id, detail, n): everything that is wrong with catalog documents; none is an error that a sound one has.

    A document with more than limit records of a collection gets the issue
    collection_limit; its records are checked like any others. A price that is no
    number or beyond MAGNITUDE is a *_magnitude issue. A null text counts as empty, a
    null list as one without entries, a null end as open; a record without a start
    overlaps none. Repeated records are repeated ids and overlaps: n says how many
    times (an id's copies too many, pairs of the same two ids). Records of documents
    without a header are checked too. No records give no rows.
    """
    every = {"sources": records.sources, "aliases": records.aliases, "rates": records.rates, "modifiers": records.modifiers}
    sizes = reduce(DataFrame.unionAll, [df.select("document", F.lit(name).alias("id")) for name, df in every.items()]).groupBy("document", "id").agg(F.count("*").alias("size"))
    kept = [records.aliases, records.rates, records.modifiers]
    named = reduce(DataFrame.unionAll, [df.select("document", "id") for df in kept])
    cited = reduce(DataFrame.unionAll, [df.select("document", "id", F.explode("source_ids").alias("source")) for df in kept])
    known = records.sources.select("document", F.col("id").alias("source")).distinct()
    unknown = cited.join(known, ["document", "source"], "left_anti").groupBy("document", "id", "source").agg(F.count("*").alias("times"))
    low, high = (lambda p: F.coalesce(f"{p}_min_input_tokens", F.lit(0))), (lambda p: F.col(f"{p}_max_input_tokens_exclusive"))
    tokens = (high("b").isNull() | (low("a") < high("b"))) & (high("a").isNull() | (low("b") < high("a")))
    span = ["effective_from", "effective_to"]
    priced = records.rates.select("document", "id", "provider", "canonical_model", "kind", *span, "min_input_tokens", "max_input_tokens_exclusive")
    stacked = records.modifiers.select("document", "id", "provider", "canonical_model", "kind", "scope", *span, F.to_json(F.array_sort(F.map_entries("selectors"))).alias("selector"))
    found = [
        _header_rules(records.headers),
        _rows(sizes.where(F.col("size") > limit).withColumn("many", F.col("size").cast("string")), "collection_limit", detail="many"),
        _repeated(records.sources, "duplicate_source"),
        _listed(records.sources, "id", _one("source_url", F.coalesce(~F.startswith("url", F.lit("https://")), F.lit(True)))),
        _alias_rules(records.aliases), _rate_rules(records.rates), _modifier_rules(records.modifiers),
        _repeated(named, "duplicate_record_id"),
        _rows(unknown, "unknown_source", detail="source", n=F.col("times")),
        _pairs(records.aliases.select("document", "id", "provider", "raw_model", *span), "overlapping_alias", ["provider", "raw_model"]),
        _pairs(priced, "overlapping_rate", ["provider", "canonical_model", "kind"], tokens),
        _pairs(stacked, "duplicate_modifier", ["provider", "canonical_model", "kind", "scope", "selector"]),
        *_reach(records.rates, records.modifiers),
    ]
    return reduce(DataFrame.unionAll, found)


def status(records: Records, issues: DataFrame, now: str) -> DataFrame:
    """A row for each document's header: revision, digest, dates, freshness at now, records by kind, issues, validity. A header of nulls is fresh, but not valid."""
    every = {"sources": records.sources, "aliases": records.aliases, "rates": records.rates, "modifiers": records.modifiers}
    counted = reduce(DataFrame.unionAll, [df.select("document", F.lit(name).alias("kind"), F.lit(1).cast("long").alias("n")) for name, df in every.items()])
    counted = counted.unionAll(issues.select("document", F.lit("issues"), "n"))
    sums = counted.groupBy("document").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in (*every, "issues")])
    stale_at = F.col("verified_at") + F.make_dt_interval(F.col("stale_after_days").cast("int"))
    at = F.lit(now).cast("timestamp")
    freshness = F.when(F.col("published_at") > at, "future_dated").when(at > stale_at, "stale").otherwise("fresh")
    heads = records.headers.join(sums, "document", "left").na.fill(0, [*every, "issues"])
    return heads.select("document", "revision", "sha256", "published_at", "verified_at", stale_at.alias("stale_at"), freshness.alias("freshness"), *every, "issues", (F.col("issues") == 0).alias("valid"))


def record_changes(old: Records, new: Records) -> DataFrame:
    """(document, collection, id, change) between two revisions of the same documents: added, removed or changed, and the header's fields that differ (collection metadata).

    Records that repeat an id are compared as a sorted list.
    """
    stated = ("schema_version", "revision", "published_at", "verified_at", "stale_after_days")
    heads = old.headers.alias("a").join(new.headers.alias("b"), "document")
    differ = F.array_compact(F.array(*[F.when(~F.equal_null(f"a.{c}", f"b.{c}"), F.lit(c)) for c in stated]))
    parts = [heads.select("document", F.lit("metadata").alias("collection"), F.explode(differ).alias("id"), F.lit("changed").alias("change"))]
    for name in ("sources", "aliases", "rates", "modifiers"):
        side = lambda r, c: _written(getattr(r, name)).groupBy("document", "id").agg(F.sort_array(F.collect_list("text")).alias(c))  # noqa: B023, E731
        both = side(old, "before").join(side(new, "after"), ["document", "id"], "full_outer")
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
        parts.append(both.select("document", F.lit(name).alias("collection"), "id", change.alias("change")).where("change is not null"))
    return reduce(DataFrame.unionAll, parts)


def as_document(records: Records, name: str) -> Records:
    """The records of one document under another name, so that it can be compared."""
    named = lambda df: df.withColumn("document", F.lit(name))
    return Records(*[named(getattr(records, f.name)) for f in fields(records)])


def _ordered(value: Column, kind: DataType) -> Column:
    """A value with its maps as lists in the order of their keys, at any depth."""
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: _ordered(e, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def _written(df: DataFrame) -> DataFrame:
    """Each record's digest, whatever the order of its fields and keys."""
    columns = sorted((f for f in df.schema if f.name not in ("document", "id")), key=lambda f: f.name)
    return df.select("document", F.coalesce("id", F.lit("")).alias("id"), F.sha2(F.to_json(F.struct(*[_ordered(F.col(f.name), f.dataType).alias(f.name) for f in columns])), 256).alias("text"))


def override_issues(overrides: DataFrame, rates: DataFrame) -> DataFrame:
    """(document, code, record_id, detail, n) of attested dimensions (document, id, provider, canonical_model, dimension, value, effective_from, effective_to) against the rates of their document.

    An override has to name a dimension that a rate in effect with it documents, and
    a value that every such rate's policy allows, by itself or by an alias. Providers
    and dimensions are compared without case. A null field counts as empty, a missing
    bound as an empty interval.
    """
    named = ("id", "provider", "canonical_model", "dimension", "value")
    own = overrides.select("document", *named, "effective_from", "effective_to")
    alone = _listed(
        own, "id",
        *[F.array_compact(F.array(F.when(blank(c), _said("override_empty_field", F.lit(c))))) for c in named],
        _one("override_empty_interval", F.coalesce(F.col("effective_from") >= F.col("effective_to"), F.lit(True))),
        _one("override_unsupported_dimension", ~blank("dimension") & ~F.lower(F.trim("dimension")).isin(*DIMENSIONS)),
        _one("override_unresolved_value", F.lower(F.trim("value")).isin(*UNRESOLVED_VALUES)),
    )
    policies = rates.select("document", F.lower("provider").alias("provider"), "canonical_model", "effective_from", "effective_to", F.explode("dimension_policies").alias("dimension", "policy"))
    target = own.withColumns({"provider": F.lower("provider"), "dimension": F.lower("dimension")})
    asked = target.withColumns({"dimension": F.trim("dimension"), "value": F.lower(F.trim("value"))})
    meets = _meets("o", "p", "provider", "canonical_model", "dimension")
    resolved = F.coalesce(F.try_element_at("p.policy.aliases", F.col("o.value")), F.col("o.value"))
    allows = F.coalesce(F.array_contains("p.policy.allowed", resolved), F.lit(False))
    stated = asked.where(~blank("value") & ~F.col("value").isin(*UNRESOLVED_VALUES))
    # for both joins, a row stops at its first partner
    undocumented = asked.where(~blank("dimension")).alias("o").join(policies.alias("p"), meets, "left_anti")
    unsupported = stated.alias("o").join(policies.alias("p"), meets & ~allows, "left_semi")
    return reduce(DataFrame.unionAll, [
        alone, _repeated(own, "override_duplicate_id"), _rows(undocumented, "override_undocumented"), _rows(unsupported, "override_unsupported_value", detail="value"),
        _pairs(target.drop("value"), "override_overlap", ["provider", "canonical_model", "dimension"]),
    ])
