"""The price catalog: checks, revisions, evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagebook.functions.values import overlaps
from usagebook.operators.pricing import Catalog


def catalog_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(id, change): added, removed or changed records of a collection between two revisions."""
    text = lambda df, name: df.select(F.col(key).alias("id"), F.to_json(F.struct(*sorted(df.columns))).alias(name))
    both = text(old, "before").join(text(new, "after"), "id", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select("id", change.alias("change")).where("change is not null")


def overlapping(df: DataFrame, keys: list[str], start: str = "effective_from", end: str = "effective_to", ident: str = "id") -> DataFrame:
    """Pairs of records with equal keys that are in effect at once, each pair once: columns a_*, b_* with a_id < b_id.

    A sweep: a key's records come in the order of their starts, and each meets the
    earlier ones that haven't ended. So the work is that of the pairs found, and a
    task holds the records in effect at one instant.
    """
    names = df.columns
    at, until, own = names.index(start), names.index(end), names.index(ident)
    places = [names.index(k) for k in keys]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, active = None, []
        for batch in batches:
            schema = pa.schema([(f"{p}{f.name}", f.type) for p in ("a_", "b_") for f in batch.schema])
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (mine := tuple(row[k] for k in places)) != key:
                    key, active = mine, []
                active = [x for x in active if x[until] is None or x[until] > row[at]]
                out += [(*min(x, row, key=lambda r: r[own]), *max(x, row, key=lambda r: r[own])) for x in active if x[own] != row[own]]
                active.append(row)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                    out = []
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join(f"`{p}{n}` {kinds[n]}" for p in ("a_", "b_") for n in names)
    ordered = df.where(F.col(start).isNotNull() & F.col(ident).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, start)
    # of a record that ends before it starts the sweep knows only the start
    return ordered.mapInArrow(sweep, ddl).where(overlaps(F.col(f"a_{start}"), F.col(f"a_{end}"), F.col(f"b_{start}"), F.col(f"b_{end}")))


def catalog_overlaps(catalog: Catalog) -> DataFrame:
    """(code, first_id, second_id) of records of which two would be in effect at once."""
    out = lambda df, code: df.select(F.lit(code).alias("code"), F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"))
    low, high = (lambda p: F.coalesce(f"{p}_min_input_tokens", F.lit(0))), (lambda p: F.col(f"{p}_max_input_tokens_exclusive"))
    tokens = (high("b").isNull() | (low("a") < high("b"))) & (high("a").isNull() | (low("b") < high("a")))
    rates = catalog.rates.select("id", "provider", "canonical_model", "kind", "effective_from", "effective_to", "min_input_tokens", "max_input_tokens_exclusive")
    mods = catalog.modifiers.select("id", "provider", "canonical_model", "kind", "scope", "effective_from", "effective_to", F.to_json(F.array_sort(F.map_entries("selectors"))).alias("selector"))
    return out(overlapping(catalog.aliases, ["provider", "raw_model"]), "overlapping_alias").unionAll(out(overlapping(rates, ["provider", "canonical_model", "kind"]).where(tokens), "overlapping_rate")).unionAll(out(overlapping(mods, ["provider", "canonical_model", "kind", "scope", "selector"]), "stacked_modifier"))


def catalog_issues(catalog: Catalog) -> DataFrame:
    """(code, record_id) of records that no event could be priced with."""
    issue = lambda df, code: df.select(F.lit(code).alias("code"), F.col("id").alias("record_id"))
    out = []
    for name, df in (("alias", catalog.aliases), ("rate", catalog.rates), ("modifier", catalog.modifiers)):
        out += [issue(df.where("effective_to <= effective_from"), f"{name}_empty_interval"), issue(df.groupBy("id").count().where("count > 1"), f"{name}_duplicate_id")]
    rates, mods = catalog.rates, catalog.modifiers
    out += [
        issue(rates.where("unit_scale <= 0 or tool_per_units <= 0"), "rate_zero_scale"),
        issue(rates.where(F.least("input", "cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "output", "web_search", "web_fetch") < 0), "rate_negative"),
        issue(rates.where("max_input_tokens_exclusive <= coalesce(min_input_tokens, 0)"), "rate_empty_range"),
        issue(rates.join(catalog.aliases.select("provider", "canonical_model").distinct(), ["provider", "canonical_model"], "left_anti"), "rate_without_alias"),
        issue(catalog.aliases.join(rates.select("provider", "canonical_model").distinct(), ["provider", "canonical_model"], "left_anti"), "alias_without_rate"),
        issue(mods.join(rates.select("provider", "canonical_model", "kind").distinct(), ["provider", "canonical_model", "kind"], "left_anti"), "modifier_orphan"),
    ]
    chosen = mods.select("id", "provider", "canonical_model", "kind", F.explode("selectors").alias("dimension", "value"))
    open_values = rates.join(catalog.policies, rates["id"] == catalog.policies["rate_id"]).select("provider", "canonical_model", "kind", "dimension", F.explode("allowed").alias("value")).distinct()
    reachable = mods.join(rates.select("provider", "canonical_model", "kind").distinct(), ["provider", "canonical_model", "kind"], "left_semi").select("id")
    out.append(issue(chosen.join(reachable, "id", "left_semi").join(open_values, ["provider", "canonical_model", "kind", "dimension", "value"], "left_anti").select("id").distinct(), "modifier_unreachable"))
    policy = catalog.policies
    out.append(issue(policy.where("size(allowed) = 0 or (default_value is not null and not array_contains(allowed, default_value))").select(F.col("rate_id").alias("id")), "policy_default"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionAll(part)
    return whole


def override_issues(overrides: DataFrame, catalog: Catalog) -> DataFrame:
    """(code, record_id) of attested dimensions that no rate documents or that overlap."""
    own = overrides.select("id", F.lower(F.trim("provider")).alias("provider"), "canonical_model", F.lower(F.trim("dimension")).alias("dimension"), F.lower(F.trim("value")).alias("value"), "effective_from", "effective_to")
    documented = catalog.rates.join(catalog.policies, catalog.rates["id"] == catalog.policies["rate_id"]).select(F.lower("provider").alias("provider"), "canonical_model", "dimension", F.explode("allowed").alias("value")).distinct()
    free = own.where("dimension <> 'auth_mode'")
    issue = lambda df, code, c="id": df.select(F.lit(code).alias("code"), F.col(c).alias("record_id"))
    return issue(free.join(documented, ["provider", "canonical_model", "dimension", "value"], "left_anti"), "override_undocumented").unionAll(issue(overlapping(own, ["provider", "canonical_model", "dimension"]), "override_overlap", "b_id")).unionAll(issue(own.where("effective_to <= effective_from"), "override_empty_interval"))


def catalog_status(catalog: Catalog, revision: str, published_at: str, stale_after_days: int, now: str) -> DataFrame:
    """Revision, freshness, number of records and of issues."""
    counts = None
    for name, df in (("aliases", catalog.aliases), ("rates", catalog.rates), ("modifiers", catalog.modifiers), ("issues", catalog_issues(catalog)), ("overlaps", catalog_overlaps(catalog))):
        part = df.agg(F.count("*").alias(name))
        counts = part if counts is None else counts.crossJoin(part)  # rows of one value
    stale = F.lit(now).cast("timestamp") > F.lit(published_at).cast("timestamp") + F.make_dt_interval(F.lit(stale_after_days))
    return counts.select(F.lit(revision).alias("revision"), F.when(stale, "stale").otherwise("current").alias("freshness"), "*")


def previous_revision(revisions: DataFrame, published_at: str, revision: str) -> DataFrame:
    """The newest revision strictly before the active one."""
    key = F.struct(F.col("published_at"), F.col("revision"))
    active = F.struct(F.lit(published_at).cast("timestamp").alias("published_at"), F.lit(revision).alias("revision"))
    return revisions.where(key < active).orderBy(F.desc("published_at"), F.desc("revision")).limit(1)


def chosen_revision(revisions: DataFrame, label: str) -> DataFrame:
    """What a label stands for: none, one, or ambiguous where its records differ."""
    return revisions.where(F.col("revision") == label).agg(F.count_distinct("sha256").alias("n")).select(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("ambiguous").alias("selection"))


def candidate_relation(candidates: DataFrame, revision: str, published_at: str, sha256: str) -> DataFrame:
    """How candidate revisions relate to the active one."""
    same, when = F.col("sha256") == sha256, F.lit(published_at).cast("timestamp")
    relation = F.when(same, "current").when(F.col("revision") == revision, "conflict").when(F.col("published_at") > when, "newer").when(F.col("published_at") < when, "downgrade").otherwise("conflict")
    return candidates.withColumn("relation", relation)


def evidence(priced: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """The catalog records (id, source_ids) and sources (id, url) behind each event's price."""
    ids = priced.select("client", "event_key", F.explode("matched_ids").alias("record_id"))
    known = records.select(F.col("id").alias("record_id"), F.explode_outer("source_ids").alias("source_id")).join(sources.select(F.col("id").alias("source_id"), "url"), "source_id", "left")
    return ids.join(known, "record_id", "left").groupBy("client", "event_key").agg(F.array_sort(F.collect_set(F.struct("record_id", "source_id", "url"))).alias("evidence"))
