"""Recorded cash: one-time and recurring charges, and whether the record is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Months between charges (fixed values).
CADENCE = {"monthly": 1, "quarterly": 3, "annual": 12}
MAX_OCCURRENCES = 10_000


def recurring_charges(plans: DataFrame, start: str, end: str) -> DataFrame:
    """The instants in [start, end) at which plans charge. Each counts from the anchor, so a month's last day stays one."""
    step = F.element_at(F.create_map(*[x for k, v in CADENCE.items() for x in (F.lit(k), F.lit(v))]), F.col("cadence"))
    stop = F.least(F.coalesce("effective_to", F.lit(end).cast("timestamp")), F.lit(end).cast("timestamp"))
    most = F.greatest(F.lit(0), F.least(F.lit(MAX_OCCURRENCES - 1), F.ceil(F.months_between(stop, "effective_from") / step).cast("int")))
    series = plans.withColumns({"_step": step, "_stop": stop}).where("_stop > effective_from").withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    at = F.expr("effective_from + make_ym_interval(0, k * _step)")
    return series.withColumn("charged_at", at).where((F.col("charged_at") < F.col("_stop")) & (F.col("charged_at") >= F.lit(start).cast("timestamp"))).select("id", "provider", "amount_usd", "charged_at", "k")


def attested(attestations: DataFrame, start: str, end: str) -> DataFrame:
    """provider, complete: whether its attestations cover [start, end) without a gap."""
    w = Window.partitionBy("provider").orderBy("effective_from", "effective_to")
    reach = F.max("effective_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = attestations.withColumn("_gap", F.when(F.col("effective_from") <= reach, 0).otherwise(1)).withColumn("island", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("provider", "island").agg(F.min("effective_from").alias("a"), F.max("effective_to").alias("b"))
    return spans.groupBy("provider").agg(F.bool_or((F.col("a") <= F.lit(start).cast("timestamp")) & (F.col("b") >= F.lit(end).cast("timestamp"))).alias("complete"))


def cash_rollup(one_time: DataFrame, plans: DataFrame, attestations: DataFrame, scope: DataFrame, start: str, end: str) -> DataFrame:
    """For each provider in scope what was recorded, by category, and the actual total where the record is attested complete."""
    once = one_time.where((F.col("charged_at") >= F.lit(start).cast("timestamp")) & (F.col("charged_at") < F.lit(end).cast("timestamp"))).select("provider", "category", "amount_usd", F.lit(False).alias("recurring"))
    again = recurring_charges(plans, start, end).select("provider", F.lit("subscription_plan").alias("category"), "amount_usd", F.lit(True).alias("recurring"))
    sums = once.unionByName(again).groupBy("provider", "category").agg(F.sum("amount_usd").alias("amount"), F.count("*").alias("charges"), F.count_if("recurring").alias("recurring_charges"))
    totals = sums.groupBy("provider").agg(F.sum("amount").alias("recorded"), F.sum("charges").alias("charges"), F.sum("recurring_charges").alias("recurring_charges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "amount")))).alias("by_category"))
    out = scope.select("provider").distinct().join(totals, "provider", "left").join(attested(attestations, start, end), "provider", "left")
    recorded, complete = F.coalesce("recorded", F.lit(0).cast("decimal(18,6)")), F.coalesce("complete", F.lit(False))
    return out.select("provider", recorded.alias("recorded_cash_usd"), F.coalesce("charges", F.lit(0)).alias("charges"), F.coalesce("recurring_charges", F.lit(0)).alias("recurring_charges"), "by_category", complete.alias("attested_complete"), F.when(complete, recorded).alias("actual_billed_usd"))


def billing_status(rollup: DataFrame, closed_scope: bool) -> DataFrame:
    """All providers together. Without a stated set of providers others can't be ruled out, so there is no actual total."""
    total = rollup.agg(F.sum("recorded_cash_usd").alias("recorded_cash_usd"), F.bool_and("attested_complete").alias("all_complete"))
    if not closed_scope:
        return total.select("recorded_cash_usd", F.lit("open_provider_scope").alias("status"), F.lit(None).cast("decimal(28,6)").alias("actual_billed_usd"))
    return total.select("recorded_cash_usd", F.when(F.col("all_complete"), "attested_complete").otherwise("incomplete_evidence").alias("status"), F.when(F.col("all_complete"), F.col("recorded_cash_usd")).alias("actual_billed_usd"))


def billing_issues(one_time: DataFrame, plans: DataFrame, attestations: DataFrame) -> DataFrame:
    """Defects of the evidence: (code, record_id)."""
    issue = lambda df, code: df.select(F.lit(code).alias("code"), F.col("id").alias("record_id"))
    every = one_time.select("id").unionAll(plans.select("id")).unionAll(attestations.select("id"))
    w = Window.partitionBy("provider").orderBy("effective_from", "effective_to", "id")
    return (
        issue(one_time.where("(category = 'refund' and amount_usd >= 0) or (category <> 'refund' and amount_usd < 0)"), "amount_sign")
        .unionAll(issue(one_time.where("attested_at < charged_at"), "attested_before_charge"))
        .unionAll(issue(plans.where("amount_usd < 0"), "amount_sign"))
        .unionAll(issue(plans.where("effective_to <= effective_from"), "empty_interval"))
        .unionAll(issue(attestations.where("effective_to <= effective_from"), "empty_interval"))
        .unionAll(issue(attestations.where("attested_at < effective_to"), "attested_before_end"))
        .unionAll(issue(every.groupBy("id").count().where("count > 1"), "duplicate_id"))
        .unionAll(issue(every.where("id is null or not id rlike '^[A-Za-z0-9._-]{1,128}$'"), "bad_id"))
        .unionAll(issue(attestations.withColumn("_reach", F.max("effective_to").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("effective_from < _reach"), "overlapping_attestation"))
    )
