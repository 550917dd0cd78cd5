"""A ledger of observations that grows by merging.

A row is one event as one source shows it: (client, source_id, event_key). What a
run reads anew is merged with what is there: counters grow to the greatest, times
to the earliest, an unknown model or provider is filled in, and dimensions come
from the copy of the best coverage, of equal ones the newer. All of that may be
grouped in any way, so runs over parts of a log equal one over all.

The table is divided by client, by the day on which a source was first seen, and
by a hash of the source. A run writes what it read, unmerged and without a
shuffle, into a folder of its own in each such part, and then a manifest that says
which runs each part has. Readers merge a part's runs, moving only the columns
that they ask for. A part that has MOST_RUNS runs, or a rewritten source, is
merged into one by the next run, and is read as it stands until it grows again.
A reader takes the newest manifest: until it is there, the ledger is as it was
before, and a run that died has left nothing but files that no manifest names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.functions.tables import written
from usagebook.functions.values import COVERAGE, rank, small
from usagebook.operators.canonical import greatest_counters, merged_counters

#: Hash parts of a client's day.
PARTS = 16
#: Unmerged runs of a part, after which the next run merges them.
MOST_RUNS = 8
PART = ("client", "born", "part")
KEY = ("client", "source_id", "event_key")
_OF_BEST = ("auth_mode", "auth_mode_provenance", "service_tier", "speed", "inference_geo", "cache_write_data_complete", "input_subset_accounting_consistent", "line_number", "byte_start", "byte_end", "context_window", "client_version", "warning", "notes")


def _known(c: str) -> Column:
    """The first value, by runs, that says something."""
    says = F.col(c).isNotNull() & ~F.col(c).isin("", "unknown")
    return F.coalesce(F.min_by(c, F.when(says, F.struct("run", c))), F.max(c)).alias(c)


def merged(rows: DataFrame) -> DataFrame:
    """One row for each client, source and event of rows that say in which run they were seen. Rows move once, as they are, since most are of different events."""
    given = set(rows.columns)
    rows = rows.repartition(*KEY)
    best = [c for c in _OF_BEST if c in given]
    trust = F.struct(rank(F.col("coverage"), COVERAGE), "run", F.to_json(F.struct(*best)))  # the last decides between copies of one run
    carried = [c for c in ("born", "part") if c in given]
    grouped = rows.groupBy(*KEY).agg(
        F.min("occurred_at").alias("occurred_at"), *greatest_counters(), *[_known(c) for c in ("session_id", "raw_model", "provider")], F.max("quality_rank").alias("quality_rank"),
        F.max(rank(F.col("coverage"), COVERAGE)).alias("_coverage"), F.max_by(F.struct(*best), trust).alias("_best"), F.max("run").alias("run"), *[F.min(c).alias(c) for c in carried],
    )
    coverage = F.when(F.col("_coverage") >= 0, F.element_at(F.array(*[F.lit(c) for c in COVERAGE]), F.greatest(F.col("_coverage"), F.lit(0)) + 1))
    return grouped.select(*KEY, "occurred_at", "session_id", "raw_model", "provider", *merged_counters(), "quality_rank", coverage.alias("coverage"), *[F.col(f"_best.{c}").alias(c) for c in best], "run", *carried)


def _manifest(spark: SparkSession, path: str, run_id: int | None = None) -> DataFrame | None:
    """The newest manifest: which runs wrote each part, and whether its rows must be merged; a run that writes must follow it. One that doesn't say has merged parts."""
    try:
        every = spark.read.option("mergeSchema", True).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = every.agg(F.max("of_run")).first()[0]
    if run_id is not None and run_id <= last:
        raise ValueError(f"run {run_id} doesn't follow run {last}")
    loose = F.coalesce("loose", F.lit(False)) if "loose" in every.columns else F.lit(False)
    return every.where(F.col("of_run") == last).select(*PART, "written", loose.alias("loose"))


def _parts(spark: SparkSession, path: str, parts: DataFrame, but: int | None = None) -> DataFrame:
    """The rows of (client, born, part, written), found by folders; none of a run that is being replaced."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/data")
    rows = rows if but is None else rows.where(F.col("written") != but)
    return rows.join(small(parts.select(*PART, "written")), [*PART, "written"], "left_semi").drop("written")


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger's observations; None before the first run."""
    manifest = _manifest(spark, path)
    if manifest is None:
        return None
    loose, whole = (manifest.where(F.col("loose") == x) for x in (True, False))
    if loose.isEmpty():
        return _parts(spark, path, whole)
    rows = merged(_parts(spark, path, loose))
    return rows if whole.isEmpty() else rows.unionByName(_parts(spark, path, whole).select(rows.columns))


def merge(spark: SparkSession, path: str, new: DataFrame, born: DataFrame, run_id: int, rewritten: DataFrame | None = None) -> DataFrame:
    """Merges new observations into the ledger at a path and gives the parts that were written (client, born, part).

    born: source_id and the day on which it was first seen, which never changes. Of
    rewritten sources (source_id) what the ledger has goes. Runs are numbered upwards; one with the number of one that died before its manifest replaces what it left.
    """
    days = born.select("source_id", F.col("born").cast("date").alias("born"))
    part = F.pmod(F.xxhash64("source_id"), F.lit(PARTS)).cast("int")
    fresh = new.join(days, "source_id").withColumns({"part": part, "run": F.lit(run_id).cast("long")})
    fresh = fresh.select(*[F.col(f.name).cast(f.dataType) for f in merged(fresh).schema])
    before = _manifest(spark, path, run_id)
    settled = None if before is None else before.groupBy(*PART).count().where(F.col("count") >= MOST_RUNS).select(*PART)
    if before is not None and rewritten is not None:
        places = rewritten.join(days, "source_id").select("born", part.alias("part")).distinct()
        settled = settled.union(before.join(places, ["born", "part"], "left_semi").select(*PART)).distinct()
    rows = fresh
    if settled is not None:
        settled = small(written(settled, "settled"))
        if not settled.isEmpty():
            old = _parts(spark, path, before.join(settled, list(PART), "left_semi"), but=run_id)
            old = old if rewritten is None else old.join(rewritten, "source_id", "left_anti")
            whole = merged(fresh.join(settled, list(PART), "left_semi").unionByName(old, allowMissingColumns=True)).hint("rebalance", *PART)
            rows = fresh.join(settled, list(PART), "left_anti").unionByName(whole, allowMissingColumns=True)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*PART).parquet(f"{path}/data/written={run_id}")
    wrote = spark.read.parquet(f"{path}/data").where(F.col("written") == run_id).select(*PART).distinct()
    now = wrote.withColumns({"written": F.lit(run_id).cast("long"), "loose": F.lit(True)})
    if before is not None:
        whole = settled.withColumn("_settled", F.lit(True))
        now = now.join(whole, list(PART), "left").withColumn("loose", F.col("_settled").isNull()).drop("_settled")
        grown = wrote.withColumn("_grown", F.lit(True))
        kept = before.join(settled, list(PART), "left_anti").join(small(grown), list(PART), "left")
        now = now.unionByName(kept.withColumn("loose", F.col("loose") | F.col("_grown").isNotNull()).select(now.columns))  # a settled part that has no row left is in no manifest
    now.withColumn("of_run", F.lit(run_id).cast("long")).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of_run").parquet(f"{path}/manifest")
    return wrote


__all__ = ["merge", "merged", "read"]
