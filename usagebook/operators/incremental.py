"""Incremental ingest: which sources changed, and the observations after replacing theirs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a ledger's sources are dealt to; a run writes again those whose sources changed.
PARTS = 256
STATES = ("new", "unchanged", "rewritten", "appended", "vanished")


def source_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Each source's state between two inventories (source_id, file_size, content_hash).

    A source that grew is appended to, one whose content differs otherwise is
    rewritten; both are parsed as a whole again.
    """
    now = current.select("source_id", F.col("file_size").alias("size_now"), F.col("content_hash").alias("hash_now"))
    before = stored.select("source_id", F.col("file_size").alias("size_before"), F.col("content_hash").alias("hash_before"))
    both = now.join(before, "source_id", "full_outer")
    state = (
        F.when(F.col("hash_before").isNull(), "new")
        .when(F.col("hash_now").isNull(), "vanished")
        .when((F.col("hash_now") == F.col("hash_before")) & (F.col("size_now") == F.col("size_before")), "unchanged")
        .when(F.col("size_now") > F.col("size_before"), "appended")
        .otherwise("rewritten")
    )
    return both.select("source_id", state.alias("state"), "size_before", "size_now")


def touched(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Of listed sources (source_id, size, modified_at) those to be read: of another size or time than stored, or of which the last run had warnings."""
    whole = stored.where("status = 'ok'") if "status" in stored.columns else stored
    same = whole.select("source_id", F.col("file_size").alias("size"), "modified_at")
    return listed.join(same, ["source_id", "size", "modified_at"], "left_anti")


def stale(changes: DataFrame) -> DataFrame:
    """The sources (source_id) whose observations are replaced."""
    return changes.where("state in ('rewritten', 'appended', 'new')").select("source_id")


def replaced(observations: DataFrame, changes: DataFrame, new: DataFrame, since: str | None = None) -> DataFrame:
    """The observations with those of changed sources replaced by new ones; vanished sources keep theirs. With since, only later ones are replaced."""
    left = observations.join(stale(changes), "source_id", "left_anti")
    if since is not None:
        earlier = observations.where(F.col("occurred_at").isNull() | (F.col("occurred_at") < F.lit(since).cast("timestamp")))
        left = left.unionByName(earlier.join(stale(changes), "source_id", "left_semi"))
    return left.unionByName(new, allowMissingColumns=True)


def run_summary(changes: DataFrame, observations: DataFrame, warnings: DataFrame, run_id: int, limited: bool = False) -> DataFrame:
    """One row about an ingest run: sources by what became of them, those opened (scanned), those whose rows were replaced (reset), those with warnings (incomplete), rows and warnings.

    A run is partial, and what it says provisional, if it was limited or any source
    gave a warning.
    """
    opened = F.col("state").isin("new", "rewritten", "appended")
    states = changes.agg(F.count_if(F.col("state") != "vanished").alias("discovered"), F.count_if(opened).alias("scanned"), F.count_if(F.col("state") == "rewritten").alias("reset"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    seen = observations.agg(F.count("*").alias("observations"))
    warned = warnings.agg(F.count("*").alias("warnings"), F.count_distinct("source_id").alias("incomplete"))
    provisional = F.lit(limited) | (F.col("warnings") > 0)
    out = states.crossJoin(seen).crossJoin(warned)  # one row each
    return out.select(F.lit(run_id).cast("long").alias("run_id"), "*", F.lit(limited).alias("limited"), provisional.alias("provisional"), F.when(provisional, "partial").otherwise("ok").alias("status"))


def _part() -> Column:
    return F.pmod(F.xxhash64("source_id"), F.lit(PARTS)).cast("int")


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The observations of the ledger at a path; None before the first run."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where("source_id is not null").drop("part")


def merge_into_ledger(spark: SparkSession, path: str, changes: DataFrame, new: DataFrame, since: str | None = None) -> None:
    """Replaces the observations of changed sources in the ledger at a path.

    Only the folders that hold changed sources are read and written, all of them in
    one commit. Each gets a row without a source, so that a folder is overwritten
    even where none of its observations is left.
    """
    before = ledger(spark, path)
    if before is not None:
        held = spark.read.parquet(path).where(F.col("source_id").isNotNull() & F.col("part").isin(_parts(changes))).drop("part")
        rows = replaced(held, changes, new, since)
    else:
        rows = new
    marks = stale(changes).select(_part().alias("part")).distinct()
    out = rows.withColumn("part", _part()).unionByName(marks, allowMissingColumns=True)
    out.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _parts(changes: DataFrame) -> list[int]:
    """The folders of changed sources, PARTS at most."""
    return [r["part"] for r in stale(changes).select(_part().alias("part")).distinct().collect()]


def source_status(sources: DataFrame, warnings: DataFrame, run_id: int) -> DataFrame:
    """Adds to each source its last run, and status: partial if the run warned about it."""
    warned = warnings.select("source_id", F.lit("partial").alias("status")).distinct()
    return sources.join(warned, "source_id", "left").withColumns({"status": F.coalesce("status", F.lit("ok")), "run_id": F.lit(run_id).cast("long")})


def last_successful(sources: DataFrame) -> DataFrame:
    """(client, source_id, run_id): each client's newest source without warnings, ties by the source's id."""
    newest = sources.where("status = 'ok'").groupBy("client").agg(F.max(F.struct("run_id", "source_id")).alias("last"))
    return newest.select("client", "last.source_id", "last.run_id")
