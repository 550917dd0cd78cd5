"""Sharding by sampled splitters (DataFrame functions only).

Law `bytes`: shards have sizes near equal, any two differing by less than two
rows' sizes. Records are ordered by (hash of the text, hash of doc_id, number of the row), so
equal texts stand together and a group of copies that exceeds a shard or a range
is divided, even one of rows that repeat doc_id and text. The order is written
once, so a task that runs again finds the same. A sample in which a row's chance is in proportion to its size gives
quantile boundaries for the ranges; ranges that hold more than twice their share
get further boundaries from a sample of their own. Inside a range a window
numbers the rows and sums their sizes, the ranges' totals (one row a range) turn
those into places in the whole order, and a row's place in bytes gives its shard.

The driver holds the sample (about SAMPLE_PER_RANGE rows a range, at most
MAX_RANGES ranges) and the boundaries; both are bounded whatever the input.

Defined cases: a null text has size 1, crc32 0 and the place of an empty text;
rows that repeat doc_id and text take adjacent slots; null ids are allowed; an
empty table gives an empty result; other columns are ignored. With fewer rows
than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagebook.llm.shared import free_names, stored, table

SHARDS = 16
SAMPLE_PER_RANGE = 32
ROWS_PER_RANGE = 250_000
MAX_RANGES = 16384
#: Rounds in which overfull ranges get further boundaries.
ROUNDS = 4


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the key that orders the records; texts end here."""
    body, ident = docs[text].cast("string"), docs[doc_id].cast("long")
    word = lambda h: F.lpad(F.hex(h), 16, "0")
    return docs.select(
        ident.alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.concat(word(F.xxhash64(F.coalesce(body, F.lit("")))), word(F.xxhash64(ident)), word(F.monotonically_increasing_id())).alias("key"),
    )


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at or below the key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    array = F.lit(bounds)
    halve = lambda low, width: F.when((low + width <= len(bounds)) & (F.get(array, low + width - 1) <= key), low + width).otherwise(low)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), halve)


def sample(rows: DataFrame, rate: float | Column) -> list[tuple[str, float]]:
    """Keys and weights of a sample in which a row's chance is its size times rate; the same rows each time."""
    chance = F.col("size") * rate
    drawn = F.pmod(F.xxhash64(F.col("key"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30) < chance
    return sorted((r[0], max(1.0, r[1])) for r in rows.where(drawn).select("key", chance.cast("double")).collect())


def quantiles(drawn: list[tuple[str, float]], parts: int) -> list[str]:
    """Keys that cut a weighted sample into parts of near equal weight."""
    total, run, out = sum(w for _, w in drawn), 0.0, []
    for key, weight in drawn:
        if run >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append(key)
        run += weight
    return out


def splitters(rows: DataFrame, parts: int, total: int) -> list[str]:
    """Ordered bounds of about `parts` ranges, none of more than twice the mean size unless it can't be divided."""
    share = total / parts
    bounds = sorted(set(quantiles(sample(rows, SAMPLE_PER_RANGE / share), parts)))
    for _ in range(ROUNDS):
        ranged = rows.withColumn("range", range_of(F.col("key"), bounds))
        sizes = ranged.groupBy("range").agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
        overfull = [r for r in sizes.where((F.col("size") > 2 * share) & (F.col("low") < F.col("high"))).collect()]
        if not overfull:
            break
        inside = F.col("range").isin([r["range"] for r in overfull])
        drawn = sample(ranged.where(inside), 2 * SAMPLE_PER_RANGE / share)
        more: set[str] = set()
        keys = [k for k, _ in drawn]
        for r in overfull:
            own = drawn[bisect_right(keys, r["low"]) : bisect_right(keys, r["high"])]
            more |= {k for k in quantiles(own, -(-int(r["size"]) // int(max(1, share))))} | {r["high"]}
        if more <= set(bounds):
            break
        bounds = sorted({*bounds, *more})
    return bounds


def assign_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs."""
    rows = stored(keyed(docs, doc_id, text), "shard-keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(MAX_RANGES, max(4 * shards, -(-n // ROWS_PER_RANGE)))
    bounds = splitters(rows, parts, max(1, total))
    ranged = rows.withColumn("range", range_of(F.col("key"), bounds))
    totals = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    inner = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.select("doc_id", "size", "text_crc32", "range", F.count("*").over(inner).alias("n"), F.sum("size").over(inner).alias("run"))
    middle = (F.col("bytes_before") + F.col("run")) * 2 - F.col("size")
    placed = placed.join(F.broadcast(offsets), "range").select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("n") - 1).alias("place"),
        F.least(F.lit(shards - 1), F.expr(f"cast(({shards} * cast((bytes_before + run) * 2 - size as decimal(30,0))) div {2 * max(1, total)} as int)")).alias("shard"),
    )
    placed = stored(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """The records as Parquet in one folder a shard, several files a large shard, each in slot order. Rows meet their shard by doc_id and checksum; columns of theirs called shard or slot give way."""
    place = assigned.groupBy("doc_id", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("at"))
    crc = F.crc32(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary"))
    mine, ident, total = free_names(docs, "crc", "id", "sum")
    docs = docs.drop("shard", "slot").withColumn(mine, crc)
    joined = docs.join(place.select(F.col("doc_id").alias(ident), F.col("text_crc32").alias(total), F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot")), docs[doc_id].eqNullSafe(F.col(ident)) & (F.col(mine) == F.col(total)))
    joined.drop(mine, ident, total).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
