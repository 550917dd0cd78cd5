"""Connected components of an edge table, without the driver seeing edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagebook.llm.shared import stored

#: Rounds after which the work ends with an error; their number grows with the square of the logarithm of the longest path at most.
MAX_ROUNDS = 100
#: Edges that a task reduces to a forest; up to so many need no further step.
EDGES_PER_TASK = 50_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, root) that join what a partition's edges (a, b) join; a root is the least of its nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (a long, b long).

    Each task first reduces EDGES_PER_TASK edges to a forest; if there are more,
    large-star and small-star steps alternate until nothing changes. All steps are partial
    minima and joins with a stored side, so that adaptive execution divides the edges of a
    node that has very many.
    """
    parts = -(-edges.count() // EDGES_PER_TASK)
    dealt = edges.select("a", "b").repartition(parts) if parts > 1 else edges.select("a", "b").coalesce(1)
    stars = stored(dealt.mapInArrow(forest, "a long, b long"), "stars")
    if parts <= 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    stars, before = stars.where("a <> b"), None
    for _ in range(MAX_ROUNDS):
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
        least = stored(least, "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        down = large.where("b < a").union(large.where("b > a").select("b", "a"))
        down = stored(down, "down")
        low = stored(down.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node"), "low")
        small = down.join(low, F.col("a") == F.col("node")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        stars = stored(small, "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components are not settled after {MAX_ROUNDS} rounds")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
