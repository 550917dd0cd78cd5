"""Interaction of filters: who removes what in every order, and each filter's Shapley value.

A document's failures are a set of filters, so what a corpus says of all orders
is one table: for each part, how many documents fail exactly each of the 32 sets
(and how many of them are good or toxic). A coalition of filters removes every
document whose set meets it; a step of an order is the difference of two
coalitions, the filters up to it and those before it.

Shapley values are the exact solution of the constrained least squares that
weigh coalition S of n filters by (n - 1) / (C(n, |S|) |S| (n - |S|)): values
whose sums fit all coalitions' removals best, and whose sum over all filters is
what all remove. The normal equations and the constraint's multiplier are one
linear system over rationals, inverted once.

One scan finds the failures of a text by itself. Copies are found by digest:
the smallest id of each text is aggregated before it moves, and rows meet it by
(digest, id), a key that only a row repeated as a whole shares; so no group of
copies is anywhere together. The tables that rows join are stored, so adaptive
execution can divide even repeated rows.

Defined cases: a null text is empty (it fails the first filter only, and is a
copy of any other empty text); a null id is no smaller than any other and has no
smaller one, so its row is never a copy and has no label; rows that repeat id and
text are each counted, and none is the other's copy; a document is good (toxic)
if any of its label rows says so, and counts once; a null part is the part named
by the empty string; an empty table has no parts and gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.shared import stored, table
from usagebook.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself: short, repetitive, shouting, odd characters."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), "C": 100 * capitals.cast("long") > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def failure_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part and fails, the set of failed filters as bits (A is 1, E is 16): one row for each row of docs."""
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    own = text_failures(F.col("text"))
    alone = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in own.items()), F.lit(0))
    rows = stored(plain.select("doc_id", "part", alone.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-failures")
    # of each text the least id; an id repeats here only with the whole row
    first = stored(rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True)), "filter-first")
    found = rows.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return found.select("doc_id", "part", (F.col("fails") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("fails"))


def tabulated(sets: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, fails, docs, good, toxic: how many documents of a part fail exactly this set."""
    marks = labels.select(labels[doc_id].cast("long").alias("doc_id"), (labels[quality] == 1).cast("int").alias("good"), (labels[toxic] == 1).cast("int").alias("bad"))
    marks = stored(marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("bad").alias("bad")), "filter-labels")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sets.join(marks, "doc_id", "left").groupBy("part", "fails").agg(F.count("*").alias("docs"), total("good").alias("good"), total("bad").alias("toxic"))


def coalition_sums(exact: list[int]) -> list[int]:
    """From the counts of documents that fail exactly each set, the counts that each coalition removes."""
    return [sum(n for fails, n in enumerate(exact) if fails & who) for who in range(len(exact))]


def inverted(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """The inverse of a regular matrix, by elimination in rationals."""
    n = len(rows)
    work = [row + [Fraction(int(i == k)) for k in range(n)] for i, row in enumerate(rows)]
    for k in range(n):
        at = next(i for i in range(k, n) if work[i][k])
        work[k], work[at] = work[at], work[k]
        work[k] = [x / work[k][k] for x in work[k]]
        for i in range(n):
            if i != k and work[i][k]:
                by = work[i][k]
                work[i] = [x - by * y for x, y in zip(work[i], work[k], strict=True)]
    return [row[n:] for row in work]


def shapley_values(removed: list[int], system: list[list[Fraction]] | None = None) -> list[Fraction]:
    """Each filter's Shapley value of what coalitions remove (indexed by bits)."""
    n = len(removed).bit_length() - 1
    system = system or normal_inverse(n)
    right = [Fraction(0)] * (n + 1)
    for who in range(1, len(removed) - 1):
        for i in range(n):
            if who >> i & 1:
                right[i] += kernel(n, who) * removed[who]
    right[n] = Fraction(removed[-1])
    return [sum((x * y for x, y in zip(row, right, strict=True)), Fraction(0)) for row in system[:n]]


def kernel(n: int, who: int) -> Fraction:
    size = who.bit_count()
    return Fraction(n - 1, comb(n, size) * size * (n - size))


def normal_inverse(n: int) -> list[list[Fraction]]:
    """The inverse of the normal equations with the efficiency constraint's row and column."""
    rows = [[sum((kernel(n, who) for who in range(1, (1 << n) - 1) if who >> i & who >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    return inverted([*rows, [Fraction(1)] * n + [Fraction(0)]])


def audit_rows(part: str, tables: dict[str, list[int]], names: str = FILTERS, system: list[list[Fraction]] | None = None) -> list[dict]:
    """One row for each order and step. tables: docs, good and toxic, each by the exact set of failures."""
    n, exact = len(names), tables["docs"]
    removed, good, toxic = (coalition_sums(tables[k]) for k in ("docs", "good", "toxic"))
    values = [int(v * factorial(n)) for v in shapley_values(removed, system)]
    total, out = sum(exact), []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            here = removed[after] - removed[before]
            out.append(
                {
                    "part": part, "filter_order": "".join(names[k] for k in order), "step": step, "kept": total - removed[after], "removed": here, "redundant": removed[1 << f] - here,
                    "unique_fails": exact[1 << f], "good_lost": good[after] - good[before], "toxic_lost": toxic[after] - toxic[before], "shapley": values[f],
                }
            )
            before = after
    return out


_DDL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_ROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(n, pa.int64()) for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])


def interactions(table_: DataFrame, names: str = FILTERS) -> DataFrame:
    """All orders and steps of each part of a table (part, fails, docs, good, toxic)."""
    ship(table_.sparkSession)
    kinds = ("docs", "good", "toxic")
    by_part = table_.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("fails", k))).alias(k) for k in kinds])  # 32 entries at most

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = normal_inverse(len(names))
        for batch in batches:
            for row in batch.to_pylist():
                counts = {k: dict(row[k]) for k in kinds}
                yield pa.RecordBatch.from_pylist(audit_rows(row["part"], {k: [counts[k].get(s, 0) for s in range(1 << len(names))] for k in kinds}, names, system), _ROW)

    return by_part.mapInArrow(audited, _DDL)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    return interactions(tabulated(failure_sets(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


def _sql() -> str:
    def meets(bits: str, who: str) -> str:
        return f"({bits} & {who}) <> 0"

    subsets = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    return f"""
WITH f(name, bit) AS (VALUES {subsets}),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
o AS (SELECT a.name || b.name || c.name || e.name || g.name AS filter_order, [a.bit, b.bit, c.bit, e.bit, g.bit] AS bits
  FROM f a, f b, f c, f e, f g WHERE a.bit | b.bit | c.bit | e.bit | g.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS earlier FROM o, range(1, 6) r(step)),
t AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
    count(*) FILTER (NOT ({meets("fails", "own")} OR {meets("fails", "earlier")})) AS kept, count(*) FILTER ({meets("fails", "own")} AND NOT {meets("fails", "earlier")}) AS removed,
    count(*) FILTER ({meets("fails", "own")} AND {meets("fails", "earlier")}) AS redundant, count(*) FILTER (fails = own) AS unique_fails,
    count(*) FILTER ({meets("fails", "own")} AND NOT {meets("fails", "earlier")} AND good = 1) AS good_lost, count(*) FILTER ({meets("fails", "own")} AND NOT {meets("fails", "earlier")} AND bad = 1) AS toxic_lost
  FROM d, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t
"""


SQL = _sql()
