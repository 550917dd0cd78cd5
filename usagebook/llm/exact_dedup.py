"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Each text is cut where its content says so: after the first sentence end or
line end past MIN_CHUNK characters, and at MAX_CHUNK at the latest. A text
becomes the ordered list of its chunks' identifiers, in the one scan that reads
the texts. Identifiers are 64-bit and verified: a chunk dictionary holds the
SHA-256 range of each identifier, and where any identifier stands for more than
one chunk the recipes are compared by SHA-256 instead. From then on only
recipes move, never texts.

Texts are equal when identical after lower-casing A-Z. Defined cases: a null
text equals an empty one (empty recipe); of equal texts the row with the largest
doc_id stays; rows that repeat doc_id and text are all kept or all dropped and
each counts in group_size; a null doc_id is smaller than any other, and stays
only if all ids of its group are null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.shared import id_and_text, stored, table

MIN_CHUNK, MAX_CHUNK = 512, 4096


def normalised(text: Column) -> Column:
    """A-Z lower-cased. lower() does just that to texts of one byte a character, and is several times faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def chunks(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """Content-defined chunks; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{shortest},{longest - 1}}}?[\n.!?]|.{{1,{longest}}}"), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, recipe array<struct<id, digest>>."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    return text.select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.transform(chunks(F.col("text")), lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("recipe"),
    )


def chunk_dictionary(recipe: DataFrame) -> DataFrame:
    """id, the least and the greatest digest that it stands for, and its uses; least = greatest verifies an identifier."""
    return recipe.select(F.explode("recipe").alias("chunk")).groupBy(F.col("chunk.id").alias("id")).agg(F.min("chunk.digest").alias("least"), F.max("chunk.digest").alias("greatest"), F.count("*").alias("uses"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row for each row of docs."""
    made = stored(recipes(id_and_text(docs, doc_id, text)), "recipes")
    verified = chunk_dictionary(made).where("least <> greatest").isEmpty()
    listed = made.select("doc_id", "text_sha256", F.size("recipe").alias("n_chunks"), F.col("recipe.id" if verified else "recipe.digest").alias("chunk_ids"))
    groups = listed.groupBy("chunk_ids").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # stored, so that both sides of the join are plain shuffles and adaptive execution divides the rows of a large group
    found = listed.join(stored(groups, "groups"), "chunk_ids", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "n_chunks"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
