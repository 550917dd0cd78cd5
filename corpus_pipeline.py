"""Five stages from raw documents to token ids.

Each stage reads the Parquet table that the one before wrote. All but the last
return the columns of documents; the last returns doc_id and the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.decontamination import clean_documents
from usagebook.llm.exact_dedup import exact_groups, normalised
from usagebook.llm.langid import identified_documents, train
from usagebook.llm.near_dedup import distinct_documents
from usagebook.llm.pieces import encode_documents
from usagebook.llm.shared import free_names, id_and_text, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document with an identified language; one without any letter goes."""
    return identified_documents(docs, train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id, and of rows that repeat it one. A null text is empty; a null doc_id is smaller than any other; other columns stay, whatever their names."""
    groups, columns = exact_groups(docs), docs.columns
    ident, sha, own = free_names(docs, "id", "sha", "sum")  # any other column may be called anything
    gone = groups.where("not kept").select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha))
    digest = F.sha2(normalised(F.coalesce(docs["text"], F.lit(""))), 256)
    left = docs.withColumn(own, digest).join(gone.distinct(), F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(sha)), "left_anti")
    repeated = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["doc_id", own])
    return left.select(columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies keeps the document with the least doc_id. A text without words is no copy of any; a null doc_id goes only with another's component; other columns stay, whatever their names."""
    return distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document that holds no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens. A null or empty text has no ids; a null doc_id is passed on; other columns are left out; an empty table gives an empty result."""
    return encode_documents(id_and_text(docs)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", tokenize),
]

#: No SQL can express near copies, alignment or piece encoding; a test looks at what each stage keeps and removes on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
