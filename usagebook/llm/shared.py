"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode without one, a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it, so that workers write where Spark's readers look."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()
    return f"file://{found[5:]}" if found.startswith("file:/") and not found.startswith("file://") else found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a Parquet table in the shared folder: its lineage is cut and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as keep them apart from all columns of df."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Just doc_id and text under fixed names, so no other column of the input can clash; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
