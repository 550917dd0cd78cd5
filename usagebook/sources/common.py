"""Lines of log files, and typed access to semi-structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.functions.ids import pseudonym
from usagebook.sources.ranges import RANGE, contents, read_ranges

FILES = "path string, size long, modified_at timestamp"


def _listing() -> list[Column]:
    return [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified_at")]


def _exists(spark: SparkSession, path: str) -> bool:
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).exists(given)


def listed_files(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """The log files below the roots that exist: path, size, modified_at. No file is opened, as the content isn't selected."""
    roots = [r for r in roots if _exists(spark, r)]
    if not roots:
        return spark.createDataFrame([], FILES)
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(roots).select(*_listing())


def log_files(spark: SparkSession, roots: list[str], pattern: str, paths: list[str] | None = None) -> DataFrame:
    """Whole log files below the roots, or just those of the paths: path, size, modified_at, value."""
    if paths is not None and not paths:
        return spark.createDataFrame([], f"{FILES}, value string")
    options = {"recursiveFileLookup": True, "pathGlobFilter": pattern} if paths is None else {}
    return spark.read.text(roots if paths is None else paths, wholetext=True, **options).select(*_listing(), "value")


def sources(files: DataFrame, client: str) -> DataFrame:
    """One row a file: its pseudonymous id, size, time and content digest; no text."""
    content = F.col("content_hash") if "content_hash" in files.columns else F.sha2("value", 256)
    return files.select(source_id(F.col("path")).alias("source_id"), F.lit(client).alias("client"), F.col("path").rlike(r"(?i)\.zst$").alias("compressed"), F.col("size").alias("file_size"), "modified_at", content.alias("content_hash"))


def file_lines(files: DataFrame, step: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with their content_hash, their complete lines (source_id, path, line_number, byte_start, byte_end, text), and warnings of incomplete last lines. files: path, size, modified_at; only these are opened."""
    lines, facts = read_ranges(files, step)
    tails = facts.where("tail is not null").select(source_id(F.col("path")).alias("source_id"), (F.col("before") + F.col("lines") + 1).alias("line_number"), F.lit("incomplete_tail").alias("code"))
    return files.join(contents(facts), "path"), lines.select(source_id(F.col("path")).alias("source_id"), "*"), tails


def source_id(path: Column) -> Column:
    return pseudonym("src", "source", path)


def prefer_plain(files: DataFrame) -> DataFrame:
    """Without compressed files beside which their plain ones lie."""
    plain = files.where(~F.col("path").rlike(r"(?i)\.zst$")).select("path").withColumnRenamed("path", "_plain")
    return files.join(plain, F.col("path").rlike(r"(?i)\.zst$") & (F.regexp_replace("path", r"(?i)\.zst$", "") == F.col("_plain")), "left_anti")


def log_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_id, path, line_number, text) of complete lines, and warnings. A last line without a line end is incomplete and isn't read."""
    rows = files.select(source_id(F.col("path")).alias("source_id"), "path", F.posexplode(F.split("value", "\n")).alias("at", "text"), F.length("value").alias("_n"), F.size(F.split("value", "\n")).alias("_lines"))
    rows = rows.withColumn("line_number", (F.col("at") + 1).cast("long"))
    last = F.col("line_number") == F.col("_lines")
    warnings = rows.where(last & (F.col("text") != "")).select("source_id", "line_number", F.lit("incomplete_tail").alias("code"))
    return rows.where(~last).select("source_id", "path", "line_number", F.regexp_replace("text", "\r$", "").alias("text")), warnings


def lines_of(df: DataFrame, text: str, source: str = "source_id", line: str = "line_number") -> DataFrame:
    """Lines that a table holds already."""
    return df.select(F.col(source).alias("source_id"), F.col(source).alias("path"), F.col(line).alias("line_number"), F.col(text).alias("text"))


def parsed(lines: DataFrame) -> DataFrame:
    """Adds v, the record as a variant, null if it isn't JSON."""
    return lines.withColumn("v", F.try_parse_json("text"))


def text_at(v: str, path: str) -> Column:
    """A string at a path; null for anything else."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def kind_at(v: str, path: str) -> Column:
    """The type of what is at a path: null if absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def counter_at(v: str, *paths: str) -> Column:
    """The first counter that is present: a non-negative integer; anything else gives null."""
    whole = lambda p: F.when((kind_at(v, p) == "BIGINT") & (F.try_variant_get(v, p, "bigint") >= 0), F.try_variant_get(v, p, "bigint"))
    return F.coalesce(*[whole(p) for p in paths])


def bad_counter(v: str, *paths: str) -> Column:
    """Whether any of the paths holds something other than a counter or null."""
    bad = [kind_at(v, p).isNotNull() & (kind_at(v, p) != "VOID") & counter_at(v, p).isNull() for p in paths]
    out = bad[0]
    for b in bad[1:]:
        out = out | b
    return F.coalesce(out, F.lit(False))


def fields(v: str, path: str, names: tuple[str, ...]) -> Column:
    """A map of the fields of these names in the object at a path: text (a string), number (a counter), kind (the type, VOID for a JSON null). The object is read once, whatever the number of names."""

    # what stands twice in a lambda isn't shared, so the type and the number are found once, then named; only an integer is read as one, as a failed cast is slow
    kinds = lambda x: F.struct(F.schema_of_variant(x).alias("kind"), x.alias("v"))
    values = lambda x: F.struct(F.when(x["kind"] == "STRING", F.try_variant_get(x["v"], "$", "string")).alias("text"), F.when(x["kind"] == "BIGINT", F.try_variant_get(x["v"], "$", "bigint")).alias("number"), x["kind"].alias("kind"))
    counters = lambda x: F.struct(x["text"].alias("text"), F.when(x["number"] >= 0, x["number"]).alias("number"), x["kind"].alias("kind"))
    found = F.map_filter(F.try_variant_get(v, path, "map<string, variant>"), lambda k, _: k.isin(*names))
    return F.transform_values(F.transform_values(F.transform_values(found, lambda _, x: kinds(x)), lambda _, x: values(x)), lambda _, x: counters(x))


def field(of: str, name: str, part: str = "text") -> Column:
    """A part of one of `fields`; null where there is none."""
    return F.expr(f"try_element_at({of}, '{name}').{part}")


def some_rows(df: DataFrame, row: dict[str, Column], which: Column) -> DataFrame:
    """The columns named in row, of the rows that a condition chooses.

    A filter would be pushed below the steps that parse a record, each put in place
    of its name wherever the next ones use it, so a record would be parsed hundreds
    of times. A generator gives no row or one, and nothing is pushed below it.
    """
    return df.select(F.inline(F.when(which, F.array(F.struct(*[c.alias(n) for n, c in row.items()])))))
