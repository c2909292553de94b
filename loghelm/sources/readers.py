"""Scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that may hold the training label, in this order.
TRAINING_LABELS = ["label", "is_anomaly"]


QUOTED_CELL = '(?<![^,])"[^"]*+"(?![^,])'


def whole_lines(spark: SparkSession, path: str) -> bool:
    """Whether every line of the files is a row of its own, so that tasks may share a file.

    A quoted cell with a line break leaves a quote on its first line when doubled quotes and quoted cells are gone.
    Other lines with a lone quote aren't whole either, nor those with a carriage return or of blanks alone, which the
    scan by lines reads otherwise.
    """
    line = F.col("value")
    lone = F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), QUOTED_CELL, "").contains('"')
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.where((line.contains('"') & lone) | line.contains("\r") | line.rlike("^[\\x00-\\x20]++$")).isEmpty()


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty cells as empty text.

    Short rows are padded, rows wider than the header are skipped, quoted line breaks stay in their cell,
    blank lines go. Files are split among tasks if no line break is inside a cell, else a file is read by one task.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    if whole_lines(spark, path):
        options |= {"multiLine": False, "lineSep": "\n"}
    slots = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{s} string" for s in [*slots, "_bad"])
    rows = spark.read.schema(schema).options(**options, columnNameOfCorruptRecord="_bad").csv(path)
    # A row of another width comes with its text. Behind a short row a mark still
    # lands inside one column more than the header has, behind a wide one it does not.
    mark = "\x01"
    marked = F.from_csv(
        F.concat(F.regexp_replace("_bad", "[\r\n]+$", ""), F.lit("," + mark)),
        ", ".join(f"m{i} string" for i in range(len(names) + 1)), {"quote": '"', "escape": '"', "multiLine": "true"})
    short = F.coalesce(F.array_contains(F.array(*[marked[f"m{i}"] for i in range(len(names) + 1)]), mark), F.lit(False))
    return rows.where(F.col("_bad").isNull() | short).select(
        *[F.coalesce(F.col(s), F.lit("")).alias(n) for s, n in zip(slots, names)])


def csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed scan with a given schema, so no pass over the data to infer one.

    Quoted line breaks stay in their cell; a file with any such is read by one task, others are split.
    """
    options = {"multiLine": False, "lineSep": "\n"} if whole_lines(spark, path) else {"multiLine": True}
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', **options).csv(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def trace_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per ``*.txt`` below root: relative path, whole content, change time.

    Bytes that are not UTF-8 are read as Latin-1.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
        .option("recursiveFileLookup", True).load(root)
    )
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    body = F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    base = root.rstrip("/").split("/")[-1]
    return files.select(
        F.regexp_extract("path", f"/{base}/(.*)$", 1).alias("filepath"),
        body.alias("value"),
        F.col("modificationTime").alias("modified"),
    )


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Array or object files; missing, empty or broken ones give no rows."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    entries = F.from_json("value", T.ArrayType(schema), {"mode": "PERMISSIVE"})
    return files.select(F.explode(entries).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def last_lines(lines: DataFrame, order: str, n: int, column: str = "value", newest_first: bool = False) -> DataFrame:
    """The n last non-empty lines; a top-n, so no full sort."""
    tail = lines.where(F.trim(F.col(column)) != "").orderBy(F.desc(order)).limit(n)
    return tail if newest_first else tail.orderBy(order)


def labelled(df: DataFrame) -> DataFrame:
    """Find the label column, cast it, and refuse tables with a single class."""
    found = next((c for c in TRAINING_LABELS if c in df.columns), None)
    if found is None:
        raise ValueError(f"no label column; expected one of {TRAINING_LABELS}")
    out = df.withColumn("label", F.col(found).cast("int"))
    spread = out.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if spread["lo"] == spread["hi"]:
        raise ValueError("training labels hold a single class")
    return out


def parquet_between(spark: SparkSession, path: str, start: Column, end: Column) -> DataFrame:
    """Anomaly table between two days; whole partitions are skipped."""
    df = spark.read.parquet(path)
    return df.where((F.col("detected_date") >= F.to_date(start)) & (F.col("detected_date") <= F.to_date(end)))
