"""JSON lines, CSV and file-level scans and sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, optional: bool = False) -> DataFrame:
    """JSON lines. strict: the first bad line fails the job; else bad lines give null columns and `_corrupt_record`.

    optional: a missing path is an empty table.
    """
    if optional and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrites; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV review sheet, all strings, a byte order mark in the header dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def cell(df: DataFrame, column: str, joiner: str = ";") -> Column:
    """A column as a CSV cell: lists joined, maps and structs as JSON, line breaks escaped."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        c = F.array_join(c, joiner)
    elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        c = F.to_json(c)
    return F.regexp_replace(c.cast("string"), "\r\n|\r|\n", "\\\\n")


def write_sheet(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with fixed columns; other columns are left out."""
    df.select(*(cell(df, c).alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_split(df: DataFrame, splits: DataFrame, group: str, path: str) -> None:
    """Rows by split, one directory each."""
    df.join(splits, group).write.mode("overwrite").partitionBy("split").json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, modified) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def changed_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): files that were added, removed or changed between two `fingerprints`; none: nothing changed."""
    a, b = before.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("path", change.alias("change"))


def read_snapshots(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a file, with its `path`; a file that holds none gives nulls. A missing path is an empty table."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), *kind.fields]))
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", kind).alias("v"))
    return files.select("path", *(F.col("v")[f.name].alias(f.name) for f in kind.fields))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text): lines that are no JSON object, with their number; blank lines are none of them.

    Files are numbered as a whole, so this is for the report after a strict scan has failed.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
    return files.where((F.trim("text") != "") & F.try_parse_json("text").isNull() | (F.trim("text") != "") & ~F.ltrim("text").startswith("{")).select("path", (F.col("at") + 1).alias("line"), "text")


def clear_outputs(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Delete the named outputs under `root` and give those that were there; names that lead out of it are refused."""
    gone = []
    for name in names:
        if name.startswith("/") or ".." in name.split("/") or not name.strip("./"):
            raise ValueError(f"not an output of {root}: {name!r}")
        target = f"{root.rstrip('/')}/{name}"
        if _exists(spark, target):
            p = spark._jvm.org.apache.hadoop.fs.Path(target)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            gone.append(name)
    return gone


def replacement_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, n): replacement characters in each text file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", (F.length("value") - F.length(F.replace("value", F.lit("�"), F.lit("")))).alias("n"))


def profile_jsonl(spark: SparkSession, path: str, keys: int = 12) -> DataFrame:
    """(key, n): the commonest top-level keys of JSON lines; null key: lines that are no object."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    n = lines.select(F.explode_outer(F.json_object_keys("value")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), F.asc_nulls_last("key")).limit(keys)


def _exists(spark: SparkSession, path: str) -> bool:
    if "://" not in path:
        return Path(path).exists()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
