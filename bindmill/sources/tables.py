"""Table scans and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bindmill.functions.scalars import entry_of_file
from bindmill.schema import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             columns: list[str] | None = None) -> DataFrame:
    """Headered CSV with a declared schema; only empty cells are missing, so the code ``NA`` survives.

    Quoted cells may hold commas, line breaks, doubled quotes and backslashes, so a file is read by one task.
    """
    df = (spark.read.schema(schema).option("header", True).option("nullValue", "")
          .option("quote", '"').option("escape", '"').option("multiLine", True).csv(path))
    return nan_to_null(df.select(*columns) if columns else df)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).json(path))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def list_files(spark: SparkSession, path: str, extension: str, entry: str | None = None) -> DataFrame:
    """Names, entries and sizes of the files with one extension; file contents are not read.

    The entry is told by the file's name, or by the first group of the pattern ``entry`` in its whole path.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}")
             .option("recursiveFileLookup", True).load(path))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    own = F.regexp_extract("path", entry, 1) if entry else entry_of_file(name)
    return files.select(name.alias("file_name"), own.alias("entry_id"), "length")


def missing_files(expected: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """Expected keys without a file."""
    return expected.select(key).distinct().join(
        files.select(F.col("entry_id").alias(key)), key, "left_anti")
