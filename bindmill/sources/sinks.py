"""Sinks: tables, id lists, FASTA, one file per chain, metric records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def id_lines(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("value"))


def fasta_lines(chains: DataFrame) -> DataFrame:
    """Two-line FASTA record per chain."""
    head = F.concat(F.lit(">"), F.col("pdb_id"), F.lit("_"), F.col("chain_id"))
    return chains.select(F.concat_ws("\n", head, F.col("sequence_1l")).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_chain_files(chain_lines: DataFrame, path: str) -> None:
    """One ordered text file per (entry, chain); a chain holds at most 99,999 numbered atoms."""
    keys = ["pdb_id", "chain_id"]
    (chain_lines.repartition(*keys).sortWithinPartitions(*keys, "line_no")
     .select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path))


def write_split_matrices(df: DataFrame, path: str, split: str = "split") -> None:
    """Feature vectors and targets, one folder per split."""
    write_table(df, path, partition_by=(split,))


def write_record(df: DataFrame, path: str) -> None:
    """Small metric or parameter record as JSON."""
    df.write.mode("overwrite").json(path)
