"""Sinks followed by scans: tables, texts, record files and listings through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.functions.scalars import swap_extension, vector_columns
from bindmill.operators import scaling, sequences, splitting
from bindmill.queries.common import big, r6, table
from bindmill.queries.structures import _ATOMS, _CHAINS, _atoms, _sites
from bindmill.schema import all_text
from bindmill.session import new_path
from bindmill.sources import records, sinks, tables

CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


def csv_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV table read back with a declared schema and a column subset."""
    path = new_path(spark)
    sinks.write_table(table(spark, folder, "customer"), path, "csv")
    return tables.read_csv(spark, path, CUSTOMER, ["c_custkey", "c_acctbal", "c_mktsegment"])


def csv_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Free text with quotes and line breaks survives CSV; every column is read as text."""
    path = new_path(spark)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    sinks.write_table(turns, path, "csv")
    back = tables.read_csv(spark, path, all_text(turns.columns))
    return back.select("conv_id", "turn", "role", "text")


def csv_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Commas, quotes, line breaks, backslashes, outer blanks and missing cells survive CSV."""
    path = new_path(spark)
    awkward = F.concat(F.lit(' say "'), "p_name", F.lit('", \\n\\ "\nand, '), "p_brand", F.lit('" '))
    parts = table(spark, folder, "part").select("p_partkey", awkward.alias("quoted"), F.when(
        F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"))
    sinks.write_table(parts, path, "csv")
    return tables.read_csv(spark, path, "p_partkey BIGINT, quoted STRING, name STRING")


def id_list(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark)
    sinks.write_text(sinks.id_lines(table(spark, folder, "orders"), "o_orderkey"), path)
    return spark.read.text(path)


def fasta_file(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark)
    chains = sequences.assemble_chains(_sites(spark, folder)).withColumnRenamed("entry_id", "pdb_id")
    sinks.write_text(sinks.fasta_lines(chains), path)
    lines = spark.read.text(path)
    return lines.groupBy(F.col("value").startswith(">").cast("long").alias("is_head")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("n_chars"))


def record_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Record lines written as text files, scanned back, cleaned and parsed."""
    path = new_path(spark)
    _atoms(spark, folder).select("value").write.text(path)
    atoms = records.parse_atoms(records.clean_records(records.read_records(spark, path, "txt"), strict=True))
    return atoms.groupBy("record", "residue").agg(F.count(F.lit(1)).alias("n"))


def chain_files(spark: SparkSession, folder: str) -> DataFrame:
    """One text file per (nation, last digit of the supplier name); listed and counted."""
    path = new_path(spark)
    lines = table(spark, folder, "supplier").select(
        F.lit("x").alias("file_name"), F.col("s_nationkey").cast("string").alias("pdb_id"),
        F.substring("s_name", -1, 1).alias("chain_id"), F.col("s_suppkey").alias("line_no"), F.col("s_name").alias("value"))
    sinks.write_chain_files(lines, path)
    listing = tables.list_files(spark, path, "txt")
    back = spark.read.text(path)
    return back.groupBy(big("pdb_id").alias("nation"), F.col("chain_id").cast("string").alias("chain")).agg(
        F.count(F.lit(1)).alias("n_lines")).withColumn("n_files", listing.agg(F.count(F.lit(1)).alias("n")).scalar())


def missing_entry_files(spark: SparkSession, folder: str) -> DataFrame:
    """Nations without a file, after one was written for each that has a supplier with a high balance."""
    path = new_path(spark)
    lines = table(spark, folder, "supplier").filter("s_acctbal > 8000").select(
        F.col("s_nationkey").cast("string").alias("pdb_id"), F.lit("A").alias("chain_id"),
        F.col("s_suppkey").alias("line_no"), F.col("s_name").alias("value"))
    sinks.write_chain_files(lines, path)
    wanted = table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("pdb_id"))
    return tables.missing_files(wanted, "pdb_id", tables.list_files(spark, path, "txt", r"pdb_id=([^/]+)/"))


def split_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled vectors stored by split; one split is read back by partition pruning."""
    path = new_path(spark)
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    rows = scaling.assemble(splitting.random_parts(part, ["p_partkey"]), ["p_size", "p_retailprice"])
    sinks.write_split_matrices(rows, path)
    back = tables.read_parquet(spark, path).filter("split = 'test'")
    names = vector_columns("features", "x", 2)
    return back.select("p_partkey", *[r6(n).alias(f"x{i + 1}") for i, n in enumerate(names)])


def stored_record(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark)
    stats = table(spark, folder, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("best"))
    sinks.write_record(stats, path)
    return tables.read_json(spark, path, "n BIGINT, best DOUBLE")


def renamed_files(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "supplier").select(F.concat("s_name", F.lit(".cif.cif")).alias("name"))
    return names.select(swap_extension("name", "cif", "ent").alias("name"))


QUERIES = {f.__name__: f for f in (
    csv_columns, csv_texts, csv_quoted, id_list, fasta_file, record_scan, chain_files, missing_entry_files,
    split_matrices, stored_record, renamed_files)}

_TOKEN = "md5('42|' || p_partkey) || ':' || p_partkey"

ORACLES = {
    "csv_columns": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "csv_texts": """
SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations""",
    "csv_quoted": r"""
SELECT p_partkey, ' say "' || p_name || '", \n\ "' || chr(10) || 'and, ' || p_brand || '" ' AS quoted,
  CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name FROM part""",
    "id_list": "SELECT o_orderkey::VARCHAR AS value FROM orders",
    "fasta_file": _ATOMS + _CHAINS.format(source="a") + """
SELECT 1::BIGINT AS is_head, count(*) AS n, CAST(sum(length(entry_id) + 3) AS BIGINT) AS n_chars FROM c
UNION ALL SELECT 0, count(*), CAST(sum(length(sequence_1l)) AS BIGINT) FROM c""",
    "record_scan": _ATOMS + " SELECT record, residue, count(*) AS n FROM a WHERE residue <> 'HOH' GROUP BY record, residue",
    "chain_files": """
SELECT s_nationkey::BIGINT AS nation, right(s_name, 1) AS chain, count(*) AS n_lines,
  (SELECT count(DISTINCT (s_nationkey, right(s_name, 1))) FROM supplier) AS n_files FROM supplier GROUP BY ALL""",
    "missing_entry_files": """
SELECT n_nationkey::VARCHAR AS pdb_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)""",
    "split_matrices": f"""
SELECT p_partkey, round(p_size, 6)::DOUBLE AS x1, round(p_retailprice, 6) + 0.0 AS x2 FROM (
  SELECT *, row_number() OVER (ORDER BY {_TOKEN}) AS rk, count(*) OVER () AS n FROM part)
WHERE rk <= ceil(0.10::DOUBLE * n)""",
    "stored_record": "SELECT count(*) AS n, max(o_totalprice) AS best FROM orders",
    "renamed_files": "SELECT s_name || '.cif.ent' AS name FROM supplier",
}
