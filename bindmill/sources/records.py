"""Structure record files: scans and parsers of fixed-width and loop records.

A record frame has ``file_name``, ``entry_id``, ``line_no`` and ``value``.
``line_no`` orders the lines of a file: the byte offset of the input split,
then the row's place in its task. Files are therefore split over tasks like
any other text, and none is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from bindmill.functions.scalars import digits_to_int, entry_of_file, fixed_field
from bindmill.session import durable

ROW_BITS = 33  # of a monotonically increasing id, below the number of the task


def read_records(spark: SparkSession, path: str, extension: str) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", f"*.{extension}").text(path)
    return lines.select(
        F.col("_metadata.file_name").alias("file_name"),
        entry_of_file(F.col("_metadata.file_name")).alias("entry_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block_start"),
                 F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1).alias("row")).alias("line_no"),
        "value",
    )


def _is_coordinate(line: Column) -> Column:
    return line.startswith("ATOM") | line.startswith("HETATM")


def parse_atoms(lines: DataFrame) -> DataFrame:
    """Coordinate records with residue name, chain and residue number columns."""
    line = F.col("value")
    return lines.filter(_is_coordinate(line)).select(
        "*",
        F.when(line.startswith("ATOM"), F.lit("ATOM")).otherwise(F.lit("HETATM")).alias("record"),
        fixed_field(line, 18, 20).alias("residue"),
        F.substring(line, 22, 1).alias("chain_id"),
        fixed_field(line, 23, 26).alias("position"),
    )


def clean_records(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Coordinate records without water.

    By default a line counts as water when `` HOH `` stands in it; ``strict``
    looks at the residue columns instead and so finds alternate locations too.
    """
    line = F.col("value")
    water = fixed_field(line, 18, 20) == "HOH" if strict else line.contains(" HOH ")
    return lines.filter(_is_coordinate(line) & ~water)


def numbering_gate(lines: DataFrame) -> DataFrame:
    """Drop every file in which a coordinate record has no whole residue number.

    The names of such files are stored first. Their size is then known, so Spark sends them to the tasks that read the
    lines if they are few, and lines are exchanged by file only if they are not.
    """
    line = F.col("value")
    bad = lines.filter(_is_coordinate(line) & ~fixed_field(line, 23, 26).rlike(r"^[+-]?[0-9]+$"))
    return lines.join(durable(bad.select("file_name").distinct()), "file_name", "left_anti")


def parse_dbref(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Sequence-database references of UniProt kind: at least seven tokens, one of them ``UNP``.

    ``strict`` leaves out the two-line variants of the record, whose columns differ.
    """
    line = F.col("value")
    kept = line.startswith("DBREF ") if strict else line.startswith("DBREF")
    kept = kept & line.rlike(r"^\s*(\S+\s+){6}\S") & line.rlike(r"(^|\s)UNP(\s|$)")
    parsed = lines.filter(kept).withColumn("_t", F.split(F.trim(line), r"\s+"))
    after = F.array_position("_t", "UNP").cast("int")  # 1-based place of the mark = 0-based place after it

    def number(i: Column) -> Column:
        return digits_to_int(F.get("_t", i))

    return parsed.select(
        F.col("entry_id").alias("pdb_id"),
        F.get("_t", F.lit(2)).alias("chain_id"),
        F.get("_t", after).alias("uniprot_id"),
        number(F.lit(3)).alias("pdb_start"),
        number(F.lit(4)).alias("pdb_end"),
        number(after + 2).alias("uniprot_start"),
        number(after + 3).alias("uniprot_end"),
    )


def entries_without_mapping(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    entries = lines.select(F.col("entry_id").alias("pdb_id")).distinct()
    return entries.join(mappings.select("pdb_id"), "pdb_id", "left_anti")


def parse_cif_atoms(lines: DataFrame) -> DataFrame:
    """Rows of the ``_atom_site`` loop as coordinate records.

    The loop header names the columns of each file, so its lines are numbered
    per file (a few dozen per file) and joined back to the file's rows.
    """
    value = F.trim(F.col("value"))
    heads = lines.filter(value.startswith("_atom_site.")).select(
        "file_name", F.regexp_extract(value, r"^_atom_site\.(\S+)", 1).alias("name"),
        (F.row_number().over(W.partitionBy("file_name").orderBy("line_no")) - 1).alias("at"))
    places = heads.groupBy("file_name").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "at"))).alias("_at"))
    rows = (lines.filter(_is_coordinate(F.col("value")))
            .withColumn("_t", F.split(value, r"\s+")).join(places, "file_name"))

    def cell(name: str) -> Column:
        return F.get("_t", F.try_element_at("_at", F.lit(name)))

    def author(name: str) -> Column:
        return F.coalesce(cell(f"auth_{name}"), cell(f"label_{name}"))

    return rows.select(
        "file_name", "entry_id", "line_no",
        cell("group_PDB").alias("record"), author("comp_id").alias("residue"),
        author("asym_id").alias("chain_id"), author("seq_id").alias("position"))


def cif_rejects(atoms: DataFrame) -> DataFrame:
    """Files with a chain name that does not fit the one-letter column."""
    longest = atoms.groupBy("file_name").agg(F.max(F.length("chain_id")).alias("longest"))
    return longest.filter(F.col("longest") > 1).select("file_name")


def cif_reject_reasons(files: DataFrame, lines: DataFrame, atoms: DataFrame) -> DataFrame:
    """(file_name, reason) of all listed files that ``admit_cif`` leaves out, one row per file.

    ``files`` lists every file, also an empty one, of which a scan of lines has nothing. ``atoms`` are the parsed rows of
    ``lines``.
    """
    admitted = admit_cif(atoms).select("file_name").distinct()
    value = F.trim(F.col("value"))
    seen = lines.groupBy("file_name").agg(F.bool_or(value.startswith("_atom_site.")).alias("loop"))
    rejected = files.select("file_name").distinct().join(admitted, "file_name", "left_anti")
    named = cif_rejects(atoms).withColumn("long_name", F.lit(True))
    reason = F.when(F.col("long_name"), "chain name of more than one letter").when(
        F.col("loop").isNull(), "no lines").when(~F.col("loop"), "no _atom_site loop").otherwise("no coordinate rows")
    return rejected.join(seen, "file_name", "left").join(named, "file_name", "left").select(
        "file_name", reason.alias("reason"))


def admit_cif(atoms: DataFrame) -> DataFrame:
    """Rows of the files that ``cif_rejects`` does not name; the names are stored first, as in ``numbering_gate``."""
    return atoms.join(durable(cif_rejects(atoms)), "file_name", "left_anti")


def prune_ligands(lines: DataFrame, valid: DataFrame, key: str = "ligand_id") -> DataFrame:
    """Keep every line except hetero records of ligands that are not in ``valid``.

    One reading of the lines: the codes, of at most three characters each, are stored first and go to the tasks that
    read the lines if Spark finds them small enough.
    """
    code = F.when(F.col("value").startswith("HETATM"), fixed_field("value", 18, 20))
    known = durable(valid.select(F.col(key).alias("_ligand")).where(F.length("_ligand") <= 3).distinct())
    told = lines.withColumn("_code", code).join(known, F.col("_code") == F.col("_ligand"), "left")
    return told.where(~F.col("value").startswith("HETATM") | F.col("_ligand").isNotNull()).drop("_code", "_ligand")
