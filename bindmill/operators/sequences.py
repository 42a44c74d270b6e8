"""Chains from coordinate records: sequences, positions, ligands, per-chain lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindmill.functions.scalars import put_field
from bindmill.operators import moments
from bindmill.operators.grouping import first_per_key
from bindmill.session import durable

CHAIN = ["entry_id", "chain_id"]


def with_standard(atoms: DataFrame, residues: DataFrame) -> DataFrame:
    """Adds the standard residue and its letter; both NULL for unknown residues."""
    return atoms.join(F.broadcast(residues), "residue", "left")


def residue_sites(atoms: DataFrame, residues: DataFrame) -> DataFrame:
    """One row per (entry, chain, record, position, residue) with first line and line count.

    A residue has many atom lines; all chain tables are derived from this
    reduced table, so the lines themselves are exchanged once, pre-aggregated.
    """
    sites = atoms.groupBy(*CHAIN, "record", "position", "residue").agg(
        F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n_lines"))
    return with_standard(sites, residues)


def ambiguous_chains(sites: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Chains whose unknown-residue lines exceed a share of their valid positions (at least one)."""
    known = F.col("standard").isNotNull()
    positions = sites.filter("record = 'ATOM'").groupBy(*CHAIN, "position").agg(
        F.sum(F.when(~known, F.col("n_lines")).otherwise(0)).alias("unknown"), F.max(known).alias("valid"))
    counts = positions.groupBy(*CHAIN).agg(
        F.sum("unknown").alias("n_unknown"), F.count_if("valid").alias("n_valid"))
    return counts.filter(F.col("n_unknown") / F.greatest(F.col("n_valid"), F.lit(1)) > threshold)


def first_residues(sites: DataFrame) -> DataFrame:
    """First accepted residue at each (entry, chain, position), in line order."""
    known = sites.filter((F.col("record") == "ATOM") & F.col("standard").isNotNull())
    return first_per_key(known, [*CHAIN, "position"], [F.col("line_no"), F.col("residue")])


def assemble_chains(sites: DataFrame) -> DataFrame:
    """Sequence texts per chain. The four-column residue number bounds a chain to 11,000 positions."""
    item = F.struct("line_no", "position", "residue", "standard", "letter")
    ordered = first_residues(sites).groupBy(*CHAIN).agg(F.array_sort(F.collect_list(item)).alias("r"))

    def joined(part: str, sep: str) -> Column:
        return F.array_join(F.col("r")[part], sep)

    return ordered.select(
        *CHAIN,
        joined("residue", "-").alias("sequence_3l_pdb"),
        joined("standard", "-").alias("sequence_3l_std"),
        joined("letter", "").alias("sequence_1l"),
        joined("position", "-").alias("positions"))


def ligand_sets(sites: DataFrame) -> DataFrame:
    """Sorted distinct hetero codes of each file; codes have three characters, which bounds the set."""
    hetero = sites.filter("record = 'HETATM'")
    return hetero.groupBy("entry_id").agg(
        F.array_join(F.sort_array(F.collect_set("residue")), ",").alias("ligand_id"))


def ligands_per_chain(atoms: DataFrame, residues: DataFrame, threshold: float = 0.0,
                      drop_ambiguous: bool = True) -> DataFrame:
    """Chain table. Every chain carries the ligands of its whole file."""
    sites = durable(residue_sites(atoms, residues))
    chains = assemble_chains(sites)
    if drop_ambiguous:
        chains = chains.join(ambiguous_chains(sites, threshold), CHAIN, "left_anti")
    ligands = F.coalesce("ligand_id", F.lit("NO_LIGAND")).alias("ligand_id")
    return chains.join(ligand_sets(sites), "entry_id", "left").select(
        F.col("entry_id").alias("pdb_id"), "chain_id", "sequence_3l_pdb", "sequence_3l_std",
        "sequence_1l", "positions", ligands)


def chain_lines(atoms: DataFrame, residues: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Record lines per kept chain: its own atoms with standard residue names, and all hetero lines of the file."""
    sites = durable(residue_sites(atoms, residues))
    kept = durable(first_residues(sites).select(*CHAIN).distinct().join(
        ambiguous_chains(sites, threshold), CHAIN, "left_anti"))
    own = with_standard(atoms.filter("record = 'ATOM'"), residues).join(kept, CHAIN, "left_semi")
    renamed = F.when(F.col("standard").isNotNull(), put_field("value", 18, 20, F.col("standard")))
    own = own.withColumn("value", F.coalesce(renamed, F.col("value")))
    hetero = atoms.filter("record = 'HETATM'").drop("chain_id").join(kept, "entry_id")
    columns = [F.col("entry_id").alias("pdb_id"), "chain_id", "line_no", "value"]
    return own.select(*columns).unionByName(hetero.select(*columns))


def pool_tokens(tokens: DataFrame, key: str, position: str, length: str, vector: str) -> DataFrame:
    """Mean of the token vectors at positions 1 to ``length`` of each key."""
    inside = tokens.filter((F.col(position) >= 1) & (F.col(position) <= F.col(length)))
    return moments.segment_means(inside, key, vector)
