"""Nested service records (entry metadata, chemical components) flattened to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def protein_entries(entries: DataFrame) -> DataFrame:
    """Entries with a known method and at least one protein, with first resolution and organism."""
    method = F.col("rcsb_entry_info.experimental_method")
    proteins = F.coalesce(F.col("rcsb_entry_info.polymer_entity_count_protein"), F.lit(0))
    return entries.filter(method.isNotNull() & (method != "N/A") & (proteins > 0)).select(
        "pdb_id",
        method.alias("experimental_method"),
        organism_of(F.col("entities")).alias("organism"),
        F.get(F.col("rcsb_entry_info.resolution_combined"), F.lit(0)).alias("resolution"),
    )


def organism_of(entities: Column) -> Column:
    """First organism named by the last entity that names one, else ``Unknown``."""
    names = F.transform(entities, lambda entity: F.get(F.filter(
        F.transform(entity["source"], lambda s: s["organism_scientific_name"]),
        lambda name: name.isNotNull()), F.lit(0)))
    named = F.filter(names, lambda name: name.isNotNull())
    return F.coalesce(F.get(F.reverse(named), F.lit(0)), F.lit("Unknown"))


def component_table(components: DataFrame, is_valid=lambda smiles: F.length(smiles) > 0) -> DataFrame:
    """Type, name, structure text and key of each component.

    ``is_valid`` is the extension point for a structure check: a function from
    a structure column to a boolean column. Canonical texts are tried first.
    """
    descriptors = F.col("pdbx_chem_comp_descriptor")

    def of_type(kind: str) -> Column:
        return F.transform(F.filter(descriptors, lambda d: d["type"] == kind), lambda d: d["descriptor"])

    none = F.array().cast("array<string>")
    texts = F.concat(F.coalesce(of_type("SMILES_CANONICAL"), none), F.coalesce(of_type("SMILES"), none))
    keys = F.coalesce(of_type("InChIKey"), none)
    return components.select(
        "ligand_id",
        F.lower(F.coalesce(F.col("chem_comp.type"), F.lit("Type not found"))).alias("ligand_type"),
        F.upper(F.coalesce(F.col("chem_comp.name"), F.lit("Name not found"))).alias("name"),
        F.get(F.filter(texts, is_valid), F.lit(0)).alias("canonical_smiles"),
        F.coalesce(F.get(F.reverse(keys), F.lit(0)), F.lit("InChIKey not found")).alias("inchikey"),
        *[c for c in ("mw", "rot_bonds", "h_donors", "h_acceptors") if c in components.columns],
    )
