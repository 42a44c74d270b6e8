"""Declared schemas of the stage tables (DDL texts for ``spark.read.schema``), and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


HOLDINGS = "status STRING, entry_id STRING"

ENTRY_METADATA = """
    pdb_id STRING,
    rcsb_entry_info STRUCT<experimental_method: STRING, polymer_entity_count_protein: INT,
                           resolution_combined: ARRAY<DOUBLE>>,
    entities ARRAY<STRUCT<source: ARRAY<STRUCT<organism_scientific_name: STRING>>>>"""

CHEM_COMPONENT = """
    ligand_id STRING,
    chem_comp STRUCT<type: STRING, name: STRING>,
    pdbx_chem_comp_descriptor ARRAY<STRUCT<type: STRING, descriptor: STRING>>,
    mw DOUBLE, rot_bonds INT, h_donors INT, h_acceptors INT"""

PROTEIN_DATA = "pdb_id STRING, experimental_method STRING, organism STRING, resolution STRING"

UNIPROT_MAPPINGS = """
    pdb_id STRING, chain_id STRING, uniprot_id STRING,
    pdb_start INT, pdb_end INT, uniprot_start INT, uniprot_end INT"""

LIGANDS_PER_CHAIN = """
    pdb_id STRING, chain_id STRING, sequence_3l_pdb STRING, sequence_3l_std STRING,
    sequence_1l STRING, positions STRING, ligand_id STRING"""

FILTERED_LIGANDS = """
    ligand_id STRING, ligand_type STRING, name STRING, canonical_smiles STRING, inchikey STRING"""

MOLECULES = "molecule_chembl_id STRING, standard_inchi_key STRING, canonical_smiles STRING"

TARGETS = """
    target_chembl_id STRING, target_type STRING, target_components ARRAY<STRUCT<accession: STRING>>"""

ACTIVITIES = """
    molecule_chembl_id STRING, target_chembl_id STRING, target_organism STRING, assay_type STRING,
    type STRING, standard_relation STRING, standard_units STRING,
    standard_value DOUBLE, pchembl_value DOUBLE"""


def all_text(names: list[str]) -> T.StructType:
    """Schema that reads every column as text."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def matching_columns(df: DataFrame, prefix: str | None = None,
                     contains: tuple[str, ...] = ()) -> list[str]:
    """Column names that start with ``prefix`` or contain one of the given parts."""
    return [c for c in df.columns
            if (prefix is not None and c.startswith(prefix)) or any(p in c for p in contains)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column, so that one kind of missing is left."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])
