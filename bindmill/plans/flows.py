"""Whole stages, from record lines to scored splits. Each takes and returns frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from bindmill.functions.scalars import composite_key, coverage, p_activity, to_number
from bindmill.operators import cascade, curation, dedup, filters, linking, metrics, models, scaling, sequences, splitting
from bindmill.schema import require_columns
from bindmill.session import durable
from bindmill.sources import metadata, records

SPLITS = ["train", "val", "test", "blind", "blind_protein", "blind_ligand"]
MIN_CHAIN_LENGTH = 30
ORGANISM = "Homo sapiens"


def chain_table(lines: DataFrame, residues: DataFrame, drop_ambiguous: bool = True) -> DataFrame:
    """Record lines to the chain table: numbering gate, water removal, sequences, ligand lists."""
    cleaned = records.clean_records(records.numbering_gate(lines), strict=True)
    return sequences.ligands_per_chain(records.parse_atoms(cleaned), residues, drop_ambiguous=drop_ambiguous)


def ligand_tables(chains: DataFrame, components: DataFrame,
                  rules: cascade.LigandRules | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) ligands of the chain table."""
    listed = filters.not_equal_or_missing(chains, "ligand_id", "NO_LIGAND")
    codes = linking.explode_list(listed.select("ligand_id"), "ligand_id").distinct()
    judged = cascade.exclusion_cascade(
        codes.join(metadata.component_table(components), "ligand_id", "left"), rules or cascade.LigandRules())
    return cascade.kept(judged), cascade.excluded(judged)


def master_table(chains: DataFrame, ligands: DataFrame, entries: DataFrame,
                 min_length: int = MIN_CHAIN_LENGTH, entry_key: str = "pdb_entry") -> DataFrame:
    """One row per (entry, chain, ligand) with ligand and entry data.

    ``ligands`` holds one row per ligand, so the inner join is semi join and
    look-up in one exchange.
    """
    listed = filters.not_equal_or_missing(chains, "ligand_id", "NO_LIGAND")
    rows = filters.long_enough(linking.explode_list(listed, "ligand_id"), "sequence_1l", min_length)
    joined = rows.join(ligands, "ligand_id")
    ties = [c for c in joined.columns if c not in ("pdb_id", "chain_id", "ligand_id")]
    first = dedup.keep_first(joined, ["pdb_id", "chain_id", "ligand_id"], ties)
    return first.join(entries, first["pdb_id"] == entries[entry_key], "left")


def current_entries(holdings: DataFrame, status: str, entry: str, current: str) -> DataFrame:
    """Distinct lower-case ids of the current entries; an error if one of them also has another status."""
    checked = dedup.check_holdings(holdings, status, entry, current)
    return checked.filter(F.col(status) == current).select(F.lower(entry).alias("entry")).distinct()


def link_activities(master: DataFrame, mappings: DataFrame, molecules: DataFrame, targets: DataFrame,
                    activities: DataFrame) -> DataFrame:
    """Attach accessions, molecule ids, target ids and measurements to the master table."""
    known = mappings.filter(F.col("uniprot_id").isNotNull())
    mapped = linking.attach_facts(known, master, ["pdb_id", "chain_id"])
    with_molecule = linking.fallback_lookup(
        mapped, molecules, ("inchikey", "standard_inchi_key"), ("canonical_smiles", "canonical_smiles"),
        "molecule_chembl_id")
    with_target = linking.multimap_lookup(
        with_molecule, linking.component_targets(targets), "uniprot_id", "accession", "target_chembl_id")
    keys = ["molecule_chembl_id", "target_chembl_id"]
    rows = with_target.na.drop(subset=keys)
    kinds = targets.select("target_chembl_id", "target_type").distinct()
    return linking.attach_facts(rows, activities.join(kinds, "target_chembl_id", "left"), keys)


def label_rows(linked: DataFrame, branch: str) -> tuple[DataFrame, curation.CurationRoles, bool]:
    """Filtered measurements of one branch (``pki`` or ``pchembl``) with measure, coverage and resolution."""
    rows = linked.withColumn("pdb_coverage", coverage("pdb_start", "pdb_end", "uniprot_start", "uniprot_end"))
    rows = rows.withColumn("resolution", to_number("resolution"))
    shared = {"target_type": "SINGLE PROTEIN", "assay_type": "B"}
    if branch == "pki":
        rows = filters.measure_filter(rows, {**shared, "type": "Ki", "standard_relation": "=", "standard_units": "nM"},
                                      positive="standard_value")
        rows = rows.withColumn("p_activity", p_activity("standard_value"))
    elif branch == "pchembl":
        rows = filters.measure_filter(rows, shared, present="pchembl_value")
        rows = rows.withColumn("p_activity", F.col("pchembl_value"))
    else:
        raise ValueError(f"unknown branch {branch}")
    named = ["pdb_id", "chain_id", "ligand_id", "uniprot_id", "target_chembl_id", "p_activity"]
    ties = [*named, *sorted(c for c in rows.columns if c not in named)]  # a total order of different rows
    return rows, curation.CurationRoles(ties=ties), branch == "pchembl"


def curated_labels(linked: DataFrame, branch: str) -> DataFrame:
    rows, roles, chain_dedup = label_rows(linked, branch)
    return curation.curate(rows, roles, chain_dedup)


def feature_table(labels: DataFrame, ligand_features: Callable, ligand_schema: str,
                  protein_features: Callable, protein_schema: str) -> DataFrame:
    """Labels with ligand and protein features, each computed once per distinct input."""
    require_columns(labels, ["canonical_smiles", "sequence_1l"])
    with_ligand = scaling.attach_per_distinct(labels, "canonical_smiles", ligand_features, ligand_schema)
    return scaling.attach_per_distinct(with_ligand, "sequence_1l", protein_features, protein_schema, skip="X")


def one_organism(features: DataFrame, organism: str = ORGANISM) -> DataFrame:
    """Rows whose structure and assay agree on the given organism."""
    return filters.same_value(features, "organism", "target_organism").filter(F.col("organism") == organism)


def split_features(features: DataFrame, blocks: list[str], target: str = "p_activity", missing: str = "columns",
                   fill: float = 0.0, constant: bool = True) -> DataFrame:
    """Scaled feature vectors with target, identities and split, stored in the checkpoint folder."""
    return split_features_report(features, blocks, target, missing, fill, constant)[0]


def split_features_report(features: DataFrame, blocks: list[str], target: str = "p_activity", missing: str = "columns",
                          fill: float = 0.0, constant: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of ``split_features`` and the report of ``scaling.whole_blocks``: rows, positions and elements that went.

    By default the feature positions that are missing in some row go and every row stays; ``missing`` may also be
    ``rows`` or ``fill``. Positions without variance go unless ``constant`` is false.
    """
    ids = ["molecule_chembl_id", "canonical_smiles", "sequence_1l", "pdb_id", "chain_id", "ligand_id"]
    kept, report = scaling.whole_blocks(features, blocks, missing, fill, constant)
    rows = kept.withColumn("molecule", F.trim("canonical_smiles")).withColumn("sequence", F.trim("sequence_1l"))
    rows = rows.withColumn("pair_key", composite_key("pdb_id", "chain_id", "sequence", "ligand_id"))
    vectors = durable(scaling.concat_features(
        rows.select(*ids, "molecule", "sequence", "pair_key", target, *blocks), blocks))
    split = splitting.six_way_split(vectors, "molecule", "sequence", key=["molecule_chembl_id", "sequence"])
    return durable(scaling.scale_on_train(split)), report


def train_and_evaluate(rows: DataFrame, target: str, candidates: list[dict], build: Callable,
                       cut: float = metrics.ACTIVITY_CUT) -> tuple[DataFrame, DataFrame]:
    """(metrics per split, trials) of the candidate with the best validation F1."""
    labelled = rows.withColumn("activity", (F.col(target) >= cut).cast("int"))
    model, trials = models.select_by_f1(labelled, "activity", candidates, build)
    scored = models.score(model, models.with_vector(labelled, "activity"))
    return metrics.evaluate(scored, "split", "activity", "predicted_proba"), trials
