"""All stages in a row on a small made-up archive, from record lines to scored splits."""

import random

import pytest
from pyspark.sql import functions as F

from bindmill.functions.residues import STANDARD_RESIDUES, residue_table
from bindmill.operators import models
from bindmill.plans import flows
from bindmill.schema import ACTIVITIES, CHEM_COMPONENT, MOLECULES, TARGETS
from bindmill.sources import records
from test_records import atom, frame

CODES = STANDARD_RESIDUES.split()[::2]
N_ENTRIES, LIGANDS = 40, ["ATP", "NAG", "HEM", "STI", "GOL", "BTN", "FAD"]


@pytest.fixture(scope="module")
def archive(spark):
    """Forty entries of two chains; chain B is too short, one entry has a broken residue number."""
    rng = random.Random(1)
    lines = None
    for e in range(N_ENTRIES):
        name = f"{e:04d}"
        body = [atom("ATOM", rng.choice(CODES), "A", i) for i in range(1, 41)] + [atom("ATOM", "ALA", "B", 1)]
        body += [atom("HETATM", lig, "A", 90) for lig in rng.sample(LIGANDS, 3)] + [atom("HETATM", "HOH", "A", 95)]
        body.append(f"DBREF  {name} A 1 40 UNP P{e % 20:05d} N_HUMAN 1 {40 + e}")
        if e == 0:
            body.append(atom("ATOM", "GLY", "A", "1X"))
        part = frame(spark, body, f"{name}.ent")
        lines = part if lines is None else lines.unionByName(part)
    return lines.persist()


@pytest.fixture(scope="module")
def linked(spark, archive):
    chains = flows.chain_table(archive, residue_table(spark))
    components = spark.createDataFrame(
        [(lig, ("NON-POLYMER", f"{lig} THING"), [("SMILES", f"smi{lig}"), ("InChIKey", f"key{lig}")], 300.0, 3, 1, 1)
         for lig in LIGANDS if lig != "GOL"] + [("GOL", ("NON-POLYMER", "BUFFER SALT"), [("SMILES", "g")], 90.0, 1, 1, 1)],
        CHEM_COMPONENT)
    kept, excluded = flows.ligand_tables(chains, components)
    assert {r.ligand_id for r in kept.collect()} == set(LIGANDS) - {"GOL"}
    assert {(r.ligand_id, r.exclude_reason) for r in excluded.collect()} == {("GOL", "forbidden word")}
    entries = spark.createDataFrame([(f"{e:04d}", "X-RAY", "Homo sapiens" if e % 10 else "Mus musculus", f"{2 + e / 10}" if e % 7 else "N/A")
                                     for e in range(N_ENTRIES)], "pdb_entry string, experimental_method string, organism string, resolution string")
    ligands = kept.select("ligand_id", "ligand_type", "name", "canonical_smiles", "inchikey")
    master = flows.master_table(chains, ligands, entries)
    assert master.select("pdb_id").distinct().count() == N_ENTRIES - 1
    assert {r.chain_id for r in master.select("chain_id").distinct().collect()} == {"A"}
    molecules = spark.createDataFrame(
        [(f"M{lig}", f"key{lig}" if i % 2 else None, f"smi{lig}") for i, lig in enumerate(LIGANDS)], MOLECULES)
    targets = spark.createDataFrame(
        [(f"T{t}", "SINGLE PROTEIN", [(f"P{t:05d}",), (None,)]) for t in range(20)] + [("TX", "PROTEIN COMPLEX", [("P00003",)])], TARGETS)
    rng = random.Random(2)
    acts = [(f"M{lig}", f"T{t}", "Homo sapiens", "B", kind, "=", "nM", value, round(9 - i / 7 + rng.random() / 5, 2))
            for i, lig in enumerate(LIGANDS) for t in range(20) for kind, value in (("Ki", 10.0 ** (i % 4) + t), ("IC50", 5.0))]
    activities = spark.createDataFrame(acts + acts[:5], ACTIVITIES)
    return flows.link_activities(master, records.parse_dbref(archive), molecules, targets, activities).persist()


def test_linking(linked):
    assert linked.filter("molecule_chembl_id = 'MGOL'").count() == 0
    assert linked.select("molecule_chembl_id").distinct().count() == len(LIGANDS) - 1
    assert linked.filter("target_type IS NULL").count() == 0
    assert linked.count() == linked.distinct().count()


@pytest.mark.parametrize("branch, kinds", [("pki", {"Ki"}), ("pchembl", {"Ki", "IC50"})])
def test_labels(linked, branch, kinds):
    labels = flows.curated_labels(linked, branch)
    assert labels.count() == labels.select("molecule_chembl_id", "sequence_1l").distinct().count() > 30
    assert {r.type for r in labels.select("type").distinct().collect()} <= kinds
    with pytest.raises(ValueError):
        flows.label_rows(linked, "other")


def test_features_split_and_scores(linked):
    def ligand_features(frames):
        for f in frames:
            yield f.assign(ligand_features=f["canonical_smiles"].map(lambda s: [float(sum(map(ord, s)) % 17), float(len(s))]))

    def protein_features(frames):
        for f in frames:
            yield f.assign(protein_features=f["sequence_1l"].map(lambda s: [s.count(c) / len(s) for c in "ALKG"]))

    labels = flows.curated_labels(linked, "pki")
    features = flows.one_organism(flows.feature_table(
        labels, ligand_features, "canonical_smiles string, ligand_features array<double>",
        protein_features, "sequence_1l string, protein_features array<double>"))
    rows = flows.split_features(features, ["ligand_features", "protein_features"])
    assert rows.count() == features.count()
    assert set(r.split for r in rows.select("split").distinct().collect()) <= set(flows.SPLITS)
    width = lambda df: {r.n for r in df.select(F.size("features").alias("n")).collect()}
    assert width(rows) == {5}  # one letter is in no sequence: a position without variance goes, unless it is asked for
    assert width(flows.split_features(features, ["ligand_features", "protein_features"], constant=False)) == {6}
    ranges = {**models.TREE_RANGES, "maxIter": (2, 3), "maxDepth": (2, 3)}
    scores, trials = flows.train_and_evaluate(
        rows, "p_activity", models.draw_tree_params(1, ranges=ranges), models.boosted_trees)
    assert {"train", "test"} <= {r.split for r in scores.collect()} and trials.count() == 1


def test_split_features_keeps_rows_without_a_block(spark):
    rows = [(f"M{i}", f"smi{i}", "ACDE" * (1 + i % 6), f"{i:04d}", "A", "ATP", 6.0 + i / 50, [float(i), 1.0 + i % 3] if i % 3 else None,
             [float(i % 5), None if i == 7 else float(i % 4), float("nan") if i == 8 else 2.0 * i]) for i in range(90)]
    features = spark.createDataFrame(rows, "molecule_chembl_id string, canonical_smiles string, sequence_1l string, pdb_id string, "
                                     "chain_id string, ligand_id string, p_activity double, l array<double>, p array<double>")
    want = {"columns": (90, 1, (90, 0, 5, 4, 0)), "rows": (58, 5, (90, 32, 5, 0, 0)), "fill": (90, 5, (90, 0, 5, 0, 62))}
    for missing, (n, width, told) in want.items():
        split, report = flows.split_features_report(features, ["l", "p"], missing=missing)
        assert tuple(report.first()) == told and split.count() == n
        assert {r.n for r in split.select(F.size("features").alias("n")).collect()} == {width}
        assert split.filter(F.exists("features", lambda x: x.isNull() | F.isnan(x))).count() == 0
    assert flows.split_features(features, ["l", "p"]).count() == 90
    with pytest.raises(ValueError):
        flows.split_features(features, ["l"])
    with pytest.raises(ValueError):
        flows.split_features(features, ["l", "p"], missing="other")
