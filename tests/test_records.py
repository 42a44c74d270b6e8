"""Record lines, chains and nested metadata on hand-made rows."""

import gzip

import pytest
from pyspark.sql import functions as F

from bindmill.functions.residues import residue_rows, residue_table
from bindmill.operators import sequences
from bindmill.schema import CHEM_COMPONENT, ENTRY_METADATA, LIGANDS_PER_CHAIN, all_text
from bindmill.sources import metadata, records, sinks, tables


def atom(record, residue, chain, position, serial=1, other=" "):
    return f"{record:<6}{serial:>5}  CA {other}{residue:>3} {chain}{position:>4}      1.000   2.000   3.000"


def frame(spark, lines, name="1abc.ent"):
    rows = [(name, name.split(".")[0], i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file_name string, entry_id string, line_no long, value string")


def test_water_and_other_records(spark):
    lines = frame(spark, [atom("ATOM", "ALA", "A", 1), atom("HETATM", "HOH", "A", 2), atom("HETATM", "HOH", "A", 3, other="A"),
                          "REMARK HOH", atom("HETATM", "ATP", "A", 4)])
    assert records.clean_records(lines).count() == 3       # the alternate water escapes the text test
    assert records.clean_records(lines, strict=True).count() == 2


def test_numbering_gate_drops_the_whole_file(spark):
    good = frame(spark, [atom("ATOM", "ALA", "A", -5), atom("ATOM", "ALA", "A", 1), "REMARK"], "good.ent")
    bad = frame(spark, [atom("ATOM", "ALA", "A", 1), atom("ATOM", "ALA", "A", "1B")], "bad.ent")
    kept = records.numbering_gate(good.unionByName(bad))
    assert {(r.file_name, r.value[:6]) for r in kept.collect()} == {("good.ent", "ATOM  "), ("good.ent", "REMARK")}


def test_dbref_cases(spark):
    lines = frame(spark, [
        "DBREF  1ABC A   -3   100  UNP    P12345   NAME_HUMAN    10    120",
        "DBREF  1ABC B    1   100  PDB    1ABC     1ABC           1    100",
        "DBREF  1ABC C    1   100  UNP    P1",
        "DBREF1 1ABC D    1   100  UNP    NAME_HUMAN x",
        "DBREF  1ABC E    1    50  UNP    P99999   N_HUMAN",
    ])
    got = {r.chain_id: tuple(r)[2:] for r in records.parse_dbref(lines).collect()}
    assert got["A"] == ("P12345", None, 100, 10, 120)
    assert got["C"] == ("P1", 1, 100, None, None)
    assert got["E"] == ("P99999", 1, 50, None, None)
    assert set(got) == {"A", "C", "D", "E"}
    assert {r.chain_id for r in records.parse_dbref(lines, strict=True).collect()} == {"A", "C", "E"}


def test_entries_without_mapping(spark):
    lines = frame(spark, ["DBREF  1ABC A 1 9 UNP P1 N 1 9"]).unionByName(frame(spark, ["REMARK"], "2xyz.ent"))
    missing = records.entries_without_mapping(lines, records.parse_dbref(lines))
    assert [r.pdb_id for r in missing.collect()] == ["2xyz"]


def test_chain_assembly(spark):
    lines = frame(spark, [
        atom("ATOM", "MSE", "A", 1), atom("ATOM", "MSE", "A", 1), atom("ATOM", "GLY", "A", 1),
        atom("ATOM", "HID", "A", 2), atom("ATOM", "TRP", "B", 7), atom("ATOM", "UNK", "B", 8),
        atom("HETATM", "ZN", "C", 1), atom("HETATM", "ATP", "A", 9), atom("HETATM", "ATP", "A", 9)])
    sites = sequences.residue_sites(records.parse_atoms(lines), residue_table(spark))
    chains = {r.chain_id: r for r in sequences.assemble_chains(sites).collect()}
    assert chains["A"].sequence_3l_pdb == "MSE-HID" and chains["A"].sequence_3l_std == "MET-HIS"
    assert chains["A"].sequence_1l == "MH" and chains["A"].positions == "1-2"
    assert chains["B"].sequence_1l == "W"
    strict = sequences.ligands_per_chain(records.parse_atoms(lines), residue_table(spark))
    assert [(r.chain_id, r.ligand_id) for r in strict.collect()] == [("A", "ATP,ZN")]
    parity = sequences.ligands_per_chain(records.parse_atoms(lines), residue_table(spark), drop_ambiguous=False)
    assert {r.chain_id for r in parity.collect()} == {"A", "B"}
    assert sequences.ambiguous_chains(sites, threshold=1.0).count() == 0


def test_no_ligand_and_chain_lines(spark):
    alone = frame(spark, [atom("ATOM", "ALA", "A", 1)], "2aaa.ent")
    table = sequences.ligands_per_chain(records.parse_atoms(alone), residue_table(spark))
    assert table.first().ligand_id == "NO_LIGAND"
    lines = frame(spark, [atom("ATOM", "MSE", "A", 1), atom("ATOM", "ALA", "B", 1), atom("HETATM", "ATP", "Z", 2)])
    out = sequences.chain_lines(records.parse_atoms(lines), residue_table(spark)).collect()
    by_chain = {c: [r.value for r in sorted(out, key=lambda r: r.line_no) if r.chain_id == c] for c in "AB"}
    assert by_chain["A"] == [atom("ATOM", "MET", "A", 1), atom("HETATM", "ATP", "Z", 2)]
    assert by_chain["B"] == [atom("ATOM", "ALA", "B", 1), atom("HETATM", "ATP", "Z", 2)]


def test_residue_table():
    table = {code: (std, letter) for code, std, letter in residue_rows()}
    assert table["MSE"] == ("MET", "M") and table["HIE"] == ("HIS", "H") and table["ALA"] == ("ALA", "A")
    assert len(table) == len(residue_rows()) < 200


def test_prune_ligands(spark):
    lines = frame(spark, [atom("ATOM", "ALA", "A", 1), atom("HETATM", "ATP", "A", 2), atom("HETATM", "ZN", "A", 3), "TER"])
    valid = spark.createDataFrame([("ATP",)], "ligand_id string")
    assert {r.value[17:20] for r in records.prune_ligands(lines, valid).collect()} == {"ALA", "ATP", ""}


def test_cif_admission(spark):
    head = ["data_x", "loop_", "_atom_site.group_PDB", "_atom_site.id", "_atom_site.label_comp_id",
            "_atom_site.auth_seq_id", "_atom_site.auth_asym_id"]
    good = frame(spark, [*head, "ATOM 1 MSE 5 A", "HETATM 2 ATP 6 B"], "good.cif")
    bad = frame(spark, [*head, "ATOM 1 ALA 5 AA"], "bad.cif")
    atoms = records.parse_cif_atoms(good.unionByName(bad))
    assert [r.file_name for r in records.cif_rejects(atoms).collect()] == ["bad.cif"]
    assert [(r.record, r.residue, r.chain_id, r.position) for r in records.admit_cif(atoms).orderBy("line_no").collect()] == [
        ("ATOM", "MSE", "A", "5"), ("HETATM", "ATP", "B", "6")]


def test_cif_reject_reasons_name_every_file_that_is_not_admitted(spark):
    head = ["loop_", "_atom_site.group_PDB", "_atom_site.label_comp_id", "_atom_site.auth_asym_id"]
    files = {"good.cif": [*head, "ATOM MSE A"], "long.cif": [*head, "ATOM ALA AA"], "bare.cif": ["data_x", "ATOM ALA A"],
             "header.cif": head, "empty.cif": []}
    lines = frame(spark, files["good.cif"], "good.cif")
    for name in ("long.cif", "bare.cif", "header.cif"):
        lines = lines.unionByName(frame(spark, files[name], name))
    listed = spark.createDataFrame([(name,) for name in files], "file_name string")
    atoms = records.parse_cif_atoms(lines)
    assert {r.file_name: r.reason for r in records.cif_reject_reasons(listed, lines, atoms).collect()} == {
        "long.cif": "chain name of more than one letter", "bare.cif": "no _atom_site loop", "header.cif": "no coordinate rows",
        "empty.cif": "no lines"}
    assert {r.file_name for r in records.admit_cif(atoms).collect()} == {"good.cif"}


def test_record_files_are_read_in_order(spark, tmp_path):
    lines = [atom("ATOM", "ALA", "A", i % 9000, serial=i % 90000) for i in range(3000)]
    (tmp_path / "1abc.ent").write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "2xyz.ent.gz", "wt") as out:
        out.write(lines[0] + "\n")
    (tmp_path / "skip.txt").write_text("ATOM\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = records.read_records(spark, str(tmp_path), "ent")
        assert scan.rdd.getNumPartitions() > 3
        rows = scan.orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == lines and {r.entry_id for r in rows} == {"1abc"}
    assert records.read_records(spark, str(tmp_path), "ent.gz").first().entry_id == "2xyz"
    listing = tables.list_files(spark, str(tmp_path), "ent")
    assert [r.file_name for r in listing.collect()] == ["1abc.ent"]
    wanted = spark.createDataFrame([("1abc",), ("9zzz",)], "pdb_id string")
    assert [r.pdb_id for r in tables.missing_files(wanted, "pdb_id", listing).collect()] == ["9zzz"]


def test_sinks(spark, tmp_path):
    lines = frame(spark, [atom("ATOM", "ALA", "A", 2), atom("ATOM", "GLY", "A", 1), atom("HETATM", "ATP", "B", 2)])
    chains = sequences.chain_lines(records.parse_atoms(lines), residue_table(spark))
    sinks.write_chain_files(chains, str(tmp_path / "chains"))
    files = list((tmp_path / "chains").glob("pdb_id=*/chain_id=*/*.txt"))
    assert len(files) == 1
    assert [line[17:20] for line in files[0].read_text().splitlines()] == ["ALA", "GLY", "ATP"]
    table = spark.createDataFrame([("1abc", "A", "", "", "MH", "1-2", "NA")], LIGANDS_PER_CHAIN)
    sinks.write_table(table, str(tmp_path / "csv"), "csv")
    back = tables.read_csv(spark, str(tmp_path / "csv"), LIGANDS_PER_CHAIN, ["ligand_id", "sequence_1l"])
    assert back.first().asDict() == {"ligand_id": "NA", "sequence_1l": "MH"}   # NA stays a code
    text = tables.read_csv(spark, str(tmp_path / "csv"), all_text(table.columns))
    assert set(dict(text.dtypes).values()) == {"string"}
    sinks.write_text(sinks.fasta_lines(table), str(tmp_path / "fasta"))
    assert spark.read.text(str(tmp_path / "fasta")).count() == 2
    sinks.write_text(sinks.id_lines(table, "pdb_id"), str(tmp_path / "ids"))
    assert spark.read.text(str(tmp_path / "ids")).first().value == "1abc"
    sinks.write_record(table.select(F.lit(0.5).alias("f1")), str(tmp_path / "record"))
    assert tables.read_json(spark, str(tmp_path / "record"), "f1 DOUBLE").first().f1 == 0.5


def test_nested_metadata(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join([
        '{"pdb_id":"a","rcsb_entry_info":{"experimental_method":"X-ray","polymer_entity_count_protein":2,"resolution_combined":[2.1,3.0]},'
        '"entities":[{"source":[{"organism_scientific_name":"First"}]},{"source":[{},{"organism_scientific_name":"Second"},{"organism_scientific_name":"Third"}]},{"source":[]}]}',
        '{"pdb_id":"b","rcsb_entry_info":{"experimental_method":"NMR","polymer_entity_count_protein":1},"entities":[]}',
        '{"pdb_id":"c","rcsb_entry_info":{"polymer_entity_count_protein":1}}',
        '{"pdb_id":"d","rcsb_entry_info":{"experimental_method":"X-ray","polymer_entity_count_protein":0}}',
        '{"pdb_id":"e","rcsb_entry_info":{"experimental_method":"X-ray"}}']))
    got = {r.pdb_id: (r.organism, r.resolution) for r in metadata.protein_entries(
        tables.read_json(spark, str(tmp_path / "e.json"), ENTRY_METADATA)).collect()}
    assert got == {"a": ("Second", 2.1), "b": ("Unknown", None)}
    (tmp_path / "c.json").write_text("\n".join([
        '{"ligand_id":"ATP","chem_comp":{"type":"NON-POLYMER","name":"atp"},"pdbx_chem_comp_descriptor":['
        '{"type":"SMILES","descriptor":"S1"},{"type":"SMILES_CANONICAL","descriptor":"bad"},'
        '{"type":"SMILES_CANONICAL","descriptor":"C2"},{"type":"InChIKey","descriptor":"K1"},{"type":"InChIKey","descriptor":"K2"}]}',
        '{"ligand_id":"XYZ"}']))
    rows = {r.ligand_id: r for r in metadata.component_table(
        tables.read_json(spark, str(tmp_path / "c.json"), CHEM_COMPONENT), lambda s: s != "bad").collect()}
    assert (rows["ATP"].canonical_smiles, rows["ATP"].inchikey, rows["ATP"].ligand_type, rows["ATP"].name) == ("C2", "K2", "non-polymer", "ATP")
    assert rows["XYZ"].canonical_smiles is None and rows["XYZ"].ligand_type == "type not found"


@pytest.mark.parametrize("line", [atom("ATOM", "ALA", "A", 1)])
def test_put_field_keeps_the_line(spark, line):
    from bindmill.functions.scalars import put_field
    out = frame(spark, [line]).select(put_field("value", 18, 20, F.lit("ZN")).alias("v")).first().v
    assert out == line[:17] + " ZN" + line[20:]
