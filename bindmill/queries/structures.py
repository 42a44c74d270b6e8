"""Record lines, chains, references, nested metadata. Lines are written from lineitem columns, then parsed.

File = order, chain = line number, residue = part, position = supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindmill.functions.residues import residue_table
from bindmill.functions.scalars import fixed_field
from bindmill.operators import cascade, sequences
from bindmill.plans import flows
from bindmill.queries.common import big, table
from bindmill.schema import CHEM_COMPONENT, ENTRY_METADATA
from bindmill.session import durable
from bindmill.sources import metadata, records
from bindmill.sources.sinks import fasta_lines

RESIDUES = ["ALA", "MSE", "HID", "GLY", "UNK", "TRP", "SEP", "LYS"]
LIGANDS = ["HOH", "ATP", "NAG", "ZN", "HEM"]
CIF_LONG = 104_850


def _pick(values: list[str], key: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def _files(lines: DataFrame, extension: str, entry: str = "l_orderkey") -> DataFrame:
    """The lines as a stored record table, lines of one file together, as a scan of record files would give."""
    lines = lines.repartition(entry)
    entry = F.col(entry).cast("string")
    return durable(lines.select(
        F.concat(entry, F.lit(f".{extension}")).alias("file_name"), entry.alias("entry_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line_no"), "value"))


def _atom_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    hetero = F.col("l_returnflag") == "R"
    residue = F.when(hetero, _pick(LIGANDS, "l_suppkey")).otherwise(_pick(RESIDUES, "l_partkey"))
    other = F.when(hetero & (F.col("l_linestatus") == "O"), "A").otherwise(" ")
    position = F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), "1A").otherwise(
        F.pmod("l_suppkey", F.lit(10000)).cast("string"))
    value = F.concat(
        F.rpad(F.when(hetero, "HETATM").otherwise("ATOM"), 6, " "), F.lpad(F.col("l_linenumber").cast("string"), 5, " "),
        F.lit("  CA "), other, F.lpad(residue, 3, " "), F.lit(" "),
        _pick(["A", "B", "C"], "l_linenumber"), F.lpad(position, 4, " "), F.lit("      11.000  12.000  13.000"))
    return _files(lines.withColumn("value", value), "ent")


def _atoms(spark: SparkSession, folder: str) -> DataFrame:
    return records.parse_atoms(_atom_lines(spark, folder))


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.residue_sites(_atoms(spark, folder), residue_table(spark))


def _count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def cleaned_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _count(records.clean_records(_atom_lines(spark, folder)), "entry_id")


def cleaned_lines_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _count(records.clean_records(_atom_lines(spark, folder), strict=True), "entry_id")


def numbered_files(spark: SparkSession, folder: str) -> DataFrame:
    return _count(records.numbering_gate(_atom_lines(spark, folder)), "entry_id")


def parsed_atoms(spark: SparkSession, folder: str) -> DataFrame:
    return _atoms(spark, folder).groupBy("record", "residue", "chain_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("n_positions"))


def standard_residues(spark: SparkSession, folder: str) -> DataFrame:
    known = sequences.with_standard(_atoms(spark, folder).filter("record = 'ATOM'"), residue_table(spark))
    return known.groupBy("residue", F.coalesce("standard", F.lit("none")).alias("standard"),
                         F.coalesce("letter", F.lit("-")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


def ambiguous_chains(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.ambiguous_chains(_sites(spark, folder))


def assembled_chains(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.assemble_chains(_sites(spark, folder))


def ligand_sets(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.ligand_sets(_sites(spark, folder))


def chain_table(spark: SparkSession, folder: str) -> DataFrame:
    return flows.chain_table(_atom_lines(spark, folder), residue_table(spark)).select(
        "pdb_id", "chain_id", "sequence_1l", "positions", "ligand_id")


def fasta_records(spark: SparkSession, folder: str) -> DataFrame:
    chains = sequences.assemble_chains(_sites(spark, folder))
    return fasta_lines(chains.withColumnRenamed("entry_id", "pdb_id"))


def chain_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = sequences.chain_lines(_atoms(spark, folder), residue_table(spark))
    return lines.groupBy("pdb_id", "chain_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").startswith("HETATM")).alias("n_hetero"),
        F.max(fixed_field("value", 18, 20)).alias("last_residue"), big(F.max(F.length("value"))).alias("width"))


def pruned_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _atom_lines(spark, folder)
    strict = records.parse_atoms(records.clean_records(lines, strict=True))
    valid = strict.filter("record = 'HETATM' AND residue != 'ZN'").select(F.col("residue").alias("ligand_id"))
    return _count(records.prune_ligands(lines, valid), "entry_id")


def _dbref_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    number = F.col("l_suppkey").cast("string")
    value = F.concat_ws(
        " ", F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "DBREF1").otherwise("DBREF"),
        F.col("l_orderkey").cast("string"), _pick(["A", "B", "C"], "l_linenumber"),
        F.when(F.col("l_discount") == 0, F.concat(F.lit("-"), number)).otherwise(number),
        F.concat(F.lit("  "), F.col("l_partkey").cast("string")),
        F.when(F.col("l_quantity") > 1, F.when(F.col("l_tax") == 0, "PDB").otherwise("UNP")),
        F.when(F.col("l_quantity") > 1, F.concat(F.lit("P"), F.col("l_partkey"))),
        F.when(F.col("l_quantity") > 2, F.lit("NAME_HUMAN")),
        F.when(F.col("l_quantity") > 3, F.col("l_linenumber").cast("string")),
        F.when(F.col("l_quantity") > 4, F.lit("1x")))
    return _files(lines.withColumn("value", value), "ent")


def _references(df: DataFrame) -> DataFrame:
    return df.select("pdb_id", "chain_id", "uniprot_id", *[
        F.coalesce(big(c), F.lit(-1)).alias(c) for c in ("pdb_start", "pdb_end", "uniprot_start", "uniprot_end")])


def references(spark: SparkSession, folder: str) -> DataFrame:
    return _references(records.parse_dbref(_dbref_lines(spark, folder)))


def references_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _references(records.parse_dbref(_dbref_lines(spark, folder), strict=True))


def unmapped_entries(spark: SparkSession, folder: str) -> DataFrame:
    lines = _dbref_lines(spark, folder)
    return records.entries_without_mapping(lines, records.parse_dbref(lines))


def _cif_lines(spark: SparkSession, folder: str, headless: Column | None = None) -> DataFrame:
    """Loop rows with a header per file, but for the files for which ``headless`` holds."""
    lines = table(spark, folder, "lineitem")
    names = ["group_PDB", "id", "label_comp_id", "label_asym_id", "auth_seq_id", "auth_comp_id", "auth_asym_id"]
    chain = F.when(F.col("l_extendedprice") > CIF_LONG, "AA").otherwise(_pick(["A", "B", "C"], "l_linenumber"))
    row = F.concat_ws(" ", F.lit("ATOM"), F.col("l_linenumber").cast("string"), _pick(RESIDUES, "l_partkey"),
                      F.lit("XX"), F.col("l_orderkey").cast("string"), _pick(RESIDUES, "l_partkey"), chain)
    rows = _files(lines.withColumn("value", row), "cif", "l_suppkey")
    head = F.posexplode(F.array(*[F.lit(f"_atom_site.{n}") for n in names]))
    files = rows.select("file_name", "entry_id").distinct()
    heads = (files if headless is None else files.where(~headless)).select("file_name", "entry_id", head.alias("at", "value"))
    heads = heads.select("file_name", "entry_id", (F.col("at") - 100).cast("long").alias("line_no"), "value")
    return rows.unionByName(heads)


def admitted_cif(spark: SparkSession, folder: str) -> DataFrame:
    """Loop rows with a header per file; files with a two-letter chain name are rejected."""
    atoms = durable(records.parse_cif_atoms(_cif_lines(spark, folder)))
    return records.admit_cif(atoms).groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("chain_id").alias("last_chain"), F.min("residue").alias("first_residue"),
        big(F.max(F.col("position").cast("long"))).alias("last_position"))


def cif_reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The files that admission leaves out: files of one supplier in four have no loop, some are empty."""
    lines = _cif_lines(spark, folder, F.col("entry_id").cast("long") % 4 == 1)
    empty = F.concat(F.lit("empty"), F.col("s_suppkey").cast("string"), F.lit(".cif")).alias("file_name")
    files = lines.select("file_name").union(table(spark, folder, "supplier").where("s_suppkey % 5 = 0").select(empty))
    return records.cif_reject_reasons(files, lines, durable(records.parse_cif_atoms(lines)))


def entry_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as nested JSON entries, read back with the declared schema and flattened."""
    orders = table(spark, folder, "orders")

    def source(*names: Column) -> Column:
        return F.struct(F.array(*[F.struct(n.alias("organism_scientific_name")) for n in names]).alias("source"))

    none = F.lit(None).cast("string")
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    entities = F.array(
        source(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))),
        source(none, F.when(priority != "2-HIGH", priority), F.lit("never reached")),
        source(F.when(price > 250000, F.lit("Homo sapiens"))))
    info = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.lit("X-RAY")).alias("experimental_method"),
        F.when(priority != "5-LOW", F.substring(priority, 1, 1).cast("int") - 1).alias("polymer_entity_count_protein"),
        F.when(price > 100000, F.array(price, F.lit(1.0))).alias("resolution_combined"))
    second = F.when(price < 300000, entities).otherwise(F.array(source(none), source(none)))
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("pdb_id"), info.alias("rcsb_entry_info"),
                              second.alias("entities")))
    entries = orders.select(F.from_json(text, ENTRY_METADATA).alias("e")).select("e.*")
    return metadata.protein_entries(entries).withColumn("resolution", F.coalesce("resolution", F.lit(-1.0)))


def component_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Parts written as nested JSON components; canonical texts win, the last key is kept."""
    part = table(spark, folder, "part")

    def descriptor(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("descriptor"))

    texts = F.array(
        descriptor("SMILES", F.concat(F.lit("s:"), F.col("p_name"))),
        descriptor("SMILES_CANONICAL", F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("bad")),
        descriptor("InChIKey", F.col("p_brand")), descriptor("InChIKey", F.col("p_type")),
        descriptor("SMILES_CANONICAL", F.when(F.col("p_size") > 5, F.lower("p_brand")).otherwise("bad")))
    text = F.to_json(F.struct(
        F.col("p_partkey").cast("string").alias("ligand_id"),
        F.struct(F.when(F.col("p_size") != 7, F.col("p_type")).alias("type"), F.col("p_name").alias("name")).alias("chem_comp"),
        F.when(F.col("p_size") != 9, texts).alias("pdbx_chem_comp_descriptor")))
    components = part.select(F.from_json(text, CHEM_COMPONENT).alias("e")).select("e.*")
    chosen = metadata.component_table(components, lambda s: s != "bad")
    return chosen.select("ligand_id", "ligand_type", "name", F.coalesce("canonical_smiles", F.lit("none")).alias("canonical_smiles"), "inchikey")


def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    k = F.coalesce(F.from_json("props", "k INT, missing INT")["k"], F.lit(-1))
    absent = F.coalesce(F.from_json("props", "k INT, missing INT")["missing"], F.lit(0))
    return events.groupBy("event_type").agg(F.sum(k).alias("total_k"), F.sum(absent).alias("total_missing"))


def residue_ligand_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The default exclusion rules on the hetero codes found in the files."""
    codes = _atoms(spark, folder).filter("record = 'HETATM'").groupBy(F.col("residue").alias("ligand_id")).agg(
        F.count(F.lit(1)).alias("n_lines"))
    none = F.lit(None)
    known = codes.select(
        "ligand_id", "n_lines", F.when(F.col("ligand_id") != "NAG", "non-polymer").otherwise("d-saccharide linking").alias("ligand_type"),
        F.when(F.col("ligand_id") == "HEM", "HEME METAL SALT").otherwise(F.col("ligand_id")).alias("name"),
        F.lit("C").alias("canonical_smiles"), none.cast("double").alias("mw"), none.cast("int").alias("rot_bonds"),
        F.lit(20).alias("h_donors"), F.lit(3).alias("h_acceptors"))
    judged = cascade.exclusion_cascade(known, cascade.LigandRules())
    return judged.select("ligand_id", "n_lines", F.coalesce("exclude_reason", F.lit("kept")).alias("outcome"))


QUERIES = {f.__name__: f for f in (
    cleaned_lines, cleaned_lines_strict, numbered_files, parsed_atoms, standard_residues, ambiguous_chains,
    assembled_chains, ligand_sets, chain_table, fasta_records, chain_lines, pruned_lines, references,
    references_strict, unmapped_entries, admitted_cif, cif_reject_reasons, entry_metadata, component_choice, event_properties,
    residue_ligand_rules)}


def _list(values: list[str], key: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{key} % {len(values)} + 1]"


_ATOMS = f"""
WITH a AS (
  SELECT l_orderkey::VARCHAR AS entry_id, CASE WHEN l_returnflag = 'R' THEN 'HETATM' ELSE 'ATOM' END AS record,
    CASE WHEN l_returnflag = 'R' THEN {_list(LIGANDS, "l_suppkey")} ELSE {_list(RESIDUES, "l_partkey")} END AS residue,
    {_list(["A", "B", "C"], "l_linenumber")} AS chain_id, l_linestatus = 'O' AND l_returnflag = 'R' AS alternate,
    CASE WHEN l_tax = 0 AND l_discount = 0 THEN '1A' ELSE (l_suppkey % 10000)::VARCHAR END AS position,
    l_partkey * 10 + l_linenumber AS seq FROM lineitem),
k AS (SELECT unnest(['ALA', 'MSE', 'HID', 'GLY', 'TRP', 'SEP', 'LYS']) AS residue,
             unnest(['ALA', 'MET', 'HIS', 'GLY', 'TRP', 'SER', 'LYS']) AS standard,
             unnest(['A', 'M', 'H', 'G', 'W', 'S', 'K']) AS letter)"""

_CHAINS = """,
f AS (
  SELECT * FROM (SELECT a.*, standard, letter, row_number() OVER (
    PARTITION BY entry_id, chain_id, position ORDER BY seq, a.residue) AS rn FROM {source} a JOIN k USING (residue)
    WHERE record = 'ATOM') WHERE rn = 1),
c AS (
  SELECT entry_id, chain_id, string_agg(residue, '-' ORDER BY seq, position) AS sequence_3l_pdb,
    string_agg(standard, '-' ORDER BY seq, position) AS sequence_3l_std,
    string_agg(letter, '' ORDER BY seq, position) AS sequence_1l,
    string_agg(position, '-' ORDER BY seq, position) AS positions FROM f GROUP BY entry_id, chain_id)"""

_AMBIGUOUS = """(
  SELECT entry_id, chain_id, count(*) FILTER (standard IS NULL) AS n_unknown,
    count(DISTINCT position) FILTER (standard IS NOT NULL) AS n_valid
  FROM {source} a LEFT JOIN k USING (residue) WHERE record = 'ATOM' GROUP BY entry_id, chain_id
  HAVING count(*) FILTER (standard IS NULL) > 0)"""

_LIGAND_SETS = """(
  SELECT entry_id, string_agg(DISTINCT residue, ',' ORDER BY residue) AS ligand_id FROM {source}
  WHERE record = 'HETATM' GROUP BY entry_id)"""

_GATED = """,
g AS (SELECT * FROM a WHERE entry_id NOT IN (SELECT entry_id FROM a WHERE position = '1A') AND residue <> 'HOH')"""

_DBREF = f"""
SELECT l_orderkey::VARCHAR AS pdb_id, {_list(["A", "B", "C"], "l_linenumber")} AS chain_id, 'P' || l_partkey AS uniprot_id,
  CASE WHEN l_discount = 0 THEN -1 ELSE l_suppkey END AS pdb_start, l_partkey AS pdb_end,
  CASE WHEN l_quantity > 3 THEN l_linenumber::BIGINT ELSE -1 END AS uniprot_start, (-1)::BIGINT AS uniprot_end
FROM lineitem WHERE l_tax <> 0 AND l_quantity > 1"""

ORACLES = {
    "cleaned_lines": _ATOMS + """
SELECT entry_id, count(*) AS n FROM a WHERE NOT (residue = 'HOH' AND NOT alternate) GROUP BY entry_id""",
    "cleaned_lines_strict": _ATOMS + " SELECT entry_id, count(*) AS n FROM a WHERE residue <> 'HOH' GROUP BY entry_id",
    "numbered_files": _ATOMS + """
SELECT entry_id, count(*) AS n FROM a GROUP BY entry_id HAVING count(*) FILTER (position = '1A') = 0""",
    "parsed_atoms": _ATOMS + """
SELECT record, residue, chain_id, count(*) AS n, count(DISTINCT position) AS n_positions FROM a GROUP BY ALL""",
    "standard_residues": _ATOMS + """
SELECT residue, coalesce(standard, 'none') AS standard, coalesce(letter, '-') AS letter, count(*) AS n
FROM a LEFT JOIN k USING (residue) WHERE record = 'ATOM' GROUP BY ALL""",
    "ambiguous_chains": _ATOMS + " FROM " + _AMBIGUOUS.format(source="a"),
    "assembled_chains": _ATOMS + _CHAINS.format(source="a") + " FROM c",
    "ligand_sets": _ATOMS + " FROM " + _LIGAND_SETS.format(source="a"),
    "chain_table": _ATOMS + _GATED + _CHAINS.format(source="g") + f"""
SELECT entry_id AS pdb_id, chain_id, sequence_1l, positions, coalesce(ligand_id, 'NO_LIGAND') AS ligand_id
FROM c LEFT JOIN {_LIGAND_SETS.format(source="g")} USING (entry_id)
WHERE (entry_id, chain_id) NOT IN (SELECT (entry_id, chain_id) FROM {_AMBIGUOUS.format(source="g")})""",
    "fasta_records": _ATOMS + _CHAINS.format(source="a") + """
SELECT '>' || entry_id || '_' || chain_id || chr(10) || sequence_1l AS value FROM c""",
    "chain_lines": _ATOMS + _CHAINS.format(source="a") + f""",
kept AS (SELECT entry_id, chain_id FROM c WHERE (entry_id, chain_id) NOT IN (
  SELECT (entry_id, chain_id) FROM {_AMBIGUOUS.format(source="a")})),
l AS (
  SELECT entry_id, chain_id, record, standard AS residue FROM a JOIN kept USING (entry_id, chain_id) JOIN k USING (residue)
  WHERE record = 'ATOM'
  UNION ALL SELECT entry_id, kept.chain_id, record, residue FROM a JOIN kept USING (entry_id) WHERE record = 'HETATM')
SELECT entry_id AS pdb_id, chain_id, count(*) AS n, count(*) FILTER (record = 'HETATM') AS n_hetero,
  max(residue) AS last_residue, 54::BIGINT AS width FROM l GROUP BY entry_id, chain_id""",
    "pruned_lines": _ATOMS + """
SELECT entry_id, count(*) AS n FROM a WHERE record = 'ATOM' OR residue NOT IN ('HOH', 'ZN') GROUP BY entry_id""",
    "references": _DBREF,
    "references_strict": _DBREF + " AND NOT (l_returnflag = 'R' AND l_linestatus = 'O')",
    "unmapped_entries": """
SELECT l_orderkey::VARCHAR AS pdb_id FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_tax <> 0 AND l_quantity > 1) = 0""",
    "admitted_cif": f"""
SELECT l_suppkey::VARCHAR AS entry_id, count(*) AS n, max({_list(["A", "B", "C"], "l_linenumber")}) AS last_chain,
  min({_list(RESIDUES, "l_partkey")}) AS first_residue, max(l_orderkey) AS last_position
FROM lineitem GROUP BY l_suppkey HAVING max(l_extendedprice) <= {CIF_LONG}""",
    "cif_reject_reasons": f"""
SELECT l_suppkey || '.cif' AS file_name,
  CASE WHEN l_suppkey % 4 = 1 THEN 'no _atom_site loop' ELSE 'chain name of more than one letter' END AS reason
FROM lineitem GROUP BY l_suppkey HAVING l_suppkey % 4 = 1 OR max(l_extendedprice) > {CIF_LONG}
UNION ALL SELECT 'empty' || s_suppkey || '.cif', 'no lines' FROM supplier WHERE s_suppkey % 5 = 0""",
    "entry_metadata": """
SELECT o_orderkey::VARCHAR AS pdb_id, 'X-RAY' AS experimental_method,
  CASE WHEN o_totalprice >= 300000 THEN 'Unknown' WHEN o_totalprice > 250000 THEN 'Homo sapiens'
       WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority ELSE 'never reached' END AS organism,
  CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE -1 END AS resolution
FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')""",
    "component_choice": """
SELECT p_partkey::VARCHAR AS ligand_id, CASE WHEN p_size <> 7 THEN lower(p_type) ELSE 'type not found' END AS ligand_type,
  upper(p_name) AS name, CASE WHEN p_size = 9 THEN 'none' WHEN p_size > 10 THEN p_name WHEN p_size > 5 THEN lower(p_brand)
  ELSE 's:' || p_name END AS canonical_smiles, CASE WHEN p_size = 9 THEN 'InChIKey not found' ELSE p_type END AS inchikey
FROM part""",
    "event_properties": """
SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k, 0::BIGINT AS total_missing
FROM events GROUP BY event_type""",
    "residue_ligand_rules": _ATOMS + """
SELECT residue AS ligand_id, count(*) AS n_lines, CASE residue WHEN 'HOH' THEN 'listed code' WHEN 'ZN' THEN 'listed code'
  WHEN 'NAG' THEN 'linking type' WHEN 'HEM' THEN 'forbidden word' ELSE 'kept' END AS outcome
FROM a WHERE record = 'HETATM' GROUP BY residue""",
}
