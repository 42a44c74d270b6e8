"""Residue tables: modified residue to standard residue, standard residue to letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The public PDBFixer substitution list, protonation variants as
# named by AMBER, selenocysteine and pyrrolysine. "<code> <standard>" pairs.
MODIFIED_RESIDUES = """
2AS ASP  3AH HIS  5HP GLU  5OW LYS  ACL ARG  AGM ARG  AIB ALA  ALM ALA  ALO THR  ALY LYS  ARM ARG
ASA ASP  ASB ASP  ASK ASP  ASL ASP  ASQ ASP  AYA ALA  BCS CYS  BHD ASP  BMT THR  BNN ALA
BUC CYS  BUG LEU  C5C CYS  C6C CYS  CAS CYS  CCS CYS  CEA CYS  CGU GLU  CHG ALA  CLE LEU  CME CYS
CSD ALA  CSO CYS  CSP CYS  CSS CYS  CSW CYS  CSX CYS  CXM MET  CY1 CYS  CY3 CYS  CYG CYS
CYM CYS  CYQ CYS  DAH PHE  DAL ALA  DAR ARG  DAS ASP  DCY CYS  DGL GLU  DGN GLN  DHA ALA
DHI HIS  DIL ILE  DIV VAL  DLE LEU  DLY LYS  DNP ALA  DPN PHE  DPR PRO  DSN SER  DSP ASP
DTH THR  DTR TRP  DTY TYR  DVA VAL  EFC CYS  FLA ALA  FME MET  GGL GLU  GL3 GLY  GLZ GLY
GMA GLU  GSC GLY  HAC ALA  HAR ARG  HIC HIS  HIP HIS  HMR ARG  HPQ PHE  HTR TRP  HYP PRO
IAS ASP  IIL ILE  IYR TYR  KCX LYS  LLP LYS  LLY LYS  LTR TRP  LYM LYS  LYZ LYS  MAA ALA  MEN ASN
MHS HIS  MIS SER  MK8 LEU  MLE LEU  MPQ GLY  MSA GLY  MSE MET  MVA VAL  NEM HIS  NEP HIS  NLE LEU
NLN LEU  NLP LEU  NMC GLY  OAS SER  OCS CYS  OMT MET  PAQ TYR  PCA GLU  PEC CYS  PHI PHE
PHL PHE  PR3 CYS  PRR ALA  PTR TYR  PYX CYS  SAC SER  SAR GLY  SCH CYS  SCS CYS  SCY CYS
SEL SER  SEP SER  SET SER  SHC CYS  SHR LYS  SMC CYS  SOC CYS  STY TYR  SVA SER  TIH ALA
TPL TRP  TPO THR  TPQ ALA  TRG LYS  TRO TRP  TYB TYR  TYI TYR  TYQ TYR  TYS TYR  TYY TYR
HID HIS  HIE HIS  LYN LYS  ASH ASP  GLH GLU  SEC CYS  PYL LYS
"""

# The twenty standard residues and their letters.
STANDARD_RESIDUES = """
ALA A  ARG R  ASN N  ASP D  CYS C  GLN Q  GLU E  GLY G  HIS H  ILE I
LEU L  LYS K  MET M  PHE F  PRO P  SER S  THR T  TRP W  TYR Y  VAL V
"""


def _pairs(text: str) -> list[tuple[str, str]]:
    tokens = text.split()
    return list(zip(tokens[::2], tokens[1::2]))


def residue_rows() -> list[tuple[str, str, str]]:
    """(code, standard residue, letter) of every accepted residue."""
    letters = dict(_pairs(STANDARD_RESIDUES))
    rows = [(code, code, letter) for code, letter in letters.items()]
    return rows + [(code, std, letters[std]) for code, std in _pairs(MODIFIED_RESIDUES)]


def residue_table(spark: SparkSession) -> DataFrame:
    """Under two hundred rows, so it is always safe to broadcast."""
    return spark.createDataFrame(residue_rows(), "residue string, standard string, letter string")
