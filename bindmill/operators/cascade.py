"""Ordered exclusion rules with a reason, and drug-likeness counters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bindmill.functions.scalars import has_word

# Component codes excluded without a look-up, words that exclude
# a name or type, and the limits of the two drug-likeness rules.
EXCLUDED_CODES = "FE2 ZN2 CU CA MG HOH DOD PO4 SO4 FE ZN K CL NI CO NA NH2 NH3".split()
FORBIDDEN_WORDS = "ion metal solvent water buffer salt".split()
POLYMER_WORDS = "dna rna".split()
LINKING_PATTERN = "peptide.*linking|terminus| linking"
RELAXED_LIMITS = {"mw": 750, "rot_bonds": 15, "h_donors": 10, "h_acceptors": 15}
RULE_OF_FIVE = {"mw": 500, "logp": 5, "h_donors": 5, "h_acceptors": 10}


def failed_criteria(limits: dict[str, float]) -> Column:
    """How many measures exceed their limit; a missing measure passes."""
    fails = [F.when(F.col(c) > limit, 1).otherwise(0) for c, limit in limits.items()]
    return reduce(Column.__add__, fails)


def rule_of_five(df: DataFrame, limits: dict[str, float], allowed: int = 1) -> DataFrame:
    """A flag per measure, the number of violations and the verdict; a missing measure violates."""
    flags = {f"{c}_ok": F.coalesce(F.col(c) <= limit, F.lit(False)) for c, limit in limits.items()}
    flagged = df.withColumns(flags)
    violations = reduce(Column.__add__, [F.when(F.col(f), 0).otherwise(1) for f in flags])
    return flagged.withColumn("violations", violations).withColumn("drug_like", F.col("violations") <= allowed)


@dataclass
class LigandRules:
    """Rules in the order they apply, with the columns and values they use."""

    code: str = "ligand_id"
    name: str = "name"
    kind: str = "ligand_type"
    structure: str = "canonical_smiles"
    codes: list[str] = field(default_factory=lambda: EXCLUDED_CODES)
    code_length: int = 3
    words: list[str] = field(default_factory=lambda: FORBIDDEN_WORDS)
    polymers: list[str] = field(default_factory=lambda: POLYMER_WORDS)
    linking: str = LINKING_PATTERN
    limits: dict[str, float] = field(default_factory=lambda: dict(RELAXED_LIMITS))
    max_failed: int = 1

    def reason(self) -> Column:
        kind = F.lower(F.col(self.kind))
        word = has_word(self.name, self.words) | has_word(self.kind, self.words)
        return (
            F.when(F.col(self.code).isin(self.codes), "listed code")
            .when(F.length(self.code) != self.code_length, "code length")
            .when(F.col(self.kind).isNull(), "not found")
            .when(F.coalesce(word, F.lit(False)), "forbidden word")
            .when(has_word(self.kind, self.polymers), "nucleic acid")
            .when(kind.rlike(self.linking), "linking type")
            .when(F.col(self.structure).isNull(), "no valid structure")
            .when(failed_criteria(self.limits) > self.max_failed, "failed criteria")
        )


def exclusion_cascade(ligands: DataFrame, rules: LigandRules) -> DataFrame:
    """Every ligand with ``exclude_reason``; NULL means kept. Kept and excluded rows share one pass."""
    return ligands.withColumn("exclude_reason", rules.reason())


def kept(cascade: DataFrame) -> DataFrame:
    return cascade.filter(F.col("exclude_reason").isNull()).drop("exclude_reason")


def excluded(cascade: DataFrame) -> DataFrame:
    return cascade.filter(F.col("exclude_reason").isNotNull())
