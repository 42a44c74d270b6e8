"""Label curation: best structure per measurement, then one measurement per interaction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindmill.operators.grouping import first_per_key
from bindmill.session import durable

SIGMA_SLACK = 1e-9      # two-value groups have |z| = 1 up to rounding
DISTANCE_DIGITS = 9     # distances that differ less are ties, settled by the structure order


@dataclass
class CurationRoles:
    """Column names of the measurement table."""

    molecule: str = "molecule_chembl_id"
    sequence: str = "sequence_1l"
    measure: str = "p_activity"
    entry: str = "pdb_id"
    chain: str = "chain_id"
    coverage: str = "pdb_coverage"
    resolution: str = "resolution"
    accession: str = "uniprot_id"
    ties: list[str] = field(default_factory=list)

    @property
    def interaction(self) -> list[str]:
        return [self.molecule, self.sequence]

    @property
    def quality(self) -> list[Column]:
        return [F.col(self.coverage).desc_nulls_last(), F.col(self.resolution).asc_nulls_last()]

    @property
    def tie_order(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in self.ties]


def curate(rows: DataFrame, roles: CurationRoles, chain_dedup: bool,
           distance_digits: int = DISTANCE_DIGITS) -> DataFrame:
    """One row per (molecule, sequence) with ``z`` and ``z_reason``.

    Both picks drop rows before their exchange and the group statistics are partial sums, so an interaction of any
    size takes the same way and is never gathered. The picked rows are stored once, as the statistics and the join
    read them both. Distances to the mean that agree to ``distance_digits`` decimals are ties.
    """
    rows = rows.na.drop(subset=[*roles.interaction, roles.measure])
    if chain_dedup:
        rows = first_per_key(rows, [roles.sequence, roles.entry, roles.chain],
                             [*roles.quality, *roles.tie_order])
        structure_order = [F.col(roles.entry), F.col(roles.chain), *roles.quality, *roles.tie_order]
    else:
        structure_order = [F.col(roles.accession), *roles.quality, *roles.tie_order]

    picked = durable(first_per_key(rows, [roles.molecule, roles.measure, roles.sequence], structure_order))
    stats = [stat.alias(name) for name, stat in _group_stats(F.col(roles.measure)).items()]
    per_group = picked.groupBy(*roles.interaction).agg(*stats)
    return _nearest_to_mean(picked.join(per_group, roles.interaction), roles, structure_order, distance_digits)


def _group_stats(measure: Column) -> dict[str, Column]:
    return {"_mean": F.avg(measure), "_std": F.stddev_pop(measure),
            "_low": F.min(measure), "_high": F.max(measure)}


def _nearest_to_mean(df: DataFrame, roles: CurationRoles, structure_order: list[Column],
                     distance_digits: int) -> DataFrame:
    """Row closest to the group mean.

    With population deviation some |z| <= 1 always exists, so the smallest |z|
    within range and the row nearest to the mean are the same row.
    """
    measure = F.col(roles.measure)
    conflict = (F.col("_low") < F.col("_high")) & (F.col("_std") > 0)
    z = F.when(conflict, (measure - F.col("_mean")) / F.col("_std"))
    reason = (F.when(F.col("z").isNull(), "identical_or_single_value")
              .when(F.abs("z") <= 1 + SIGMA_SLACK, "within_range").otherwise("outlier_kept"))
    distance = F.when(conflict, F.round(F.abs(measure - F.col("_mean")), distance_digits)).otherwise(F.lit(0.0))
    picked = first_per_key(df.withColumn("z", z), roles.interaction, [distance, *structure_order])
    return picked.withColumn("z_reason", reason).drop(*_group_stats(measure))


def curation_report(curated: DataFrame, roles: CurationRoles) -> DataFrame:
    """Counters of what is left after curation: repeated variants, repeated
    interactions, and accession-molecule pairs with several sequences."""
    variant = [roles.accession, *roles.interaction, roles.entry, roles.chain]
    curated = durable(curated.select(*variant))  # read once per check

    def repeated(keys: list[str], name: str) -> DataFrame:
        sizes = curated.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.lit(name).alias("check"), F.count_if(F.col("n") > 1).alias("n_groups"))

    sequences = curated.groupBy(roles.accession, roles.molecule).agg(F.countDistinct(roles.sequence).alias("n"))
    several = sequences.agg(F.lit("several_sequences").alias("check"), F.count_if(F.col("n") > 1).alias("n_groups"))
    return repeated(variant, "repeated_variants").unionByName(
        repeated(roles.interaction, "repeated_interactions")).unionByName(several)
