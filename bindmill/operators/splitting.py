"""Leakage-safe partitions along two identity axes, and overlap reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from bindmill.operators.sampling import key_sample_cut, rank_tokens, up_to
from bindmill.session import durable

BLIND_SHARE = 0.15
TEST_SHARE = 0.10
VALIDATION_SHARE = 0.1111  # of what is left after the test rows


def part_sizes(n: int, test: float = TEST_SHARE, validation: float = VALIDATION_SHARE) -> tuple[int, int]:
    """Rows of the test and validation parts; each share is rounded up, the second is of the remainder."""
    n_test = math.ceil(test * n)
    return n_test, math.ceil(validation * (n - n_test))


def blind_label(keys: DataFrame, ligand: str, protein: str, share: float = BLIND_SHARE, seed: int = 42) -> Column:
    """blind (both keys sampled), blind_protein, blind_ligand, or rest (neither)."""
    ligand_in, protein_in = (up_to([c], seed, key_sample_cut(keys, c, share, seed)) for c in (ligand, protein))
    return (F.when(ligand_in & protein_in, "blind").when(protein_in, "blind_protein")
            .when(ligand_in, "blind_ligand").otherwise("rest"))


def part_label(keys: DataFrame, key: list[str], seed: int = 42, test: float = TEST_SHARE,
               validation: float = VALIDATION_SHARE) -> Column:
    """train, val or test with exact counts; ``key`` identifies a row."""
    def ranks(n: int) -> dict[str, int]:
        n_test, n_val = part_sizes(n, test, validation)
        return {"test": n_test, "val": n_test + n_val}

    cuts = rank_tokens(keys, key, seed, ranks)
    in_test, in_val = (up_to(key, seed, cuts[c]) for c in ("test", "val"))
    return F.when(in_test, "test").when(in_val, "val").otherwise("train")


def blind_classes(df: DataFrame, ligand: str, protein: str, share: float = BLIND_SHARE, seed: int = 42,
                  name: str = "split") -> DataFrame:
    """Rows with their blind class; rows that lack a key are left out."""
    rows = df.na.drop(subset=[ligand, protein])
    return rows.withColumn(name, blind_label(rows, ligand, protein, share, seed))


def random_parts(df: DataFrame, key: list[str], seed: int = 42, test: float = TEST_SHARE,
                 validation: float = VALIDATION_SHARE, name: str = "split") -> DataFrame:
    return df.withColumn(name, part_label(df, key, seed, test, validation))


def six_way_split(df: DataFrame, ligand: str, protein: str, key: list[str], seed: int = 42) -> DataFrame:
    """train, val, test, blind, blind_protein and blind_ligand in one ``split`` column.

    Only the key columns are stored and counted; the label is then a plain
    expression on each row, so wide feature columns are never moved.
    """
    rows = df.na.drop(subset=[ligand, protein])
    keys = durable(rows.select(*dict.fromkeys([ligand, protein, *key])))
    blind = blind_label(keys, ligand, protein, seed=seed)
    part = part_label(keys.filter(blind == "rest"), key, seed)
    return rows.withColumn("split", F.when(blind == "rest", part).otherwise(blind))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))


def overlap_report(df: DataFrame, axes: dict[str, Column], split: str, base: list[str],
                   others: list[str]) -> DataFrame:
    """Shared distinct keys between the base splits and every other split, per axis.

    All axes go through one scan and one exchange: a key carries a bit per split.
    """
    bit = F.when(F.col(split).isin(base), 1)
    for i, other in enumerate(others):
        bit = bit.when(F.col(split) == other, 2 << i)
    keys = df.select(bit.alias("bit"), F.explode(F.array(*[
        F.struct(F.lit(axis).alias("axis"), key.cast("string").alias("key")) for axis, key in axes.items()
    ])).alias("k")).select("bit", "k.*").filter(F.col("key").isNotNull() & F.col("bit").isNotNull())
    seen = keys.groupBy("axis", "key").agg(F.bit_or("bit").alias("mask"))
    shared = [F.struct(F.lit(other).alias("split"),
                       F.count_if(F.col("mask").bitwiseAND((2 << i) + 1) == (2 << i) + 1).alias("n_shared"))
              for i, other in enumerate(others)]
    return seen.groupBy("axis").agg(F.array(*shared).alias("s")).select("axis", F.inline("s"))


def leakage_simulation(df: DataFrame, key: list[str], axes: dict[str, Column], test: float = 0.2,
                       seed: int = 42) -> DataFrame:
    """Keys per axis that a plain random split puts on both sides."""
    parts = random_parts(df, key, seed=seed, test=test, validation=0.0)
    report = overlap_report(parts, axes, "split", ["train", "val"], ["test"])
    return report.select("axis", F.col("n_shared").alias("n_overlap"))
