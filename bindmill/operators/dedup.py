"""Distinct rows, key picks, set comparison and top-k reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bindmill.operators import sampling
from bindmill.operators.grouping import first_per_key

ORDERED_ROWS = 10_000  # rows of a sample that tasks and the driver may hold


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def keep_best(df: DataFrame, keys: list[str], larger: list[str], smaller: list[str],
              ties: list[str]) -> DataFrame:
    """Row with the largest, then smallest, measures per key; missing measures come last."""
    order: list[Column] = [F.col(c).desc_nulls_last() for c in larger]
    order += [F.col(c).asc_nulls_last() for c in [*smaller, *ties]]
    return first_per_key(df, keys, order)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).asc_nulls_last() for c in order])


def nearest_row(df: DataFrame, keys: list[str], measure: Column, ties: list[str]) -> DataFrame:
    """Row with the smallest measure per key, first in tie order."""
    return first_per_key(df, keys, [measure.asc_nulls_last(), *[F.col(c) for c in ties]])


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def only_left(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).subtract(b.select(column))


def holdings_overlaps(holdings: DataFrame, status: str, entry: str, current: str) -> DataFrame:
    """Per other status, how many current entries also carry it; lower-cased ids are compared."""
    ids = holdings.select(F.col(status).alias("status"), F.lower(entry).alias("entry")).distinct()
    held = ids.filter(F.col("status") == current).select("entry", F.lit(1).alias("held"))
    other = ids.filter(F.col("status") != current)
    return (other.join(held, "entry", "left").groupBy("status")
            .agg(F.count(F.lit(1)).alias("n_entries"), F.count("held").alias("n_shared")))


def check_holdings(holdings: DataFrame, status: str, entry: str, current: str) -> DataFrame:
    """The holdings, after raising if a current entry also has another status."""
    clash = holdings_overlaps(holdings, status, entry, current).filter("n_shared > 0").limit(1)
    for row in clash.take(1):
        raise ValueError(f"{row.n_shared} current entries are also {row.status}")
    return holdings


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), F.asc(column)).limit(k)


def count_of_counts(df: DataFrame, column: str) -> DataFrame:
    """How many values occur once, twice and so on."""
    return value_counts(df, column).groupBy(F.col("n").alias("occurrences")).agg(F.count(F.lit(1)).alias("n_values"))


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Number of values that occur more than once."""
    return value_counts(df, column).agg(F.count_if(F.col("n") > 1).alias("n_repeated"))


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42, ordered: int = ORDERED_ROWS) -> DataFrame:
    """Seeded sample of exactly ``n`` rows (all rows if fewer), by hash of a unique key.

    Up to ``ordered`` rows are the first ones of an ordering, of which every task keeps ``n``. For more, the hash of the
    last row is found from counts per prefix, so neither the rows nor the sample go through one task.
    """
    if n <= ordered:
        return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
    keys = df.select(key).filter(F.col(key).isNotNull())
    cut = sampling.rank_tokens(keys, [key], seed, lambda total: {"cut": min(n, total)})["cut"]
    return df.filter(sampling.up_to([key], seed, cut))
