"""Per-key picks and running totals that stay distributed when one key is very large."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindmill.session import durable

BIN_ROWS = 1_000_000    # running totals aim at this many rows per bin
LEAST_BINS = 16         # a power of two
BIN_SAMPLE = 256        # sampled rows per bin that place the cuts


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in a total order.

    ``row_number() = 1`` is pruned by Spark before the exchange, so each task
    sends at most one row per key and a hot key costs no more than any other.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def duplicate_flags(df: DataFrame, keys: list[str], order: list[str], flag: str = "is_duplicate") -> DataFrame:
    """Mark every row after the first of its key. ``order`` must identify a row.

    The join uses key and order columns together, so rows of one key are spread.
    """
    first = first_per_key(df.select(*keys, *order), keys, [F.col(c) for c in order])
    both = [*keys, *order]
    marked = first.select(*[F.col(c).alias(f"_{c}") for c in both], F.lit(False).alias("_later"))
    same = [df[c].eqNullSafe(marked[f"_{c}"]) for c in both]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.join(marked, condition, "left").select(
        *df.columns, F.coalesce("_later", F.lit(True)).alias(flag))


def duplicate_count(df: DataFrame, keys: list[str], name: str = "n_duplicates") -> DataFrame:
    """How many rows repeat an earlier key."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def running_totals(df: DataFrame, groups: list[str], order: str, amounts: list[str]) -> DataFrame:
    """Exact running totals of ``amounts`` along ``order`` within groups such as splits or columns.

    Adds ``<amount>_before`` (sum over smaller values) and ``<amount>_total``.
    ``(groups, order)`` must be unique. The number line of each group is cut
    into bins at quantiles of a sample: where the cuts fall only balances the
    work, sums are exact. Rows and cuts are stored, as both passes must see the
    same ones. One bin of one group is the largest unit of a task.
    """
    df = durable(df.select(*groups, order, *amounts))
    n = max(df.count(), 1)
    bins = max(1 << math.ceil(math.log2(max(n / BIN_ROWS, 1))), LEAST_BINS)
    steps = [i / bins for i in range(1, bins)]
    cuts = df.sample(min(1.0, bins * BIN_SAMPLE / n), 42).groupBy(*groups).agg(
        F.array_distinct(F.percentile_approx(order, steps, max(10_000, 4 * bins))).alias("_cuts"))
    totals = df.groupBy(*groups).agg(*[F.sum(a).alias(f"{a}_total") for a in amounts])
    cuts = durable(totals.join(cuts, groups, "left"))
    below = F.coalesce(_cuts_below("_cuts", order, bins), F.lit(0))
    binned = df.join(cuts, groups).withColumn("_bin", below).drop("_cuts")

    sums = binned.groupBy(*groups, "_bin").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    over_bins = W.partitionBy(*groups).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*groups, "_bin", *[
        F.coalesce(F.sum(f"_{a}").over(over_bins), F.lit(0)).alias(f"_{a}_offset") for a in amounts])

    in_bin = (W.partitionBy(*groups, "_bin").orderBy(order)
              .rowsBetween(W.unboundedPreceding, -1))
    joined = binned.join(offsets, [*groups, "_bin"])
    running = [(F.col(f"_{a}_offset") + F.coalesce(F.sum(a).over(in_bin), F.lit(0))).alias(f"{a}_before")
               for a in amounts]
    return joined.select(*df.columns, *running, *[f"{a}_total" for a in amounts])


def _cuts_below(cuts: str, value: str, bins: int) -> Column:
    """How many of the sorted cuts are smaller than the value, by halving steps."""
    halves = F.array(*[F.lit(bins >> i) for i in range(1, bins.bit_length())])
    return F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(
        F.get(cuts, at + step - 1) < F.col(value), step).otherwise(0))
