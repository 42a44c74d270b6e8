"""Column profiles: counts, moments, exact quantiles, histograms, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindmill.operators import moments
from bindmill.operators.grouping import running_totals

QUARTILES = [0.25, 0.5, 0.75]
IQR_FACTOR = 1.5


def melt(df: DataFrame, columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """One (column name, double value) row per cell."""
    cells = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """Linearly interpolated quantiles per group, columns ``q<share>``.

    Equal values are counted first; the two neighbouring order statistics are
    then read off exact running counts, so no task sees a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_w"))
    ranked = running_totals(counts, groups, value, ["_w"])
    first, last = F.col("_w_before"), F.col("_w_before") + F.col("_w")

    def place(share: float) -> Column:
        return F.lit(share) * (F.col("_w_total") - 1)

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < last), F.col(value)))

    picks = []
    for i, share in enumerate(shares):
        picks += [at(F.floor(place(share))).alias(f"_low{i}"), at(F.ceil(place(share))).alias(f"_high{i}")]
    picked = ranked.groupBy(*groups).agg(F.max("_w_total").alias("_w_total"), *picks)
    values = []
    for i, share in enumerate(shares):
        part = place(share) - F.floor(place(share))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        values.append((low + (high - low) * part).alias(quantile_name(share)))
    return picked.select(*groups, *values)


def quantile_name(share: float) -> str:
    return "q" + f"{share * 100:g}".replace(".", "_")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column."""
    long = melt(df, columns)
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(long, ["column"], "value", QUARTILES)
    return moments.join(quartiles, "column", "left")


def null_shares(df: DataFrame, columns: list[str] | None = None, top: int = 30) -> DataFrame:
    """Columns with the largest share of missing values, from one pass."""
    names = columns or df.columns
    shares = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_share"))
              for c in names]
    long = df.agg(F.array(*shares).alias("s")).select(F.inline("s"))
    return long.orderBy(F.desc("null_share"), "column").limit(top)


def iqr_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row with the fences 1.5 interquartile ranges outside the quartiles."""
    q = exact_quantiles(melt(df, [column]), ["column"], "value", [0.25, 0.75])
    spread = IQR_FACTOR * (F.col("q75") - F.col("q25"))
    return q.select((F.col("q25") - spread).alias("low"), (F.col("q75") + spread).alias("high"))


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the fences; the fences are read first, so that the filter is pushed to the scan."""
    for bounds in iqr_bounds(df, column).take(1):
        return df.filter((F.col(column) < bounds["low"]) | (F.col(column) > bounds["high"]))
    return df.limit(0)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from the smallest to the largest value; the last bin is closed."""
    limits = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = (F.lit(limits[c]).cast("double") for c in ("low", "high"))
    width = (high - low) / F.lit(bins)
    at = F.coalesce(F.floor(F.try_divide(F.col(column) - low, width)), F.lit(0))
    placed = df.filter(F.col(column).isNotNull()).select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (low + F.col("bin") * width).alias("left_edge"), "n")


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair in one pass; a pair uses the rows where both are present."""
    names = F.array(*map(F.lit, columns))
    pairs = moments.pair_sums(moments.as_vector(df, columns), "v").where("i < j")
    return pairs.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), moments.correlation().alias("r"))


def share_true(df: DataFrame, flag: Column) -> DataFrame:
    return df.agg(F.count_if(flag).alias("n_true"), F.avg(flag.cast("double")).alias("share_true"),
                  F.count(F.lit(1)).alias("n_total"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of the rows per value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n").alias("n")).scalar())


def distinct_share(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(column).alias("n_distinct")).withColumn(
        "share_distinct", F.try_divide(F.col("n_distinct"), F.col("n_rows")))


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """mean, sample deviation and count per group."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def group_spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """Entries, mean and deviation of the groups that have a deviation."""
    stats = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_entries"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return stats.na.drop()


def repeated_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    sizes = df.na.drop(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") > 1)


def groups_with_variation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups with more than one distinct value."""
    counts = df.na.drop(subset=keys).groupBy(*keys).agg(F.countDistinct(value).alias("n_values"))
    return counts.filter(F.col("n_values") > 1)
