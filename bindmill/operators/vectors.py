"""Statistics of embedding vectors: per dimension, per norm, per group; PCA."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from bindmill.functions.scalars import l2_norm
from bindmill.operators import moments

NEAR_CONSTANT = 0.01
SHARE_SLACK = 1e-12  # sums of shares round


def dimension_stats(df: DataFrame, vector: str) -> DataFrame:
    """Mean, sample deviation and variance of every dimension, from one pass; null and NaN elements are left out."""
    sums = moments.pair_sums(df, vector, "self").select(
        F.col("i").alias("dim"), moments.mean().alias("mean"), moments.variance(sample=True).alias("variance"))
    return sums.select("dim", "mean", F.sqrt("variance").alias("std"), "variance")


def vector_hygiene(df: DataFrame, blocks: list[str]) -> DataFrame:
    """(block, dim, n_missing, variance) of every position of some vector columns, from one pass over each.

    A position is missing in a row if the vector is null or too short, or if the element is null or NaN. The variance
    is that of a population. A block without any vector has no positions.
    """
    n_rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = [moments.pair_sums(df, b, "self").select(
        F.lit(b).alias("block"), F.col("i").alias("dim"), (n_rows - F.col("n")).alias("n_missing"),
        moments.variance(sample=False).alias("variance")) for b in blocks]
    return reduce(DataFrame.unionByName, parts)


def near_constant_dimensions(df: DataFrame, vector: str, limit: float = NEAR_CONSTANT) -> DataFrame:
    return dimension_stats(df, vector).agg(F.count_if(F.col("std") < limit).alias("n_near_constant"))


def top_variance(df: DataFrame, vector: str, k: int = 50) -> DataFrame:
    return dimension_stats(df, vector).orderBy(F.desc("variance"), "dim").limit(k).select("dim", "variance")


def norm_stats(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation of the vector lengths."""
    norms = df.filter(F.col(vector).isNotNull()).select(l2_norm(vector).alias("norm"))
    return norms.agg(F.count(F.lit(1)).alias("n"), F.avg("norm").alias("mean_norm"), F.stddev_pop("norm").alias("std_norm"))


def norm_by_group(df: DataFrame, group: str, vector: str) -> DataFrame:
    present = df.filter(F.col(vector).isNotNull() & F.col(group).isNotNull())
    return present.groupBy(group).agg(F.avg(l2_norm(vector)).alias("mean_norm"))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, added up by the tasks that read the rows."""
    return moments.segment_means(df, group, vector)


def dimension_correlations(df: DataFrame, vector: str, target: str) -> DataFrame:
    """(dim, r): correlation of every dimension with a target column, over the rows that have both."""
    both = df.filter(F.col(target).isNotNull() & F.col(vector).isNotNull()).select(F.concat(
        F.array(F.col(target).cast("double")), F.col(vector).cast("array<double>")).alias("v"))
    return moments.pair_sums(both, "v", "first").where("i > 0").select(
        (F.col("i") - 1).alias("dim"), moments.correlation().alias("r"))


def correlation_summary(correlations: DataFrame, limits: tuple[float, ...] = (0.1, 0.2)) -> DataFrame:
    size = F.abs("r")
    return correlations.agg(F.max(size).alias("max_abs_r"), *[
        F.count_if(size > limit).alias(f"n_above_{int(round(limit * 100)):02d}") for limit in limits])


def top_correlations(correlations: DataFrame, k: int = 20) -> DataFrame:
    return correlations.orderBy(F.desc(F.abs("r")), "dim").limit(k)


def centred(df: DataFrame, vector: str, name: str = "centred") -> DataFrame:
    """Vectors minus the overall mean vector, as ML vectors."""
    entries = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    mean = dimension_stats(df, vector).agg(F.transform(entries, lambda e: e["mean"]).alias("m")).scalar()
    moved = F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)
    rows = df.filter(F.col(vector).isNotNull()).withColumn("_mean", mean)
    return rows.withColumn(name, array_to_vector(moved)).drop("_mean")


def fit_pca(df: DataFrame, vector: str, k: int) -> tuple[DataFrame, PCAModel]:
    rows = centred(df, vector)
    return rows, PCA(k=k, inputCol="centred", outputCol="components").fit(rows)


def pca_scores(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Projection on the first principal components; component signs are arbitrary."""
    rows, model = fit_pca(df, vector, k)
    scores = model.transform(rows).withColumn("components", vector_to_array("components"))
    parts = [F.get("components", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)]
    return scores.select(*[c for c in df.columns if c != vector], *parts)


def explained_variance(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Variance share of each component and its running sum (``k`` rows)."""
    _, model = fit_pca(df, vector, k)
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return running_share(df.sparkSession.createDataFrame(shares, "pc int, share double"))


def running_share(shares: DataFrame) -> DataFrame:
    """Adds the running sum of a short table of numbered shares."""
    upto = W.orderBy("pc").rowsBetween(W.unboundedPreceding, W.currentRow)
    return shares.withColumn("cumulative", F.sum("share").over(upto))


def components_needed(variance: DataFrame, k: int, targets: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """First component whose running share reaches each target; ``k + 1`` if none does."""
    picks = [F.struct(F.lit(t).alias("target"), F.coalesce(
        F.min(F.when(F.col("cumulative") >= t - SHARE_SLACK, F.col("pc"))), F.lit(k + 1)).alias("n_components")) for t in targets]
    return variance.agg(F.array(*picks).alias("p")).select(F.inline("p"))
