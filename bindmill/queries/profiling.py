"""Counts, moments, quantiles, histograms and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.functions.scalars import coverage
from bindmill.operators import profiling
from bindmill.queries.common import big, r6, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def repeated_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.repeated_groups(table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"])


def varied_parts(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.groups_with_variation(table(spark, folder, "lineitem"), ["l_partkey", "l_returnflag"], "l_suppkey")


def part_share(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profiling.distinct_share(table(spark, folder, "lineitem"), "l_partkey"), "share_distinct")


def supplier_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profiling.group_stats(table(spark, folder, "lineitem"), "l_suppkey", "l_extendedprice"), "mean", "std")


def order_spread(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profiling.group_spread(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity"), "mean", "std")


def null_shares(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.nullif("l_discount", F.lit(0.1)).alias("discount"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return _rounded(profiling.null_shares(lines), "null_share")


def describe_lines(spark: SparkSession, folder: str) -> DataFrame:
    stats = profiling.describe(table(spark, folder, "lineitem"), NUMERIC)
    return _rounded(stats, "mean", "std", "min", "max", "q25", "q50", "q75")


def event_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.iqr_outliers(table(spark, folder, "events"), "value").select("event_id", "value")


def price_outliers(spark: SparkSession, folder: str) -> DataFrame:
    outliers = profiling.iqr_outliers(table(spark, folder, "lineitem"), "l_extendedprice")
    return outliers.agg(F.count(F.lit(1)).alias("n"), r6(F.min("l_extendedprice")).alias("smallest"))


def value_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = profiling.histogram(table(spark, folder, "events"), "value", 50)
    return bins.select(big("bin").alias("bin"), r6("left_edge").alias("left_edge"), "n")


def coverage_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage without the end position counted, as in the coverage profile."""
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part").select("p_partkey", "p_size")
    share = coverage("l_linenumber", F.col("l_linenumber") + F.col("l_quantity"), F.lit(1), "p_size", inclusive=False)
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(share.alias("coverage"))
    return profiling.histogram(rows, "coverage", 50).select(big("bin").alias("bin"), "n")


def correlations(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profiling.correlation_pairs(table(spark, folder, "lineitem"), NUMERIC), "r")


def taxed_share(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profiling.share_true(table(spark, folder, "lineitem"), F.col("l_tax") > 0.02), "share_true")


QUERIES = {f.__name__: f for f in (
    repeated_pairs, varied_parts, part_share, supplier_stats, order_spread, null_shares, describe_lines,
    event_outliers, price_outliers, value_histogram, coverage_histogram, correlations, taxed_share)}

_DESCRIBE = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS std,
  round(min({c}), 6) + 0.0 AS min, round(max({c}), 6) + 0.0 AS max, round(quantile_cont({c}, 0.25), 6) + 0.0 AS q25,
  round(quantile_cont({c}, 0.5), 6) + 0.0 AS q50, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q75 FROM lineitem"""
                               for c in NUMERIC)
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:])
_NULLS = " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", round(avg(CAST({test} AS DOUBLE)), 6) + 0.0 AS null_share FROM lineitem"
    for name, test in (("l_orderkey", "l_orderkey IS NULL"), ("tax", "l_tax = 0"), ("discount", "l_discount = 0.1::DOUBLE"),
                       ("flag", "l_returnflag = 'N'")))


def _fences(value: str, source: str) -> str:
    return f"""
WITH q AS (SELECT quantile_cont({value}, 0.25) AS a, quantile_cont({value}, 0.75) AS b FROM {source}),
o AS (SELECT * FROM {source}, q WHERE {value} < a - 1.5 * (b - a) OR {value} > b + 1.5 * (b - a))"""


ORACLES = {
    "repeated_pairs": """
SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1""",
    "varied_parts": """
SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY ALL
HAVING count(DISTINCT l_suppkey) > 1""",
    "part_share": """
SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_distinct,
       round(count(DISTINCT l_partkey) / count(*), 6) + 0.0 AS share_distinct FROM lineitem""",
    "supplier_stats": """
SELECT l_suppkey, round(avg(l_extendedprice), 6) + 0.0 AS mean, round(stddev_samp(l_extendedprice), 6) + 0.0 AS std,
       count(*) AS count FROM lineitem GROUP BY l_suppkey""",
    "order_spread": """
SELECT l_orderkey, count(*) AS n_entries, round(avg(l_quantity), 6) + 0.0 AS mean,
       round(stddev_samp(l_quantity), 6) + 0.0 AS std FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
    "null_shares": _NULLS,
    "describe_lines": _DESCRIBE,
    "event_outliers": _fences("value", "events") + " SELECT event_id, value FROM o",
    "price_outliers": _fences("l_extendedprice", "lineitem") + """
SELECT count(*) AS n, round(min(l_extendedprice), 6) + 0.0 AS smallest FROM o""",
    "value_histogram": """
WITH r AS (SELECT min(value) AS low, (max(value) - min(value)) / 50 AS width FROM events)
SELECT CAST(least(floor((value - low) / width), 49) AS BIGINT) AS bin,
       round(any_value(low) + CAST(least(floor((value - low) / width), 49) AS BIGINT) * any_value(width), 6) + 0.0 AS left_edge,
       count(*) AS n FROM events, r GROUP BY least(floor((value - low) / width), 49)""",
    "coverage_histogram": """
WITH c AS (SELECT l_quantity / (p_size - 1) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <> 1),
r AS (SELECT min(v) AS low, (max(v) - min(v)) / 50 AS width FROM c)
SELECT CAST(least(floor((v - low) / width), 49) AS BIGINT) AS bin, count(*) AS n FROM c, r GROUP BY 1""",
    "correlations": _CORR,
    "taxed_share": """
SELECT count(*) FILTER (l_tax > 0.02::DOUBLE) AS n_true, round(avg(CAST(l_tax > 0.02::DOUBLE AS DOUBLE)), 6) + 0.0 AS share_true,
       count(*) AS n_total FROM lineitem""",
}
