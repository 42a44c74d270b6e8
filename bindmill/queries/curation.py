"""Label curation on lineitem: molecule = part, sequence = supplier, entry = order, chain = line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.functions.scalars import binary_label, coverage, p_activity, to_number
from bindmill.operators.curation import CurationRoles, curate, curation_report
from bindmill.operators.filters import measure_filter
from bindmill.queries.common import big, r6, table

ROLES = CurationRoles(molecule="molecule", sequence="sequence", measure="measure", entry="entry", chain="chain",
                      coverage="coverage", resolution="resolution", accession="accession",
                      ties=["entry", "chain", "measure"])


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_partkey").alias("molecule"), F.col("l_suppkey").alias("sequence"),
        F.pmod("l_suppkey", F.lit(50)).alias("accession"),
        F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("chain"),
        coverage("l_linenumber", F.col("l_linenumber") + F.col("l_quantity"), F.lit(1), "p_size").alias("coverage"),
        to_number(F.col("l_tax").cast("string")).alias("resolution"),
        F.col("l_extendedprice").alias("standard_value"), F.col("l_quantity").alias("pchembl_value"),
        F.col("l_linestatus").alias("assay_type"))


def ki_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = measure_filter(measurements(spark, folder), {"assay_type": "O"}, positive="standard_value")
    return rows.withColumn("measure", p_activity("standard_value"))


def ki_labels(spark: SparkSession, folder: str) -> DataFrame:
    return curate(ki_rows(spark, folder), ROLES, chain_dedup=False)


def pchembl_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = measure_filter(measurements(spark, folder), {"assay_type": "O"}, present="pchembl_value")
    return curate(rows.withColumnRenamed("pchembl_value", "measure"), ROLES, chain_dedup=True)


def _shown(labels: DataFrame) -> DataFrame:
    return labels.select("molecule", "sequence", "accession", "entry", big("chain").alias("chain"),
                         r6("measure").alias("measure"), r6("coverage").alias("coverage"),
                         "resolution", r6("z").alias("z"), "z_reason")


def curate_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(ki_labels(spark, folder))


def curate_labels_chain(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(pchembl_labels(spark, folder))


def curation_counters(spark: SparkSession, folder: str) -> DataFrame:
    return curation_report(ki_labels(spark, folder), ROLES)


def reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    labels = pchembl_labels(spark, folder)
    return labels.groupBy("z_reason").agg(
        F.count(F.lit(1)).alias("n"),
        big(F.sum(binary_label("measure", 25.0))).alias("n_active_inclusive"),
        big(F.sum(binary_label("measure", 25.0, inclusive=False))).alias("n_active_strict"))


QUERIES = {
    "curate_labels": curate_labels,
    "curate_labels_chain": curate_labels_chain,
    "curation_counters": curation_counters,
    "reason_counts": reason_counts,
}

_ROWS = """
m AS (
  SELECT l_partkey AS molecule, l_suppkey AS sequence, l_suppkey % 50 AS accession, l_orderkey AS entry,
         l_linenumber AS chain, {measure} AS measure, (l_quantity + 1) / p_size AS coverage, l_tax AS resolution
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_linestatus = 'O' AND l_extendedprice > 0)"""

_RESOLVE = """
r AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY molecule, measure, sequence ORDER BY {order}) AS rn
                 FROM {source}) WHERE rn = 1),
g AS (
  SELECT *, avg(measure) OVER w AS mu, stddev_pop(measure) OVER w AS sd,
         min(measure) OVER w < max(measure) OVER w AS differs
  FROM r WINDOW w AS (PARTITION BY molecule, sequence)),
z AS (
  SELECT *, CASE WHEN differs AND sd > 0 THEN (measure - mu) / sd END AS z,
         CASE WHEN differs AND sd > 0 THEN round(abs(measure - mu), 9) ELSE 0 END AS distance
  FROM g),
labels AS (
  SELECT *, CASE WHEN z IS NULL THEN 'identical_or_single_value' WHEN abs(z) <= 1 + 1e-9 THEN 'within_range'
                 ELSE 'outlier_kept' END AS z_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY molecule, sequence ORDER BY distance, {order}) AS pick FROM z)
  WHERE pick = 1)"""

_BEST = "coverage DESC NULLS LAST, resolution ASC NULLS LAST, entry, chain, measure"

KI_LABELS = "WITH" + _ROWS.format(measure="-log10(l_extendedprice * 1e-9)") + "," + _RESOLVE.format(
    order="accession, " + _BEST, source="m")

PCHEMBL_LABELS = "WITH" + _ROWS.format(measure="l_quantity") + """,
c AS (
  SELECT * EXCLUDE (cn) FROM (SELECT *, row_number() OVER (PARTITION BY sequence, entry, chain ORDER BY """ + _BEST + """) AS cn
  FROM m) WHERE cn = 1),""" + _RESOLVE.format(order="entry, chain, " + _BEST, source="c")

_SHOWN = """
SELECT molecule, sequence, accession, entry, CAST(chain AS BIGINT) AS chain, round(measure, 6) + 0.0 AS measure,
       round(coverage, 6) + 0.0 AS coverage, resolution, round(z, 6) + 0.0 AS z, z_reason
FROM labels"""

ORACLES = {
    "curate_labels": KI_LABELS + _SHOWN,
    "curate_labels_chain": PCHEMBL_LABELS + _SHOWN,
    "curation_counters": KI_LABELS + """
SELECT 'repeated_variants' AS "check", count(*) AS n_groups FROM (
  SELECT 1 FROM labels GROUP BY accession, molecule, sequence, entry, chain HAVING count(*) > 1)
UNION ALL SELECT 'repeated_interactions', count(*) FROM (
  SELECT 1 FROM labels GROUP BY molecule, sequence HAVING count(*) > 1)
UNION ALL SELECT 'several_sequences', count(*) FROM (
  SELECT 1 FROM labels GROUP BY accession, molecule HAVING count(DISTINCT sequence) > 1)""",
    "reason_counts": PCHEMBL_LABELS + """
SELECT z_reason, count(*) AS n, CAST(count(*) FILTER (measure >= 25) AS BIGINT) AS n_active_inclusive,
       CAST(count(*) FILTER (measure > 25) AS BIGINT) AS n_active_strict
FROM labels GROUP BY z_reason""",
}
