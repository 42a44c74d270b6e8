"""Classifier metrics on labelled documents: truth = quality, score from text length, split = language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.operators import metrics
from bindmill.queries.common import big, r6, table


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    share = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    return documents.join(labels, "doc_id").withColumn("score", F.floor(share * 100) / 100.0)


def split_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scores = metrics.evaluate(_scored(spark, folder), "lang", "quality", "score")
    return scores.withColumns({c: r6(c) for c in ("accuracy", "recall", "precision", "f1", "mcc", "auc")})


def tied_auc(spark: SparkSession, folder: str) -> DataFrame:
    """All orders as one split; the score is the rounded price, so ties are heavy."""
    orders = table(spark, folder, "orders").select(
        F.lit("all").alias("split"), (F.col("o_orderpriority") < "3").cast("int").alias("label"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"))
    return metrics.roc_auc(orders, "split", "label", "score").withColumn("auc", r6("auc"))


def line_auc(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("split"), (F.col("l_quantity") > 25).cast("int").alias("label"),
        F.col("l_extendedprice").alias("score"))
    return metrics.roc_auc(lines, "split", "label", "score").withColumn("auc", r6("auc"))


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    scored = metrics.predict(_scored(spark, folder), "score")
    report = metrics.class_report(scored, "lang", "quality", "predicted_label")
    return report.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


def well_predicted(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.well_predicted(_scored(spark, folder), "quality", "score", ["doc_id", "lang"])
    return rows.withColumns({"true_label": big("true_label"), "predicted_label": big("predicted_label")})


QUERIES = {f.__name__: f for f in (split_metrics, tied_auc, line_auc, class_report, well_predicted)}

_SCORED = """
WITH d AS (
  SELECT doc_id, lang, quality, floor(n_chars / (n_chars + 2000.0::DOUBLE) * 100) / 100.0::DOUBLE AS score
  FROM documents JOIN labels USING (doc_id)),
c AS (
  SELECT lang, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp,
         count(*) FILTER (quality = 0 AND score < 0.5) AS tn, count(*) FILTER (quality = 1 AND score < 0.5) AS fn
  FROM d GROUP BY lang)"""


def _auc(source: str, split: str, label: str) -> str:
    return f"""(
  SELECT {split} AS split, CASE WHEN p > 0 AND p < n THEN (ranks - p * (p + 1) / 2) / (p * (n - p)) END AS auc FROM (
    SELECT {split}, CAST(sum({label}) AS DOUBLE) AS p, count(*) AS n, sum(rank * {label}) AS ranks FROM (
      SELECT {split}, {label}, rank() OVER (PARTITION BY {split} ORDER BY score)
        + (count(*) OVER (PARTITION BY {split}, score) - 1) / 2 AS rank FROM {source}) GROUP BY {split}))"""


def _ratio(a: str, b: str) -> str:
    return f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 6) + 0.0"


def _report_row(name: str, precision: str, recall: str, f1: str, support: str) -> str:
    return (f"SELECT lang, '{name}' AS class, round({precision}, 6) + 0.0 AS precision, round({recall}, 6) + 0.0 AS recall, "
            f"round({f1}, 6) + 0.0 AS f1, {support} AS support FROM k")


ORACLES = {
    "split_metrics": _SCORED + f"""
SELECT c.lang, tp, fp, tn, fn, {_ratio("tp + tn", "tp + fp + tn + fn")} AS accuracy, {_ratio("tp", "tp + fn")} AS recall,
  {_ratio("tp", "tp + fp")} AS precision, {_ratio("2 * tp", "2 * tp + fp + fn")} AS f1,
  {_ratio("tp * tn - fp * fn", "sqrt(((tp + fp) * (tp + fn))::DOUBLE * ((tn + fp) * (tn + fn)))")} AS mcc,
  round(auc, 6) + 0.0 AS auc
FROM c JOIN {_auc("d", "lang", "quality")} a ON a.split = c.lang""",
    "tied_auc": f"""
WITH o AS (SELECT 'all' AS split, CAST(o_orderpriority < '3' AS INT) AS label, floor(o_totalprice / 1000) AS score FROM orders)
SELECT split, round(auc, 6) + 0.0 AS auc FROM {_auc("o", "split", "label")}""",
    "line_auc": f"""
WITH o AS (SELECT l_returnflag AS split, CAST(l_quantity > 25 AS INT) AS label, l_extendedprice AS score FROM lineitem)
SELECT split, round(auc, 6) + 0.0 AS auc FROM {_auc("o", "split", "label")}""",
    "class_report": _SCORED + """,
k AS (
  SELECT *, tn + fp AS s0, tp + fn AS s1, tp + fp + tn + fn AS s, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS acc,
    coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS p0, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS r0,
    coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)::DOUBLE AS f0,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p1, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r1,
    coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1 FROM c) """ + " UNION ALL ".join([
        _report_row("0", "p0", "r0", "f0", "s0"), _report_row("1", "p1", "r1", "k.f1", "s1"),
        _report_row("accuracy", "acc", "acc", "acc", "s"),
        _report_row("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + k.f1) / 2", "s"),
        _report_row("weighted avg", "(p0 * s0 + p1 * s1) / s", "(r0 * s0 + r1 * s1) / s", "(f0 * s0 + k.f1 * s1) / s", "s")]),
    "well_predicted": _SCORED + """
SELECT doc_id, lang, CAST(quality AS BIGINT) AS true_label, score AS predicted_proba,
       CAST(score >= 0.5 AS BIGINT) AS predicted_label
FROM d WHERE CAST(score >= 0.5 AS INT) = quality""",
}
