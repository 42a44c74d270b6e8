"""Seeded samples, blind partitions, overlap reports and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.functions.scalars import composite_key, vector_columns
from bindmill.operators import dedup, sampling, scaling, splitting
from bindmill.queries.common import r6, table
from bindmill.queries.curation import KI_LABELS, ki_labels
from bindmill.session import durable

BLIND = ["blind", "blind_protein", "blind_ligand"]
BASE = ["train", "val", "test"]


def _split_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = durable(ki_labels(spark, folder))
    return splitting.six_way_split(labels, "molecule", "sequence", key=["molecule", "sequence"])


def sampled_parts(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sampled_keys(table(spark, folder, "lineitem"), "l_partkey", splitting.BLIND_SHARE, 42)


def sampled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_sample(table(spark, folder, "documents"), "doc_id", 100).select("doc_id", "lang", "n_chars")


def blind_classes(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return splitting.blind_classes(lines, "l_partkey", "l_suppkey")


def six_way_split(spark: SparkSession, folder: str) -> DataFrame:
    return _split_labels(spark, folder).select("molecule", "sequence", "split")


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_sizes(_split_labels(spark, folder))


def overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    axes = {"pair": composite_key("entry", "chain", "sequence", "molecule"), "ligand": F.col("molecule"),
            "protein": F.col("sequence")}
    return splitting.overlap_report(_split_labels(spark, folder), axes, "split", BASE, BLIND)


def leakage_simulation(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    axes = {"ligand": F.col("o_custkey"), "protein": F.col("o_orderpriority"),
            "pair": composite_key("o_orderpriority", "o_custkey")}
    return splitting.leakage_simulation(orders, ["o_orderkey"], axes)


def scaled_parts(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7.0).alias("constant"))
    rows = scaling.assemble(splitting.random_parts(part, ["p_partkey"]), ["p_size", "p_retailprice", "constant"])
    scaled = scaling.scale_on_train(rows)
    return scaled.select("p_partkey", "split", *[r6(c).alias(f"x{i + 1}") for i, c in enumerate(
        vector_columns("features", "x", 3))])


QUERIES = {f.__name__: f for f in (
    sampled_parts, sampled_documents, blind_classes, six_way_split, split_sizes, overlap_report,
    leakage_simulation, scaled_parts)}


def _token(key: str) -> str:
    return f"md5('42|' || {key}) || ':' || {key}"


def _sampled(source: str, column: str) -> str:
    return f"""(SELECT {column} FROM (SELECT {column}, row_number() OVER (ORDER BY {_token(column)}) AS rk, count(*) OVER () AS n
     FROM (SELECT DISTINCT {column} FROM {source})) WHERE rk <= floor(0.15::DOUBLE * n))"""


def _classes(source: str, ligand: str, protein: str) -> str:
    return f"""
SELECT *, CASE WHEN li AND pi THEN 'blind' WHEN pi THEN 'blind_protein' WHEN li THEN 'blind_ligand' ELSE 'rest' END AS class
FROM (SELECT *, {ligand} IN {_sampled(source, ligand)} AS li, {protein} IN {_sampled(source, protein)} AS pi FROM {source})"""


def _parts(source: str, key: str, test: str, validation: str) -> str:
    return f"""
SELECT *, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + ceil({validation}::DOUBLE * (n - n_test)) THEN 'val'
  ELSE 'train' END AS split FROM (SELECT *, ceil({test}::DOUBLE * n) AS n_test FROM (
    SELECT *, row_number() OVER (ORDER BY {_token(key)}) AS rk, count(*) OVER () AS n FROM {source}))"""


_SIX = KI_LABELS + f""",
c AS ({_classes("labels", "molecule", "sequence")}),
rest AS (SELECT * FROM c WHERE class = 'rest'),
s AS (SELECT entry, chain, molecule, sequence, split FROM ({_parts("rest", "(molecule || '|' || sequence)", "0.10", "0.1111")})
  UNION ALL SELECT entry, chain, molecule, sequence, class FROM c WHERE class <> 'rest')"""

_OVERLAP = " UNION ALL ".join(f"""
SELECT '{axis}' AS axis, '{split}' AS split, count(DISTINCT {key}) AS n_shared FROM s WHERE split = '{split}'
AND {key} IN (SELECT {key} FROM s WHERE split IN ('train', 'val', 'test'))"""
                              for axis, key in (("pair", "(entry || '|' || chain || '|' || sequence || '|' || molecule)"),
                                                ("ligand", "molecule"), ("protein", "sequence")) for split in BLIND)

_LEAK = f"WITH s AS ({_parts('orders', 'o_orderkey', '0.2', '0.0')})" + " UNION ALL ".join(f"""
SELECT '{axis}' AS axis, count(DISTINCT {key}) AS n_overlap FROM s WHERE split = 'test'
AND {key} IN (SELECT {key} FROM s WHERE split = 'train')"""
                                for axis, key in (("ligand", "o_custkey"), ("protein", "o_orderpriority"),
                                                  ("pair", "(o_orderpriority || '|' || o_custkey)")))

ORACLES = {
    "sampled_parts": f"SELECT l_partkey FROM {_sampled('lineitem', 'l_partkey')}",
    "sampled_documents": "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100",
    "blind_classes": f"""
WITH d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT l_partkey, l_suppkey, class AS split FROM ({_classes("d", "l_partkey", "l_suppkey")})""",
    "six_way_split": _SIX + " SELECT molecule, sequence, split FROM s",
    "split_sizes": _SIX + " SELECT split, count(*) AS n_rows FROM s GROUP BY split",
    "overlap_report": _SIX + _OVERLAP,
    "leakage_simulation": _LEAK,
    "scaled_parts": f"""
WITH s AS ({_parts("part", "p_partkey", "0.10", "0.1111")}),
f AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2
      FROM s WHERE split = 'train')
SELECT p_partkey, split, round((p_size - m1) / s1, 6) + 0.0 AS x1, round((p_retailprice - m2) / s2, 6) + 0.0 AS x2,
       0.0::DOUBLE AS x3 FROM s, f""",
}
