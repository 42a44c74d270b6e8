"""Filters, exclusion rules, gates and column hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.functions.scalars import cosine, dot, has_word, set_tanimoto, to_number
from bindmill.operators import cascade, filters
from bindmill.queries.common import big, r6, table
from bindmill.schema import matching_columns, numeric_columns, require_columns

WORDS = ["ion", "metal", "the", "und", "que"]


def measure_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    kept = filters.measure_filter(lines, {"l_linestatus": "F", "l_returnflag": "R"}, positive="l_tax")
    return kept.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_partkey", "l_extendedprice")


def present_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("measure", F.nullif("l_discount", F.lit(0.0)))
    kept = filters.measure_filter(lines, {"l_linestatus": "F"}, present="measure")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("measure")).alias("total"))


def null_keeping_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    kept = filters.not_equal_or_missing(orders, "status", "F")
    return kept.groupBy(F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def same_origin(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    joined = (lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(customer, F.col("o_custkey") == F.col("c_custkey")))
    return filters.constant_shares(filters.same_value(joined, "c_nationkey", "s_nationkey"), "c_nationkey", 7)


def _part_ligands(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey", F.regexp_extract("p_name", r"^(\S+)", 1).alias("code"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") != 1, F.lower("p_type")).alias("kind"),
        F.when(~F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_brand")).alias("structure"),
        F.col("p_retailprice").alias("mw"), F.nullif("p_size", F.lit(13)).alias("rot_bonds"),
        F.length("p_name").alias("h_donors"), F.length("p_brand").alias("h_acceptors"))


def _part_rules() -> cascade.LigandRules:
    return cascade.LigandRules(
        code="code", name="name", kind="kind", structure="structure", codes=["old", "hot"],
        words=["ring", "large"], polymers=["promo"], linking="econ.*my|terminus| linking",
        limits={"mw": 1000, "rot_bonds": 25, "h_donors": 9, "h_acceptors": 7})


def exclusion_reasons(spark: SparkSession, folder: str) -> DataFrame:
    judged = cascade.exclusion_cascade(_part_ligands(spark, folder), _part_rules())
    return judged.select("p_partkey", F.coalesce("exclude_reason", F.lit("kept")).alias("outcome"))


def exclusion_outputs(spark: SparkSession, folder: str) -> DataFrame:
    judged = cascade.exclusion_cascade(_part_ligands(spark, folder), _part_rules())
    out = cascade.excluded(judged).groupBy(F.col("exclude_reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    kept = cascade.kept(judged).agg(F.lit("kept").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return out.unionByName(kept)


def criteria_failed(spark: SparkSession, folder: str) -> DataFrame:
    limits = {"mw": 1000, "rot_bonds": 25, "h_donors": 9, "h_acceptors": 7}
    failed = big(cascade.failed_criteria(limits)).alias("failed")
    return _part_ligands(spark, folder).select(failed).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


def drug_likeness(spark: SparkSession, folder: str) -> DataFrame:
    judged = cascade.rule_of_five(_part_ligands(spark, folder),
                                  {"mw": 1000, "rot_bonds": 25, "h_donors": 9, "h_acceptors": 7})
    return judged.select("p_partkey", big("violations").alias("violations"), big("drug_like").alias("drug_like"))


def forbidden_words(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return documents.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has_word("text", WORDS)).alias("n_with_word"))


def long_texts(spark: SparkSession, folder: str) -> DataFrame:
    return filters.long_enough(table(spark, folder, "conversations"), "text", 200).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"))


def gated_groups(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    kept = filters.group_gate(lines, "l_orderkey", F.col("l_quantity") >= 45)
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_extendedprice")).alias("total"))


def ratio_gated_groups(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    gated = filters.ratio_gate(lines, "l_orderkey", F.col("l_returnflag") == "R", F.col("l_returnflag") == "N", 0.5)
    return gated.withColumn("share", r6("share"))


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    return (table(spark, folder, "lineitem").withColumn("gappy", F.nullif("l_tax", F.lit(0.0)))
            .withColumn("constant", F.lit(7.5)))


def column_quality(spark: SparkSession, folder: str) -> DataFrame:
    return filters.column_quality(_wide(spark, folder)).withColumn("variance", r6("variance"))


def weak_columns_dropped(spark: SparkSession, folder: str) -> DataFrame:
    clean = filters.drop_weak_columns(_wide(spark, folder), ["l_returnflag", "l_linestatus", "not_there"])
    return clean.groupBy("l_returnflag", "l_linestatus").agg(
        *[r6(F.sum(F.col(c).cast("double"))).alias(f"sum_{c}") for c in numeric_columns(clean)])


def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _wide(spark, folder).withColumn("other", F.nullif("l_discount", F.lit(0.0)))
    both = filters.drop_null_rows(rows).agg(F.count(F.lit(1)).alias("n"))
    one = filters.drop_null_rows(rows, ["gappy"]).agg(F.count(F.lit(1)).alias("n"))
    return both.select(F.lit("any").alias("subset"), "n").unionByName(one.select(F.lit("gappy").alias("subset"), "n"))


def projected_columns(spark: SparkSession, folder: str) -> DataFrame:
    customer = require_columns(table(spark, folder, "customer"), ["c_custkey", "c_acctbal"])
    renamed = customer.withColumnsRenamed({"c_acctbal": "MolBalance", "c_mktsegment": "segment"})
    wanted = ["segment", "c_custkey", "not_there", *matching_columns(renamed, contains=("Mol", "TPSA"))]
    return filters.columns_first(filters.keep_columns(renamed, wanted), ["c_custkey"]).withColumnRenamed(
        "MolBalance", "mol_balance")


def dropped_columns(spark: SparkSession, folder: str) -> DataFrame:
    return filters.drop_columns(table(spark, folder, "supplier"), ["s_name", "s_acctbal", "not_there"])


def column_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Dot product, cosine and set similarity of two columns of each row."""
    part = table(spark, folder, "part")
    a, b = F.array("p_size", "p_retailprice"), F.array("p_retailprice", "p_partkey")
    names, kinds = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return part.select("p_partkey", F.round(dot(a, b), 2).alias("dot"),
                       F.round(cosine(a, b), 6).alias("cosine"),
                       F.round(set_tanimoto(names, kinds), 6).alias("tanimoto"))


def coerced_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of a text column that holds words, blanks, units, NaN and empty cells too."""
    key = F.col("p_partkey") % 7
    size = F.col("p_size").cast("string")
    text = (F.when(key == 0, F.col("p_name")).when(key == 1, F.concat(F.lit("  "), size, F.lit(" ")))
            .when(key == 2, F.concat(size, F.lit(" kg"))).when(key == 3, F.lit("")).when(key == 4, F.lit("NaN"))
            .when(key == 5, F.concat(F.lit("-"), size, F.lit("e1"))).otherwise(F.col("p_retailprice").cast("string")))
    parts = table(spark, folder, "part").select("p_partkey", text.alias("text"))
    return parts.select("p_partkey", to_number("text").alias("number"))


QUERIES = {
    "coerced_numbers": coerced_numbers,
    "measure_rows": measure_rows, "present_rows": present_rows, "null_keeping_rows": null_keeping_rows,
    "same_origin": same_origin, "exclusion_reasons": exclusion_reasons, "exclusion_outputs": exclusion_outputs,
    "criteria_failed": criteria_failed, "drug_likeness": drug_likeness, "forbidden_words": forbidden_words,
    "long_texts": long_texts, "gated_groups": gated_groups, "ratio_gated_groups": ratio_gated_groups,
    "column_quality": column_quality, "weak_columns_dropped": weak_columns_dropped,
    "complete_rows": complete_rows, "projected_columns": projected_columns,
    "dropped_columns": dropped_columns, "column_scores": column_scores,
}

_JUDGED = """
WITH l AS (
  SELECT p_partkey, split_part(p_name, ' ', 1) AS code, p_name AS name,
         CASE WHEN p_size <> 1 THEN lower(p_type) END AS kind,
         CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2') THEN p_brand END AS structure,
         CAST(p_retailprice > 1000 AS INT) + CAST(coalesce(nullif(p_size, 13) > 25, false) AS INT)
           + CAST(length(p_name) > 9 AS INT) + CAST(length(p_brand) > 7 AS INT) AS failed
  FROM part),
j AS (
  SELECT p_partkey, CASE
    WHEN code IN ('old', 'hot') THEN 'listed code' WHEN length(code) <> 3 THEN 'code length'
    WHEN kind IS NULL THEN 'not found'
    WHEN regexp_matches(name, '\\b(ring|large)\\b') OR regexp_matches(kind, '\\b(ring|large)\\b') THEN 'forbidden word'
    WHEN regexp_matches(kind, '\\bpromo\\b') THEN 'nucleic acid'
    WHEN regexp_matches(kind, 'econ.*my|terminus| linking') THEN 'linking type'
    WHEN structure IS NULL THEN 'no valid structure' WHEN failed >= 2 THEN 'failed criteria' ELSE 'kept' END AS outcome
  FROM l)"""

_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
_QUALITY = " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", count(*) FILTER ({value} IS NULL) AS n_null, count(*) AS n_rows, "
    f"round(var_samp({value}), 6) + 0.0 AS variance FROM lineitem"
    for name, value in [*[(c, c) for c in _NUMERIC], ("gappy", "nullif(l_tax, 0)"), ("constant", "7.5::DOUBLE")])

ORACLES = {
    "coerced_numbers": """
SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN p_size WHEN 5 THEN -10 * p_size WHEN 6 THEN p_retailprice END::DOUBLE AS number
FROM part""",
    "measure_rows": """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_extendedprice FROM lineitem
WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND l_tax > 0""",
    "present_rows": """
SELECT l_returnflag, count(*) AS n, round(sum(nullif(l_discount, 0)), 6) + 0.0 AS total FROM lineitem
WHERE l_linestatus = 'F' AND nullif(l_discount, 0) IS NOT NULL GROUP BY l_returnflag""",
    "null_keeping_rows": """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE o_orderstatus END AS status, count(*) AS n
FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""",
    "same_origin": """
SELECT count(*) FILTER (c_nationkey = 7) AS n_kept, count(*) FILTER (c_nationkey <> 7) AS n_other, count(*) AS n_total
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = s_nationkey""",
    "exclusion_reasons": _JUDGED + " SELECT p_partkey, outcome FROM j",
    "exclusion_outputs": _JUDGED + " SELECT outcome, count(*) AS n FROM j GROUP BY outcome",
    "criteria_failed": _JUDGED + " SELECT CAST(failed AS BIGINT) AS failed, count(*) AS n FROM l GROUP BY 1",
    "drug_likeness": """
SELECT p_partkey, CAST(v AS BIGINT) AS violations, CAST(v <= 1 AS BIGINT) AS drug_like FROM (
  SELECT p_partkey, CAST(NOT p_retailprice <= 1000 AS INT) + CAST(NOT coalesce(nullif(p_size, 13) <= 25, false) AS INT)
    + CAST(NOT length(p_name) <= 9 AS INT) + CAST(NOT length(p_brand) <= 7 AS INT) AS v FROM part)""",
    "forbidden_words": """
SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(lower(text),
  '(^|[^\\p{L}\\p{N}_])(ion|metal|the|und|que)($|[^\\p{L}\\p{N}_])')) AS n_with_word
FROM documents GROUP BY lang""",
    "long_texts": "SELECT role, count(*) AS n FROM conversations WHERE length(text) >= 200 GROUP BY role",
    "gated_groups": """
SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 6) + 0.0 AS total FROM lineitem
GROUP BY l_orderkey HAVING max(l_quantity) < 45""",
    "ratio_gated_groups": """
SELECT l_orderkey, n_doubtful, n_valid, round(n_doubtful / greatest(n_valid, 1), 6) + 0.0 AS share FROM (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_doubtful,
         count(*) FILTER (l_returnflag = 'N') AS n_valid FROM lineitem GROUP BY l_orderkey)
WHERE n_doubtful / greatest(n_valid, 1) > 0.5""",
    "column_quality": _QUALITY,
    "weak_columns_dropped": "SELECT l_returnflag, l_linestatus, " + ", ".join(
        f"round(sum({c}::DOUBLE), 6) + 0.0 AS sum_{c}" for c in _NUMERIC) + " FROM lineitem GROUP BY ALL",
    "complete_rows": """
SELECT 'any' AS subset, count(*) AS n FROM lineitem WHERE l_tax <> 0 AND l_discount <> 0
UNION ALL SELECT 'gappy', count(*) FROM lineitem WHERE l_tax <> 0""",
    "projected_columns": "SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS mol_balance FROM customer",
    "dropped_columns": "SELECT s_suppkey, s_nationkey FROM supplier",
    "column_scores": """
WITH v AS (
  SELECT p_partkey, [p_size, p_retailprice]::DOUBLE[] AS a, [p_retailprice, p_partkey]::DOUBLE[] AS b,
         string_split(lower(p_name), ' ') AS n, string_split(lower(p_type), ' ') AS k FROM part)
SELECT p_partkey, round(list_dot_product(a, b), 2) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine,
       round(len(list_intersect(list_distinct(n), list_distinct(k))) / len(list_distinct(list_concat(n, k))), 6)
         AS tanimoto
FROM v""",
}
