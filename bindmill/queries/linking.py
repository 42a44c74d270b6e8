"""Joins, look-ups, set comparison, deduplication and top-k on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.functions.scalars import composite_key
from bindmill.operators import dedup, linking
from bindmill.operators.grouping import duplicate_count, duplicate_flags
from bindmill.plans import flows
from bindmill.queries.common import big, r6, table


def link_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Union of two mapping sources, then an inner join on a composite key."""
    lines = table(spark, folder, "lineitem")
    mapping = ["l_orderkey", "l_linenumber", "l_suppkey"]
    mappings = dedup.union_distinct(lines.filter("l_returnflag = 'A'").select(*mapping),
                                    lines.filter("l_linestatus = 'F'").select(*mapping))
    chains = lines.select("l_orderkey", "l_linenumber", "l_partkey")
    linked = linking.attach_facts(mappings, chains, ["l_orderkey", "l_linenumber"])
    return linked.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("n_parts"))


def master_table(spark: SparkSession, folder: str) -> DataFrame:
    """Explode ligand lists, keep long chains and known ligands, attach ligand and entry data."""
    customer = table(spark, folder, "customer")
    listed = F.concat_ws(" , ", F.col("c_nationkey").cast("string"),
                         F.floor(F.abs("c_acctbal") / 400).cast("string"), F.col("c_nationkey").cast("string"))
    chains = customer.select(
        F.col("c_custkey").alias("pdb_id"), F.col("c_mktsegment").alias("chain_id"),
        F.repeat("c_mktsegment", F.lit(3)).alias("sequence_1l"),
        F.when(F.col("c_acctbal") < 0, "NO_LIGAND").otherwise(listed).alias("ligand_id"))
    nation = table(spark, folder, "nation").filter("n_regionkey != 0")
    ligands = nation.select(F.col("n_nationkey").cast("string").alias("ligand_id"), F.col("n_name").alias("name"))
    supplier = table(spark, folder, "supplier")
    entries = supplier.select(F.col("s_suppkey").alias("entry"), F.col("s_acctbal").alias("resolution"))
    return flows.master_table(chains, ligands, entries, min_length=27, entry_key="entry").select(
        "pdb_id", "chain_id", "ligand_id", "name", "resolution")


def attached_facts(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    rows = lines.select(F.col("l_partkey").alias("molecule"), F.col("l_suppkey").alias("target"),
                        F.col("l_orderkey").alias("entry"))
    facts = lines.select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("molecule"),
                         F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("kind"))
    return linking.attach_facts(rows, facts, ["molecule", "target"]).groupBy("target", "kind").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


def fetched_facts(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    pairs = lines.join(urgent, lines.l_orderkey == urgent.o_orderkey).select("l_partkey", "l_suppkey")
    facts = lines.select("l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    return linking.facts_for_pairs(facts, pairs, ["l_partkey", "l_suppkey"])


def fallback_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier by customer number, else by nation; customers in debt have no first key."""
    customer = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("first_key"), "c_nationkey")
    supplier = table(spark, folder, "supplier")
    found = linking.fallback_lookup(customer, supplier, ("first_key", "s_suppkey"), ("c_nationkey", "s_nationkey"), "s_name")
    return found.select("c_custkey", F.coalesce("s_name", F.lit("none")).alias("s_name"))


def multimap_rows(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    rows = linking.multimap_lookup(customer, table(spark, folder, "orders"), "c_custkey", "o_custkey", "o_orderkey")
    return rows.select("c_custkey", "c_mktsegment", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


def scalar_lookup(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    found = linking.lookup(orders, table(spark, folder, "customer"), F.col("o_custkey"), "c_custkey", "c_mktsegment", "segment")
    return found.groupBy("segment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def target_components(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    parts = F.array(*[F.struct(F.col(c).alias("accession")) for c in ("n_name", "r_name")],
                    F.struct(F.lit(None).cast("string").alias("accession")))
    targets = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.concat(F.lit("T"), F.col("n_nationkey")).alias("target_chembl_id"), parts.alias("target_components"))
    return linking.component_targets(targets)


def missing_both_sides(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    idle = linking.missing_keys(customer, orders, "c_custkey", "o_custkey").withColumn("side", F.lit("no order"))
    unknown = linking.missing_keys(orders, customer, "o_custkey", "c_custkey").withColumn("side", F.lit("no customer"))
    return idle.unionByName(unknown)


def keys_without_match(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("found", F.nullif("l_returnflag", F.lit("N")))
    return linking.all_null_keys(lines, "l_orderkey", "found")


def semi_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    promo = table(spark, folder, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return lines.join(promo, "l_partkey", "left_semi").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def composite_keys(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    key = composite_key("o_orderkey", F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority")
    return orders.select("o_orderkey", key.alias("pair_key"))


def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    a = lines.filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey")
    b = lines.filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey", big("l_linenumber").alias("line"))
    merged = dedup.union_distinct(a, b)
    return merged.select("l_partkey", "l_suppkey", F.coalesce("line", F.lit(0)).alias("line"))


def set_sizes(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"))
    b = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))

    return (size(dedup.distinct_values(a, "key"), "a").unionByName(size(dedup.distinct_values(b, "key"), "b"))
            .unionByName(size(dedup.shared_values(a, b, "key"), "shared"))
            .unionByName(size(dedup.only_left(a, b, "key"), "only a"))
            .unionByName(size(dedup.only_left(b, a, "key"), "only b")))


def holdings_overlap(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    holdings = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderstatus", "c_name")
    return dedup.holdings_overlaps(holdings, "o_orderstatus", "c_name", "F")


def current_holdings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that are filled, after the check that none of them is open as well."""
    holdings = table(spark, folder, "orders").select("o_orderstatus", F.concat(F.lit("ORD"), "o_orderkey").alias("entry"))
    return flows.current_entries(holdings, "o_orderstatus", "entry", "F")


def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    flags = duplicate_flags(events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"])
    return flags.select("event_id", big("is_duplicate").alias("is_duplicate"))


def duplicate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_count(table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"])


_LINE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]


def _line_columns(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_suppkey", "l_partkey", "l_extendedprice")


def best_per_part(spark: SparkSession, folder: str) -> DataFrame:
    return _line_columns(dedup.keep_best(table(spark, folder, "lineitem"), ["l_partkey"], ["l_quantity"], ["l_tax"], _LINE))


def first_per_order(spark: SparkSession, folder: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return _line_columns(dedup.keep_first(table(spark, folder, "lineitem"), ["l_orderkey"], order))


def nearest_per_supplier(spark: SparkSession, folder: str) -> DataFrame:
    distance = F.round(F.abs(F.col("l_extendedprice") - 40000), 4)
    return _line_columns(dedup.nearest_row(table(spark, folder, "lineitem"), ["l_suppkey"], distance, _LINE))


def top_parts(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.top_k(table(spark, folder, "lineitem"), "l_partkey", 20)


def part_count_of_counts(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.count_of_counts(table(spark, folder, "lineitem"), "l_partkey")


def repeated_names(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.repeated_values(table(spark, folder, "part"), "p_name")


def mixed_sort_head(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col("l_returnflag").asc_nulls_last(), F.col("l_quantity").desc_nulls_last(),
             F.col("l_extendedprice").asc_nulls_last(), *[F.col(c) for c in _LINE[:4]]]
    return _line_columns(table(spark, folder, "lineitem").orderBy(*order).limit(100))


QUERIES = {f.__name__: f for f in (
    link_segments, master_table, attached_facts, fetched_facts, fallback_ids, multimap_rows, scalar_lookup,
    target_components, missing_both_sides, keys_without_match, semi_lines, composite_keys, union_sources,
    set_sizes, holdings_overlap, current_holdings, duplicate_rows, duplicate_pairs, best_per_part, first_per_order,
    nearest_per_supplier, top_parts, part_count_of_counts, repeated_names, mixed_sort_head)}

_LINE_SQL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey, l_extendedprice"


def _first_sql(keys: str, order: str) -> str:
    return f"""
SELECT {_LINE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM lineitem)
WHERE rn = 1"""


ORACLES = {
    "link_segments": """
SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM (
  SELECT DISTINCT a.l_orderkey, a.l_linenumber, a.l_suppkey, b.l_partkey
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
  WHERE a.l_returnflag = 'A' OR a.l_linestatus = 'F') GROUP BY l_suppkey""",
    "master_table": """
SELECT DISTINCT c_custkey AS pdb_id, c_mktsegment AS chain_id, code AS ligand_id, n_name AS name, s_acctbal AS resolution
FROM (SELECT *, unnest([CAST(c_nationkey AS VARCHAR), CAST(CAST(floor(abs(c_acctbal) / 400) AS BIGINT) AS VARCHAR)]) AS code
      FROM customer WHERE c_acctbal >= 0 AND length(repeat(c_mktsegment, 3)) >= 27)
JOIN nation ON code = CAST(n_nationkey AS VARCHAR) AND n_regionkey <> 0
LEFT JOIN supplier ON c_custkey = s_suppkey""",
    "attached_facts": """
SELECT target, kind, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM (
  SELECT DISTINCT a.l_partkey AS molecule, a.l_suppkey AS target, a.l_orderkey AS entry,
         b.l_extendedprice AS value, b.l_returnflag AS kind
  FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)
GROUP BY target, kind""",
    "fetched_facts": """
SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, l_extendedprice FROM lineitem WHERE (l_partkey, l_suppkey) IN (
  SELECT (l_partkey, l_suppkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')""",
    "fallback_ids": """
SELECT c_custkey, coalesce(a.s_name, b.s_name, 'none') AS s_name
FROM customer LEFT JOIN supplier a ON c_acctbal >= 0 AND c_custkey = a.s_suppkey
LEFT JOIN supplier b ON a.s_suppkey IS NULL AND c_nationkey = b.s_nationkey""",
    "multimap_rows": """
SELECT c_custkey, c_mktsegment, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
    "scalar_lookup": """
SELECT c_mktsegment AS segment, o_orderstatus, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey
GROUP BY ALL""",
    "target_components": """
SELECT 'T' || n_nationkey AS target_chembl_id, n_name AS accession FROM nation
UNION ALL SELECT 'T' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "missing_both_sides": """
SELECT c_custkey AS key, 'no order' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'no customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "keys_without_match": """
SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag <> 'N') = 0""",
    "semi_lines": """
SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
GROUP BY l_suppkey""",
    "composite_keys": """
SELECT o_orderkey, o_orderkey || '|' || CASE WHEN o_orderstatus = 'P' THEN 'nan' ELSE o_orderstatus END || '|' || o_orderpriority
  AS pair_key FROM orders""",
    "union_sources": """
SELECT l_partkey, l_suppkey, coalesce(line, 0) AS line FROM (
  SELECT l_partkey, l_suppkey, NULL::BIGINT AS line FROM lineitem WHERE l_returnflag = 'A'
  UNION SELECT l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) FROM lineitem WHERE l_returnflag = 'R')""",
    "set_sizes": """
WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders), b AS (SELECT DISTINCT c_custkey AS key FROM customer)
SELECT 'a' AS part, count(*) AS n FROM a UNION ALL SELECT 'b', count(*) FROM b
UNION ALL SELECT 'shared', count(*) FROM (FROM a INTERSECT FROM b)
UNION ALL SELECT 'only a', count(*) FROM (FROM a EXCEPT FROM b)
UNION ALL SELECT 'only b', count(*) FROM (FROM b EXCEPT FROM a)""",
    "holdings_overlap": """
WITH h AS (SELECT DISTINCT o_orderstatus AS status, lower(c_name) AS entry FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT status, count(*) AS n_entries, count(*) FILTER (entry IN (SELECT entry FROM h WHERE status = 'F')) AS n_shared
FROM h WHERE status <> 'F' GROUP BY status""",
    "current_holdings": "SELECT DISTINCT 'ord' || o_orderkey AS entry FROM orders WHERE o_orderstatus = 'F'",
    "duplicate_rows": """
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS BIGINT) AS is_duplicate
FROM events""",
    "duplicate_pairs": "SELECT count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS n_duplicates FROM lineitem",
    "best_per_part": _first_sql("l_partkey", "l_quantity DESC, l_tax, l_orderkey, l_linenumber, l_suppkey, l_extendedprice"),
    "first_per_order": _first_sql("l_orderkey", "l_linenumber, l_partkey, l_suppkey, l_extendedprice"),
    "nearest_per_supplier": _first_sql(
        "l_suppkey", "round(abs(l_extendedprice - 40000), 4), l_orderkey, l_linenumber, l_partkey, l_extendedprice"),
    "top_parts": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20",
    "part_count_of_counts": """
SELECT c AS occurrences, count(*) AS n_values FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey) GROUP BY c""",
    "repeated_names": "SELECT count(*) AS n_repeated FROM (SELECT 1 FROM part GROUP BY p_name HAVING count(*) > 1)",
    "mixed_sort_head": f"""
SELECT {_LINE_SQL} FROM lineitem ORDER BY l_returnflag, l_quantity DESC, l_extendedprice, lineitem.l_orderkey,
  lineitem.l_linenumber, l_suppkey, l_partkey LIMIT 100""",
}
