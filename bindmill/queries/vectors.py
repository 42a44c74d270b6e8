"""Embedding statistics, pair similarity on samples and near-duplicate pairs of whole tables, token pooling, per-distinct features, PCA."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from bindmill.functions.scalars import vector_columns
from bindmill.operators import dedup, near_classes, profiling, scaling, sequences, similarity, vectors
from bindmill.queries.common import big, r6, table

PROTEIN_SAMPLE = 300
ROW_SAMPLE = 1000
TEXT_SAMPLE = 400
NEAR_COSINE, NEAR_TEXT = 0.95, 0.8


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def dimension_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = vectors.dimension_stats(_embeddings(spark, folder), "embedding")
    return _rounded(stats, "mean", "std", "variance").withColumn("dim", big("dim"))


def vector_hygiene(spark: SparkSession, folder: str) -> DataFrame:
    """Missing rows and variance per position of two blocks, the second of which some rows lack."""
    rows = _embeddings(spark, folder)
    gappy = F.transform("embedding", lambda x, i: F.when((i != 3) | (F.col("vec_id") % 5 != 0), x.cast("double")))
    rows = rows.select(gappy.alias("gappy"), F.when(F.col("vec_id") % 7 != 0, F.slice("embedding", 1, 4)).alias("absent"))
    return _rounded(vectors.vector_hygiene(rows, ["gappy", "absent"]), "variance").withColumn("dim", big("dim"))


def near_constant(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_constant_dimensions(_embeddings(spark, folder), "embedding", 0.124)


def top_variance(spark: SparkSession, folder: str) -> DataFrame:
    top = vectors.top_variance(_embeddings(spark, folder), "embedding", 20)
    return _rounded(top, "variance").withColumn("dim", big("dim"))


def norm_stats(spark: SparkSession, folder: str) -> DataFrame:
    longer = _embeddings(spark, folder).withColumn("embedding", F.transform(
        "embedding", lambda x: x * (F.col("label") + 1)))
    return _rounded(vectors.norm_stats(longer, "embedding"), "mean_norm", "std_norm")


def norm_by_label(spark: SparkSession, folder: str) -> DataFrame:
    longer = _embeddings(spark, folder).withColumn("embedding", F.transform(
        "embedding", lambda x: x.cast("double") * (F.col("label") + 1)))
    spread = profiling.group_spread(longer.withColumn("value", F.get("embedding", F.lit(0))), "label", "value")
    joined = spread.join(vectors.norm_by_group(longer, "label", "embedding"), "label", "left")
    return _rounded(joined, "mean", "std", "mean_norm").withColumn("label", big("label"))


def mean_vectors(spark: SparkSession, folder: str) -> DataFrame:
    means = vectors.mean_vectors(_embeddings(spark, folder), "label", "embedding")
    return means.select(big("label").alias("label"), F.posexplode("embedding").alias("dim", "x")).select(
        "label", big("dim").alias("dim"), r6("x").alias("x"))


def dimension_correlations(spark: SparkSession, folder: str) -> DataFrame:
    r = vectors.dimension_correlations(_embeddings(spark, folder), "embedding", "label")
    return _rounded(vectors.top_correlations(r, 20), "r").withColumn("dim", big("dim"))


def correlation_summary(spark: SparkSession, folder: str) -> DataFrame:
    r = vectors.dimension_correlations(_embeddings(spark, folder), "embedding", "label")
    return _rounded(vectors.correlation_summary(r, (0.05, 0.1)), "max_abs_r")


def vector_export(spark: SparkSession, folder: str) -> DataFrame:
    names = vector_columns("embedding", "e", 64)
    rows = _embeddings(spark, folder).select("vec_id", *names)
    return rows.select("vec_id", *[r6(F.col(c).cast("double")).alias(c) for c in rows.columns if c != "vec_id"])


def _summary(scores: DataFrame, limits: tuple[float, ...]) -> DataFrame:
    summary = similarity.pair_summary(scores, limits)
    return summary.select("n_pairs", *[r6(c).alias(c) for c in summary.columns if c.startswith(("share", "median"))],
                          *[c for c in summary.columns if c.startswith("ordered")])


def protein_cosines(spark: SparkSession, folder: str) -> DataFrame:
    scores = similarity.pair_scores(_embeddings(spark, folder), "vec_id", "embedding", PROTEIN_SAMPLE)
    return _summary(scores, (0.1, 0.2))


def feature_cosines(spark: SparkSession, folder: str) -> DataFrame:
    lengths = F.array(F.col("p_size").cast("double"), F.length("p_name").cast("double"), F.col("p_retailprice") / 100)
    rows = table(spark, folder, "part").select("p_partkey", lengths.alias("v"))
    return _summary(similarity.pair_scores(rows, "p_partkey", "v", ROW_SAMPLE), (0.95, 0.98))


def text_tanimoto(spark: SparkSession, folder: str) -> DataFrame:
    sample = dedup.exact_sample(table(spark, folder, "documents"), "doc_id", TEXT_SAMPLE)
    prints = similarity.with_fingerprint(sample, "text").select("doc_id", "bits")
    scores = similarity.pair_scores(prints, "doc_id", "bits", TEXT_SAMPLE, bits=similarity.FINGERPRINT_BITS)
    return _summary(scores, (0.2, 0.4))


def near_duplicate_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its class of near copies."""
    return near_classes.vector_classes(_embeddings(spark, folder), "vec_id", "embedding", NEAR_COSINE)


def near_duplicate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that has a word with its class of near copies."""
    return near_classes.text_classes(table(spark, folder, "documents"), "doc_id", "text", NEAR_TEXT)


def pooled_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over the inner turns of each conversation; first and last turn play the boundary tokens."""
    turns = table(spark, folder, "conversations")
    last = turns.groupBy("conv_id").agg((F.max("turn") - 1).alias("length"))
    vector = F.array(F.length("text").cast("double"), (F.col("role") == "user").cast("double"))
    tokens = turns.select("conv_id", "turn", vector.alias("v")).join(last, "conv_id")
    pooled = sequences.pool_tokens(tokens, "conv_id", "turn", "length", "v")
    return pooled.select("conv_id", *[r6(c).alias(f"p{i + 1}") for i, c in enumerate(vector_columns("v", "p", 2))])


def _letter_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"text": frame["text"], "n_a": frame["text"].str.count("a"), "n_e": frame["text"].str.count("e")})


def per_distinct_features(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = scaling.attach_per_distinct(documents, "text", _letter_counts, "text string, n_a long, n_e long", skip="X")
    return rows.select("doc_id", F.coalesce("n_a", F.lit(-1)).alias("n_a"), F.coalesce("n_e", F.lit(-1)).alias("n_e"))


def pca_variance(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(vectors.explained_variance(_embeddings(spark, folder), "embedding", 50), "share", "cumulative")


def pca_two_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Variance shares of the two components of two columns, which have a closed form."""
    pair = F.array(F.col("l_quantity").cast("double"), (F.col("l_extendedprice") / 1000).cast("double"))
    lines = table(spark, folder, "lineitem").select(pair.alias("v"))
    return _rounded(vectors.explained_variance(lines, "v", 2), "share", "cumulative").withColumn("pc", big("pc"))


def components_needed(spark: SparkSession, folder: str) -> DataFrame:
    variance = vectors.explained_variance(_embeddings(spark, folder), "embedding", 50)
    return vectors.components_needed(variance, 50)


def brands_needed(spark: SparkSession, folder: str) -> DataFrame:
    """The running-share report on the 25 brands, largest first, in place of components."""
    part = table(spark, folder, "part")
    counts = profiling.value_shares(part, "p_brand").withColumn(
        "pc", F.row_number().over(W.orderBy(F.desc("share"), "p_brand")))
    return vectors.components_needed(vectors.running_share(counts.select("pc", "share")), 25, (0.1, 0.5, 0.9)).select(
        "target", big("n_components").alias("n_components"))


def pca_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(vectors.pca_scores(_embeddings(spark, folder), "embedding", 2), "pc1", "pc2")


QUERIES = {f.__name__: f for f in (
    dimension_stats, vector_hygiene, near_constant, top_variance, norm_stats, norm_by_label, mean_vectors, dimension_correlations,
    correlation_summary, vector_export, protein_cosines, feature_cosines, text_tanimoto, near_duplicate_vectors,
    near_duplicate_texts, pooled_tokens,
    per_distinct_features, pca_variance, pca_two_columns, components_needed,
    brands_needed, pca_scores)}

_LONG = """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
s AS (SELECT dim, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS variance, corr(x, label) AS r FROM x GROUP BY dim)"""
_NORMS = """
WITH n AS (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: (x * (label + 1))::DOUBLE * (x * (label + 1))::DOUBLE))) AS norm,
                  embedding[1]::DOUBLE * (label + 1) AS value FROM embeddings)"""


def _pairs(source: str, score: str, limits: tuple[float, ...]) -> str:
    shares = ", ".join(f"round(avg((s > {t}::DOUBLE)::INT), 6) + 0.0 AS share_above_{int(round(t * 100)):02d}" for t in limits)
    counts = ", ".join(f"2 * count(*) FILTER (s > {t}::DOUBLE) AS ordered_above_{int(round(t * 100)):02d}" for t in limits)
    return f"""
SELECT count(*) AS n_pairs, {shares}, {counts}, round(quantile_cont(s, 0.5), 6) + 0.0 AS median_score
FROM (SELECT round({score}, 6) AS s FROM {source} a JOIN {source} b ON a.k < b.k)"""


_CLASSES = """e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t(node, root) AS (SELECT k, k FROM d UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node WHERE t.root < e.b),
c AS (SELECT node, min(root) AS root FROM t GROUP BY node)"""

ORACLES = {
    "dimension_stats": _LONG + """
SELECT dim, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(variance, 6) + 0.0 AS variance FROM s""",
    "vector_hygiene": """
WITH b AS (SELECT 'gappy' AS block, vec_id, embedding::DOUBLE[] AS v FROM embeddings
           UNION ALL SELECT 'absent', vec_id, CASE WHEN vec_id % 7 <> 0 THEN embedding[1:4]::DOUBLE[] END FROM embeddings),
x AS (SELECT block, vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM b),
g AS (SELECT block, dim, CASE WHEN block <> 'gappy' OR dim <> 3 OR vec_id % 5 <> 0 THEN x END AS x FROM x)
SELECT block, dim, (SELECT count(*) FROM embeddings) - count(x) AS n_missing, round(var_pop(x), 6) + 0.0 AS variance
FROM g GROUP BY block, dim""",
    "near_constant": _LONG + " SELECT count(*) FILTER (std < 0.124::DOUBLE) AS n_near_constant FROM s",
    "top_variance": _LONG + " SELECT dim, round(variance, 6) + 0.0 AS variance FROM s ORDER BY s.variance DESC, dim LIMIT 20",
    "norm_stats": _NORMS + """
SELECT count(*) AS n, round(avg(norm), 6) + 0.0 AS mean_norm, round(stddev_pop(norm), 6) + 0.0 AS std_norm FROM n""",
    "norm_by_label": _NORMS + """
SELECT CAST(label AS BIGINT) AS label, count(*) AS n_entries, round(avg(value), 6) + 0.0 AS mean,
       round(stddev_samp(value), 6) + 0.0 AS std, round(avg(norm), 6) + 0.0 AS mean_norm FROM n GROUP BY n.label""",
    "mean_vectors": _LONG + """
SELECT CAST(label AS BIGINT) AS label, dim, round(avg(x), 6) + 0.0 AS x FROM x GROUP BY x.label, dim""",
    "dimension_correlations": _LONG + " SELECT dim, round(r, 6) + 0.0 AS r FROM s ORDER BY abs(s.r) DESC, dim LIMIT 20",
    "correlation_summary": _LONG + """
SELECT round(max(abs(r)), 6) + 0.0 AS max_abs_r, count(*) FILTER (abs(r) > 0.05::DOUBLE) AS n_above_05,
       count(*) FILTER (abs(r) > 0.1::DOUBLE) AS n_above_10 FROM s""",
    "vector_export": "SELECT vec_id, " + ", ".join(
        f"round(embedding[{i}]::DOUBLE, 6) + 0.0 AS e{i}" for i in range(1, 65)) + " FROM embeddings",
    "brands_needed": """
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand),
r AS (SELECT row_number() OVER w AS pc, sum(n) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE / (SELECT sum(n) FROM c) AS total
      FROM c WINDOW w AS (ORDER BY n DESC, p_brand))
SELECT target::DOUBLE AS target, coalesce(min(pc) FILTER (total >= target::DOUBLE - 1e-12), 26) AS n_components
FROM r, (SELECT unnest([0.1, 0.5, 0.9]) AS target) GROUP BY target""",
    "protein_cosines": f"""
WITH v AS (SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings
           ORDER BY md5('42|' || vec_id), vec_id LIMIT {PROTEIN_SAMPLE})""" + _pairs(
        "v", "list_cosine_similarity(a.v, b.v)", (0.1, 0.2)),
    "feature_cosines": f"""
WITH v AS (SELECT p_partkey AS k, [p_size::DOUBLE, length(p_name)::DOUBLE, p_retailprice / 100] AS v FROM part
           ORDER BY md5('42|' || p_partkey), p_partkey LIMIT {ROW_SAMPLE})""" + _pairs(
        "v", "list_cosine_similarity(a.v, b.v)", (0.95, 0.98)),
    "text_tanimoto": f"""
WITH d AS (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS w FROM documents
           ORDER BY md5('42|' || doc_id), doc_id LIMIT {TEXT_SAMPLE}),
v AS (SELECT doc_id AS k, list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i:
        ('0x' || substr(md5(w[i] || ' ' || w[i + 1]), 1, 6))::INT % 2048)) AS b FROM d)""" + _pairs(
        "v", "CASE WHEN len(a.b) + len(b.b) = 0 THEN 1 ELSE len(list_intersect(a.b, b.b))::DOUBLE / "
             "(len(a.b) + len(b.b) - len(list_intersect(a.b, b.b))) END", (0.2, 0.4)),
    "pca_two_columns": """
WITH x AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE / 1000 AS b FROM lineitem),
m AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM x),
e AS (SELECT (va + vb) / 2 AS h, sqrt(((va - vb) / 2) ** 2 + c ** 2) AS d FROM m)
SELECT 1::BIGINT AS pc, round((h + d) / (2 * h), 6) AS share, round((h + d) / (2 * h), 6) AS cumulative FROM e
UNION ALL SELECT 2, round((h - d) / (2 * h), 6), 1.0::DOUBLE FROM e""",
    "near_duplicate_vectors": f"""
WITH RECURSIVE d AS (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS k FROM embeddings GROUP BY ALL),
p AS (SELECT a.k AS a, b.k AS b FROM d a JOIN d b ON a.k < b.k
      WHERE round(list_cosine_similarity(a.v, b.v), 6) > {NEAR_COSINE}::DOUBLE),
{_CLASSES}
SELECT vec_id AS key, root AS class_id, count(*) OVER (PARTITION BY root) AS class_size
FROM embeddings e JOIN d ON e.embedding::DOUBLE[] = d.v JOIN c ON c.node = d.k""",
    "near_duplicate_texts": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT w, min(doc_id) AS k FROM w WHERE len(w) > 0 GROUP BY w),
g AS (SELECT DISTINCT k, unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: concat_ws(' ', w[i], w[i + 1]))) AS g
      FROM d),
s AS (SELECT k, count(*) AS size FROM g GROUP BY k),
m AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
p AS (SELECT a, b FROM m JOIN s x ON x.k = a JOIN s y ON y.k = b
      WHERE round(c::DOUBLE / (x.size + y.size - c), 6) > {NEAR_TEXT}::DOUBLE),
{_CLASSES}
SELECT doc_id AS key, root AS class_id, count(*) OVER (PARTITION BY root) AS class_size
FROM w JOIN d USING (w) JOIN c ON c.node = d.k""",
    "pooled_tokens": """
SELECT conv_id, round(avg(length(text)), 6) + 0.0 AS p1, round(avg((role = 'user')::INT), 6) + 0.0 AS p2
FROM conversations JOIN (SELECT conv_id, max(turn) - 1 AS last FROM conversations GROUP BY conv_id) USING (conv_id)
WHERE turn BETWEEN 1 AND last GROUP BY conv_id""",
    "per_distinct_features": """
SELECT doc_id, CASE WHEN contains(text, 'X') THEN -1 ELSE length(text) - length(replace(text, 'a', '')) END AS n_a,
       CASE WHEN contains(text, 'X') THEN -1 ELSE length(text) - length(replace(text, 'e', '')) END AS n_e FROM documents""",
}
