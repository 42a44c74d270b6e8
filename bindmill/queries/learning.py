"""Classifiers on text features of labelled documents; model fits have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.operators import metrics, models, networks, scaling, splitting
from bindmill.queries.common import r6, table
from bindmill.queries.splitting import _parts
from bindmill.session import durable

FEATURES = ["n_chars", "n_words", "n_lines", "n_digits", "n_marks", "mean_word"]
#: Parameters of the single fits, inside the search ranges.
TREE = {"maxIter": 100, "maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 2, "subsamplingRate": 0.8}
NETWORK = {"units": [16], "dropout": [0.1], "learning_rate": 0.005, "batch_size": 32, "epochs": 100}
TRIALS = 400  # candidates of a search
SCORES = ("accuracy", "recall", "precision", "f1", "mcc", "auc")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled features, label and the train / val / test split of every labelled document."""
    documents = table(spark, folder, "documents").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    words = F.size(F.split("text", r"\s+"))
    features = documents.select(
        "doc_id", "quality", "n_chars", words.alias("n_words"), F.regexp_count("text", F.lit(r"\n")).alias("n_lines"),
        F.regexp_count("text", F.lit(r"[0-9]")).alias("n_digits"),
        F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s]")).alias("n_marks"), (F.col("n_chars") / words).alias("mean_word"))
    vectors = scaling.assemble(features, FEATURES)
    return durable(scaling.scale_on_train(splitting.random_parts(durable(vectors), ["doc_id"])))


def _report(model, rows: DataFrame) -> DataFrame:
    scored = models.score(model, models.with_vector(rows, "quality"))
    return metrics.evaluate(scored, "split", "label", "predicted_proba").withColumns({c: r6(c) for c in SCORES})


def labelled_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and positives of every split that the classifiers are trained and scored on."""
    positive = F.count_if(F.col("quality") == 1)
    return _rows(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), positive.alias("n_positive"))


def boosted_tree_report(spark: SparkSession, folder: str, params: dict = TREE) -> DataFrame:
    rows = _rows(spark, folder)
    train = models.with_vector(rows, "quality").filter("split = 'train'")
    return _report(models.boosted_trees(params).fit(models.compact(train)), rows)


def feed_forward_report(spark: SparkSession, folder: str, params: dict = NETWORK) -> DataFrame:
    """Scores of one network with dropout, stopped at its least validation loss."""
    rows = _rows(spark, folder)
    return _report(networks.fit_networks(models.dealt(rows), "quality", [params])[0], rows)


def selected_model_report(spark: SparkSession, folder: str, trials: int = TRIALS,
                          ranges: dict = models.TREE_RANGES) -> DataFrame:
    """Scores of the boosted trees with the best validation F1 among seeded draws from the search ranges."""
    rows = _rows(spark, folder)
    return _report(models.search_trees(rows, "quality", models.draw_tree_params(trials, ranges=ranges))[0], rows)


def selected_network_report(spark: SparkSession, folder: str, trials: int = TRIALS,
                            ranges: dict = models.NETWORK_RANGES) -> DataFrame:
    """Scores of the feed-forward network with the best validation F1 among seeded draws from the search ranges."""
    rows = _rows(spark, folder)
    return _report(models.search_networks(rows, "quality", models.draw_network_params(trials, ranges=ranges))[0], rows)


QUERIES = {f.__name__: f for f in (labelled_splits, boosted_tree_report, feed_forward_report, selected_model_report,
                                     selected_network_report)}
ORACLES = {
    "labelled_splits": f"""
WITH r AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)), s AS ({_parts("r", "doc_id", "0.10", "0.1111")})
SELECT split, count(*) AS n_rows, count(*) FILTER (quality = 1) AS n_positive FROM s GROUP BY split""",
}
