"""From raw documents to sharded training rows: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bindmill.llm.common import read
from bindmill.llm.decontamination import drop_leaks
from bindmill.llm.mixing import mix_documents
from bindmill.llm.near_duplicates import drop_near_duplicates
from bindmill.llm.quality_model import keep_good
from bindmill.llm.sharding import shard_rows
from bindmill.session import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more; the machine is fitted on the labelled ones among them."""
    return keep_good(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by half or more."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot."""
    return shard_rows(docs, ["doc_id"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # the classifier and the signatures have no SQL form; the tests hold the stages against brute force
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
