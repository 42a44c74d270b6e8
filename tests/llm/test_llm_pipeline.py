"""The pipeline's stages take effect on what their predecessors kept."""

import corpus_pipeline
from bindmill.llm import queries
from bindmill.llm.decontamination import find_leaks
from bindmill.llm.near_duplicates import near_duplicates


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, small))
        kept[name] = docs
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
    labels = spark.read.parquet(f"{small}/labels.parquet")
    bad = labels.where("quality = 0").count()
    assert kept["quality"].join(labels.where("quality = 0"), "doc_id").count() <= 0.2 * bad
    assert kept["quality"].join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * labels.where("quality = 1").count()
    assert near_duplicates(kept["near_duplicates"]).where("class_size > 1").count() == 0
    assert find_leaks(kept["decontamination"], spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
    assert kept["mixing"].groupBy("doc_id").count().where("count > 3").count() == 0
    assert kept["sharding"].count() == kept["mixing"].count()
    sizes = [r["count"] for r in kept["sharding"].groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_stages_on_awkward_rows(spark, small, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge_docs, no_docs):
            out = stage(spark, docs, small)
            assert out.columns[:len(docs.columns)] == docs.columns and out.count() <= 3 * docs.count()
