"""Classes of near copies against exact self-joins, and components against a plain union."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindmill.operators import near_classes, similarity
from bindmill.operators.components import components


def _union(nodes, pairs):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_components_equal_a_plain_union(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    pairs += [(2000, i) for i in range(2001, 2200)] + [(5, 5), (7, None), (None, 8)]
    df = spark.createDataFrame(pairs, "a long, b long")
    used = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    want = _union({n for p in used for n in p}, used)
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.where("false")).count() == 0


@pytest.mark.parametrize("tile", [1000, 7])
def test_vector_classes_of_a_whole_table(spark, monkeypatch, tile):
    """Links of the exact self-join that lie inside a class: at least 99.5 in 100; no class holds more than its links."""
    monkeypatch.setattr(similarity, "TILE", tile)
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()])
    rng = np.random.default_rng(4)
    near = x[:300].repeat(3, axis=0)
    near = near + rng.normal(size=near.shape) * near.std() * rng.uniform(0.05, 0.4, size=(len(near), 1))
    drift = x[0] + np.cumsum(rng.normal(size=(150, 64)) * 0.012, axis=0)
    x = np.concatenate([x, near, x[:50], drift, x[:1].repeat(200, axis=0)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(np.round(unit @ unit.T, 6), 1) > 0.95))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(9001, [0.0] * 64), (9002, None), (9003, [1.0]), (None, [1.0]), (9004, [float("nan")])],
                               "id long, v array<double>")
    got = {r.key: r for r in near_classes.vector_classes(df, "id", "v").collect()}
    assert sorted(got) == [*range(len(x)), 9003] and got[9003].class_id == 9003
    recall = sum(got[a].class_id == got[b].class_id for a, b in links) / len(links)
    print("recall of vector links", recall, len(links))
    assert recall >= 0.995
    want = _union(range(len(x)), links)
    assert all(want[i] == want[got[i].class_id] for i in range(len(x)))
    sizes = {}
    for r in got.values():
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] and r.class_id <= r.key for r in got.values())


def test_text_classes_of_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text.lower().split() for r in df.collect() if r.text and r.text.split()}
    grams = {i: {" ".join(w[k:k + 2]) for k in range(max(1, len(w) - 1))} for i, w in texts.items()}
    ids, links = sorted(grams), []
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            x, y = grams[i], grams[j]
            if min(len(x), len(y)) > 0.8 * max(len(x), len(y)) and (c := len(x & y)) / (len(x) + len(y) - c) > 0.8000005:
                links.append((i, j))
    got = {r.key: r.class_id for r in near_classes.text_classes(df, "doc_id", "text").collect()}
    recall = sum(got[a] == got[b] for a, b in links) / len(links)
    print("recall of text links", recall, len(links))
    want = _union(ids, links)
    assert sorted(got) == ids and recall >= 0.995 and all(want[i] == want[got[i]] for i in ids)
    odd = spark.createDataFrame([(1, ""), (2, None), (3, "one"), (4, "One"), (5, "two"), (None, "one")], "id long, t string")
    assert sorted(tuple(r) for r in near_classes.text_classes(odd, "id", "t").collect()) == [(3, 3, 2), (4, 3, 2), (5, 5, 1)]
    assert near_classes.text_classes(odd.where("false"), "id", "t").count() == 0
    assert near_classes.vector_classes(odd.select("id", F.array().cast("array<double>").alias("v")), "id", "v").count() == 0
