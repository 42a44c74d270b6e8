"""One-scan sums against plain formulas: gaps, ragged vectors, large means, constants, many partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bindmill.operators import dedup, moments, profiling, scaling, vectors
from bindmill.plans import flows


@pytest.fixture(scope="module")
def gappy(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(700, 4)) * [1.0, 5.0, 1e-3, 0.0] + [0.0, 1e9, 3.0, 7.0]
    x[:, 2] += 0.002 * x[:, 0]
    holes = draw.random(x.shape) < 0.1
    rows = [(i % 7, [None if h else float(v) for v, h in zip(r, hs)]) for i, (r, hs) in enumerate(zip(x, holes))]
    rows += [(1, None), (2, [1.0]), (None, [2.0, 3.0, 4.0, 5.0]), (3, [])]
    frame = pd.DataFrame([(r[1] or []) + [None] * (4 - len(r[1] or [])) for r in rows]).astype(float)
    df = spark.createDataFrame(rows, "g int, v array<double>").repartition(5)
    return df, frame, [r[0] for r in rows]


def test_moments_and_correlations_with_gaps(gappy):
    df, frame, _ = gappy
    got = {r.dim: r for r in vectors.dimension_stats(df, "v").collect()}
    for k in range(4):
        assert got[k]["mean"] == pytest.approx(frame[k].mean(), rel=1e-12) and got[k]["std"] == pytest.approx(frame[k].std(), rel=1e-9)
    columns = df.select(*[F.get("v", F.lit(k)).alias(f"c{k}") for k in range(4)])
    r = {(x.a, x.b): x.r for x in profiling.correlation_pairs(columns, [f"c{k}" for k in range(4)]).collect()}
    plain = frame.corr()
    assert len(r) == 6 and all(r[f"c{a}", f"c{b}"] == pytest.approx(plain[a][b], rel=1e-7, abs=1e-9) for a in range(3) for b in range(a + 1, 3))
    assert all(np.isnan(r[f"c{a}", "c3"]) for a in range(3)) or frame[3].nunique() > 1
    one = {x.dim: x.r for x in vectors.dimension_correlations(df.withColumn("t", F.get("v", F.lit(0))), "v", "t").collect()}
    assert one[0] == pytest.approx(1.0) and one[2] == pytest.approx(plain[0][2], rel=1e-9)
    hygiene = {x.dim: x for x in vectors.vector_hygiene(df, ["v"]).collect()}
    assert all(hygiene[k].n_missing == frame[k].isna().sum() for k in range(4))


def test_segment_means_with_gaps(gappy, spark):
    df, frame, groups = gappy
    got = {r.g: r.v for r in moments.segment_means(df, "g", "v").collect()}
    plain = frame.groupby(pd.Series(groups)).mean()
    assert sorted(got) == list(range(7))
    for g, v in got.items():
        assert np.allclose(v, plain.loc[g].to_numpy()[:len(v)], rtol=1e-12)
    names = spark.createDataFrame([("a", [1.0, None]), ("a", [3.0, None]), ("b", [5.0])], "k string, v array<double>")
    assert {r.k: r.v for r in moments.segment_means(names, "k", "v").collect()} == {"a": [2.0, None], "b": [5.0]}
    assert moments.segment_means(names.where("false"), "k", "v").count() == 0


def test_no_cell_is_a_row_and_each_table_is_read_once(gappy):
    df, _, _ = gappy
    for frame in (vectors.dimension_stats(df, "v"), scaling.fit_scaler(df, "v"), vectors.mean_vectors(df, "g", "v"),
                  vectors.dimension_correlations(df, "v", "g"), profiling.correlation_pairs(df.select(F.get("v", F.lit(0)).alias("a"), "g"), ["a", "g"])):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and plan.count("MapInPandas") in (1, 2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g int, v array<double>")
    assert vectors.dimension_stats(none, "v").count() == 0
    assert vectors.vector_hygiene(none, ["v"]).count() == 0
    assert profiling.correlation_pairs(none.select("g", F.col("g").alias("h")), ["g", "h"]).count() == 0


def test_constant_positions_go(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 5.0], [0.0, None]), ([1.0, 3.0, 5.0], [1.0, 2.0])], "a array<double>, b array<double>")
    kept, report = scaling.whole_blocks(rows, ["a", "b"], constant=True)
    assert sorted((r.a, r.b) for r in kept.collect()) == [([2.0], [0.0]), ([3.0], [1.0])]
    assert report.first().n_positions_dropped == 3 and report.first().n_positions == 5
    kept, report = scaling.whole_blocks(rows, ["a", "b"], "fill", -1.0, constant=True)
    assert sorted((r.a, r.b) for r in kept.collect()) == [([2.0], [0.0]), ([3.0], [1.0])]
    kept, _ = scaling.whole_blocks(rows, ["a", "b"], "rows", constant=True)
    assert [(r.a, r.b) for r in kept.collect()] == [([3.0], [1.0])]
    assert sorted(r.a for r in scaling.whole_blocks(rows, ["a"])[0].collect()) == [[1.0, 2.0, 5.0], [1.0, 3.0, 5.0]]
    with pytest.raises(ValueError):
        scaling.whole_blocks(rows.select(F.array(F.lit(1.0)).alias("a")), ["a"], constant=True)


def test_current_entries(spark):
    rows = [("current", "1ABC"), ("current", "1abc"), ("obsolete", "2xyz")]
    held = spark.createDataFrame(rows, "status string, entry string")
    assert [r.entry for r in flows.current_entries(held, "status", "entry", "current").collect()] == ["1abc"]
    with pytest.raises(ValueError):
        flows.current_entries(held.union(spark.createDataFrame([("obsolete", "1ABC")], held.schema)), "status", "entry", "current")


def test_large_samples_need_no_sort(spark):
    df = spark.range(5000).withColumn("x", F.col("id") * 2)
    small, large = (dedup.exact_sample(df, "id", 700, ordered=n) for n in (10_000, 100))
    assert sorted(small.collect()) == sorted(large.collect()) and large.count() == 700
    assert dedup.exact_sample(df, "id", 9000, ordered=100).count() == 5000
    assert "Sort" not in large._jdf.queryExecution().optimizedPlan().toString()
