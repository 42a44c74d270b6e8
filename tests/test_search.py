"""Networks with dropout, and model search by successive halving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindmill.operators import boosting, metrics, models, search
from bindmill.operators.networks import EarlyStop, Network, fit_networks
from bindmill.queries import learning


@pytest.fixture(scope="module")
def rows(spark):
    """Two classes parted by a curve, in three splits."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(900, 3))
    y = (x[:, 0] ** 2 + 0.5 * x[:, 1] > 0.7).astype(int)
    part = np.where(np.arange(900) < 500, "train", np.where(np.arange(900) < 700, "val", "test"))
    return spark.createDataFrame([(str(s), int(a), row.tolist()) for s, a, row in zip(part, y, x)],
                                 "split string, y int, features array<double>").repartition(3).cache()


@pytest.mark.parametrize("activation", ["relu", "tanh", "elu"])
def test_gradients_equal_finite_differences(activation):
    draw = np.random.default_rng(3)
    network = Network({"units": [5, 4], "dropout": [0.0, 0.0], "activation": activation, "weight_decay": 0.01}, 3)
    x, y = draw.normal(size=(20, 3)), draw.integers(0, 2, 20).astype(float)
    _, gradient = network.gradient(x, y)
    start, step = network.theta.copy(), 1e-6
    for i in draw.choice(len(start), 25, replace=False):
        ends = []
        for sign in (1, -1):
            network.theta = start.copy()
            network.theta[i] += sign * step
            ends.append(network.gradient(x, y)[0])
        assert gradient[i] == pytest.approx((ends[0] - ends[1]) / (2 * step), rel=1e-4, abs=1e-7)


def test_dropout_keeps_the_mean_and_early_stop_waits():
    network = Network({"units": [400], "dropout": [0.5]}, 4)
    x, y = np.ones((1, 4)), np.zeros(1)
    parts = [network.gradient(x, y, np.random.default_rng(k))[1][-1] for k in range(300)]
    assert np.mean(parts) == pytest.approx(network.gradient(x, y)[1][-1], abs=0.05) and np.std(parts) > 0
    stop = EarlyStop(3)
    for loss in (3.0, 2.0, 2.5, 2.1):
        stop.see(loss, np.array([loss]))
    assert not stop.done and stop.state.tolist() == [2.0]
    stop.see(2.2, np.array([0.0]))
    assert stop.done


def test_network_is_as_good_as_the_library_s(rows):
    asked = {"units": [16], "dropout": [0.1], "learning_rate": 0.01, "epochs": 60}
    network = fit_networks(rows, "y", [asked, {**asked, "units": [8, 8], "dropout": [0.0, 0.0]}])
    library = models.feed_forward({"units": [16], "maxIter": 60}, 3).fit(
        models.with_vector(rows.filter("split = 'train'"), "y"))
    test = models.with_vector(rows.filter("split = 'test'"), "y")
    for one in network:
        assert models.validation_f1(one, test) >= models.validation_f1(library, test) - 0.02 > 0.8
    untrained = fit_networks(rows.where("split = 'val'"), "y", [{**asked, "epochs": 2}])[0]
    assert (untrained.theta == Network(asked, 3).theta).all()
    none = fit_networks(rows.where("false"), "y", [asked])
    assert len(none) == 1 and none[0].sizes == [1, 16, 1]


def test_staged_trees_equal_the_library_s(spark):
    """On values that all have a bin of their own, without sampling, every stage gives the library's margins."""
    draw = np.random.default_rng(1)
    x = draw.integers(0, 12, (200, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) | (draw.random(200) < 0.1)).astype(float)
    params = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 5}
    mine = search.StagedTrees(params, (x, y), (x, y), 0)
    mine.advance(2, (x, y), (x, y))
    mine.advance(6, (x, y), (x, y))
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "y double, features array<double>")
    model = models.boosted_trees(params).fit(models.with_vector(df, "y"))
    theirs = [r[0] for r in models.score(model, models.with_vector(df, "y")).select("predicted_proba").collect()]
    assert np.allclose(1 / (1 + np.exp(-2 * mine.margin)), theirs, atol=1e-9)
    assert mine.rounds == 6 and mine.best == max(mine.best, search.f1(mine.margin > 0, y)) and 1 <= mine.best_rounds <= 6


def test_halving_finds_the_best_of_a_small_grid(rows):
    grid = [{"stepSize": s, "maxDepth": d, "maxIter": n, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureShare": 1.0}
            for s in (0.05, 0.3) for d in (2, 4) for n in (5, 30)]
    trials = search.successive_halving(rows, "y", grid, search.StagedTrees, (5, 15, 30), keep=2).collect()
    train, validation = (search.bounded_sample(rows, "y", "split", p) for p in ("train", "val"))
    every = []
    for params in grid:
        one = search.StagedTrees(params, train, validation, 42)
        one.advance(1000, train, validation)
        every.append(one.best)
    assert sorted(t.trial for t in trials) == list(range(8)) and sorted(t.stage for t in trials) == [0] * 4 + [1] * 2 + [2] * 2
    assert max(t.f1 for t in trials if t.stage == 2) == max(every)
    model, table = models.search_trees(rows, "y", grid, stages=(5, 15, 30), keep=2)
    assert models.validation_f1(model, models.with_vector(rows.filter("split = 'val'"), "y")) > 0.85
    assert table.count() == 8
    network, table = models.search_networks(rows, "y", models.draw_network_params(6), stages=(4, 40))
    assert models.validation_f1(network, models.with_vector(rows.filter("split = 'val'"), "y")) > 0.7
    assert table.where("stage = 1").count() == 1


def test_sample_is_exact_and_bounded(rows):
    x, y = search.bounded_sample(rows, "y", "split", "train", most=100)
    assert x.shape == (100, 3) and len(y) == 100
    again, _ = search.bounded_sample(rows.repartition(7), "y", "split", "train", most=100)
    assert (x == again).all()
    assert search.bounded_sample(rows, "y", "split", "none")[0].shape == (0, 1)


def test_drawn_parameters_fill_their_ranges():
    drawn = models.draw_network_params(400)
    assert {len(p["units"]) for p in drawn} == {1, 2, 3, 4, 5} and {p["batch_size"] for p in drawn} == {16, 32, 64}
    assert all(16 <= u <= 128 for p in drawn for u in p["units"]) and all(1e-5 <= p["learning_rate"] <= 1e-2 for p in drawn)
    assert all(len(p["units"]) == len(p["dropout"]) for p in drawn) and drawn == models.draw_network_params(400)
    assert learning.TRIALS == len(drawn)


def test_all_metrics_come_from_one_reading(spark, rows):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(values):
        calls.add(1)
        return float(values[0])

    df = rows.withColumn("p", scored("features"))
    got = {r.split: r for r in metrics.evaluate(df, "split", "y", "p").collect()}
    assert calls.value == 900
    plain = rows.withColumn("p", F.col("features")[0])
    parts = {r.split: r for r in metrics.threshold_metrics(metrics.predict(plain, "p"), "split", "y", "predicted_label").collect()}
    areas = {r.split: r.auc for r in metrics.roc_auc(plain, "split", "y", "p").collect()}
    for name, r in got.items():
        assert r.auc == areas[name] and all(r[c] == parts[name][c] for c in parts[name].asDict())


def test_one_part_equals_the_library_s_and_many_use_every_row_in_one_job(spark):
    """the final fit of a search was a job for every level of every round."""
    draw = np.random.default_rng(1)
    x = draw.integers(0, 12, (400, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) | (draw.random(400) < 0.1)).astype(float)
    params = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 5}
    rows = spark.createDataFrame([("train", float(b), a.tolist()) for a, b in zip(x, y)],
                                 "split string, y double, features array<double>")
    vectors = models.with_vector(rows, "y")
    theirs = models.score(models.boosted_trees(params).fit(vectors), vectors)
    [one] = boosting.fit_parts(rows, "y", [params])
    assert np.allclose([r[0] for r in one.score(rows).select("predicted_proba").collect()],
                       [r["predicted_proba"] for r in theirs.collect()], atol=1e-9)
    many, _ = boosting.fit_parts(rows, "y", [params, params], part_rows=100)
    assert len(many.trees) == 4 * 6
    assert models.validation_f1(many, vectors) >= models.validation_f1(one, vectors) - 0.05
    spark.sparkContext.setJobGroup("F1", "one fit")
    boosting.fit_parts(rows, "y", [{**params, "maxIter": 60}], part_rows=100)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("F1"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 12


def test_networks_train_on_all_cores(spark, rows, monkeypatch):
    """up to 100,000 rows were one task's in every epoch."""
    monkeypatch.setattr(models, "NETWORK_ROWS", 150)
    sizes = models.dealt(rows).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 6 and sum(r["count"] for r in sizes) == 900 and max(r["count"] for r in sizes) <= 160
    asked = {"units": [16], "dropout": [0.0], "learning_rate": 0.01, "batch_size": 16, "epochs": 30}
    [network] = fit_networks(models.dealt(rows), "y", [asked])
    assert models.validation_f1(network, models.with_vector(rows.filter("split = 'val'"), "y")) > 0.8
    seen = []
    monkeypatch.setattr(models, "fit_networks", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or fit_networks(df, *a))
    models.search_networks(rows, "y", [{**asked, "epochs": 2}] * 2, stages=(2,))
    assert seen == [6]


def test_searched_networks_train_on_every_row(spark):
    """networks were searched on 4,096 train and 4,096 validation rows of a larger table."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(10_000, 3)).round(6)
    y = (x[:, 0] ** 2 + 0.5 * x[:, 1] + 0.3 * draw.normal(size=10_000) > 0.7).astype(int)
    rows = spark.createDataFrame([("train" if i < 5500 else "val", int(a), r.tolist()) for i, (a, r) in enumerate(zip(y, x))],
                                 "split string, y int, features array<double>")
    params = {"units": [8], "dropout": [0.1], "learning_rate": 0.01, "epochs": 2}
    [trial] = search.successive_halving(rows, "y", [params], search.StagedNetwork, (2,)).collect()
    train, validation = (search.bounded_sample(rows, "y", "split", p, most=10_000) for p in ("train", "val"))
    assert len(train[1]) == 5500 and len(validation[1]) == 4500
    one = search.StagedNetwork(params, train, validation, 42)
    one.advance(2, train, validation)
    assert (trial.f1, trial.rounds, trial.best_rounds) == (one.best, 2, one.best_rounds)


def test_networks_of_tables_no_task_holds_are_searched_in_parts(spark, rows, monkeypatch):
    """F2: beyond ``HELD_ROWS`` every epoch passes over the whole table, and the scores are those of a fit in parts."""
    used = rows.where("split != 'test'")
    params = {"units": [8], "dropout": [0.0], "learning_rate": 0.02, "batch_size": 16, "epochs": 6}
    one = search.PartedNetwork(params, used, "y", F.col("split") == "train", 3, 42).advance(3).advance(100)
    [fitted] = fit_networks(used, "y", [params])
    assert one.rounds == 6 and one.best == pytest.approx(models.validation_f1(fitted, models.with_vector(
        rows.filter("split = 'val'"), "y"))) and one.best > 0.5
    seen, whole = [], search.epoch_pass
    monkeypatch.setattr(search, "HELD_ROWS", 200)
    monkeypatch.setattr(search, "epoch_pass", lambda df, *a: seen.append(df.count()) or whole(df, *a))
    trials = search.successive_halving(rows, "y", [{**params, "learning_rate": r} for r in (1e-5, 0.02, 0.03, 1e-4)],
                                       search.StagedNetwork, (2, 4), keep=2).collect()
    assert sorted((t.stage, t.rounds) for t in trials) == [(0, 2), (0, 2), (1, 4), (1, 4)]
    assert set(seen) == {700, 200} and seen.count(700) == 4 * 2 + 2 * 2 and seen.count(200) == 4 + 2
    network, table = models.search_networks(rows, "y", [params] * 4, stages=(2, 4))
    assert table.count() == 4 and network.sizes == [3, 8, 1]
