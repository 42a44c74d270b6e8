"""Choice of model parameters by successive halving.

Candidates are rows of a Spark table: a task trains its candidates for a few more rounds or epochs, and the best ones
go on from where they were. Training there is staged: a candidate's score is the best validation F1 of any of its
stages, so how many rounds to use costs no search of its own. The last candidates are then fitted on all training rows
(``models``).

Networks are trained on all train rows and scored on all validation rows at every stage: every task holds them while
they are at most ``HELD_ROWS`` and ``SAMPLE_BYTES`` a split, else an epoch of a network is a pass over the table in
parts of ``HELD_ROWS`` rows. Trees are searched on an exact sample, drawn by hash and bounded by ``SAMPLE_ROWS`` and
``SAMPLE_BYTES``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from bindmill.operators.networks import EarlyStop, Network, epoch_pass
from bindmill.session import durable

SAMPLE_ROWS = 4096  # of the train split, and as many of the validation split, that trees are searched on
HELD_ROWS = 131_072  # of a split that every task may hold, and of a part of larger tables
SAMPLE_BYTES = 32 << 20
KEEP = 4  # one in so many candidates goes on
TREE_STAGES = (20, 100, 400, 1000)
NETWORK_STAGES = (5, 20, 60, 150)
BINS = 32


def f1(said: np.ndarray, label: np.ndarray) -> float:
    hits = float((said & (label == 1)).sum())
    total = float(said.sum() + (label == 1).sum())
    return 2 * hits / total if total else 0.0


class StagedTrees:
    """Boosted regression trees on the logistic loss, one more tree a round; a stage is a number of trees.

    As the tree classifier that is fitted on all rows: labels are -1 and 1, the first tree fits them, later ones the
    loss's gradient; splits lower the squared error most, between bins cut at quantiles.
    """

    def __init__(self, params: dict, train: tuple, validation: tuple, seed: int) -> None:
        self.params, self.draw = params, np.random.default_rng(seed)
        self.edges = [_edges(column) for column in train[0].T]
        self.label = 2.0 * train[1] - 1
        self.margin, self.val_margin = np.zeros(len(train[1])), np.zeros(len(validation[1]))
        self.rounds, self.best, self.best_rounds = 0, -1.0, 0

    def advance(self, rounds: int, train: tuple, validation: tuple) -> None:
        bins, val_bins = (np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
                          for x in (train[0], validation[0]))
        for _ in range(self.rounds, min(rounds, self.params["maxIter"])):
            target = self.label if not self.rounds else 4 * self.label / (1 + np.exp(2 * self.label * self.margin))
            weight = 1.0 if not self.rounds else self.params["stepSize"]
            tree = grow(bins, target, self.edges, self.params, self.draw)
            self.margin += weight * _leaves(tree, bins)
            self.val_margin += weight * _leaves(tree, val_bins)
            self.rounds += 1
            score = f1(self.val_margin > 0, validation[1])
            if score > self.best:
                self.best, self.best_rounds = score, self.rounds


def grow(bins: np.ndarray, target: np.ndarray, edges: list[np.ndarray], params: dict, draw: np.random.Generator) -> list[tuple]:
    """Levels of (feature, bin, left child, value) per node; feature -1 is a leaf."""
    rate, least = params.get("subsamplingRate", 1.0), params.get("minInstancesPerNode", 1)
    used = np.flatnonzero(draw.random(len(target)) < rate) if rate < 1 else np.arange(len(target))
    x, t, d = bins[used], target[used], bins.shape[1]
    share = max(1, int(np.ceil(params.get("featureShare", 1.0) * d)))
    width = max((len(e) for e in edges), default=0) + 1
    node, n_nodes, levels = np.zeros(len(used), dtype=np.int64), 1, []
    for depth in range(params["maxDepth"] + 1):
        count = np.bincount(node, minlength=n_nodes).astype(float)
        total = np.bincount(node, weights=t, minlength=n_nodes)
        value = total / np.maximum(count, 1)
        feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes, dtype=np.int64)
        if depth < params["maxDepth"] and len(used):
            place = ((node[:, None] * d + np.arange(d)) * width + x).ravel()
            shape, size = (n_nodes, d, width), n_nodes * d * width
            left_n = np.cumsum(np.bincount(place, minlength=size).reshape(shape), axis=2).astype(float)
            left_s = np.cumsum(np.bincount(place, weights=np.repeat(t, d), minlength=size).reshape(shape), axis=2)
            right_n, right_s = count[:, None, None] - left_n, total[:, None, None] - left_s
            gain = (left_s ** 2 / np.maximum(left_n, 1) + right_s ** 2 / np.maximum(right_n, 1)
                    - (total ** 2 / np.maximum(count, 1))[:, None, None])
            gain[(left_n < least) | (right_n < least)] = -np.inf
            if share < d:
                order = np.argsort(draw.random((n_nodes, d)), axis=1)
                gain[np.arange(n_nodes)[:, None], order[:, share:]] = -np.inf
            flat = gain.reshape(n_nodes, -1)
            best = flat.argmax(axis=1)
            found = flat[np.arange(n_nodes), best] > 1e-12
            feature = np.where(found, best // width, -1)
            cut = best % width
        split = feature >= 0
        children = np.cumsum(split) * 2 - 2  # number of the left child in the next level
        levels.append((feature, cut, children, value))
        if not split.any():
            break
        go = split[node]
        x, t, node = x[go], t[go], node[go]
        right = x[np.arange(len(x)), feature[node]] > cut[node]
        node, n_nodes = children[node] + right, 2 * int(split.sum())
    return levels


def _edges(column: np.ndarray) -> np.ndarray:
    """Thresholds between bins: halfway between values, at quantiles where there are more values than bins."""
    values, counts = np.unique(column, return_counts=True)
    if len(values) > BINS:
        stride = counts.sum() / BINS
        reached = np.floor(np.cumsum(counts) / stride)
        kept = np.flatnonzero(np.diff(reached) > 0)
        return (values[kept] + values[kept + 1]) / 2
    return (values[:-1] + values[1:]) / 2


def _leaves(levels: list[tuple], bins: np.ndarray) -> np.ndarray:
    node, out, rows = np.zeros(len(bins), dtype=np.int64), np.zeros(len(bins)), np.arange(len(bins))
    for feature, cut, children, value in levels:
        leaf = feature[node] < 0
        out[rows[leaf]] = value[node[leaf]]
        rows, node = rows[~leaf], node[~leaf]
        node = children[node] + (bins[rows, feature[node]] > cut[node])
    return out


class StagedNetwork:
    """A feed-forward network, one more epoch a round; the score is that of its least validation loss."""

    def __init__(self, params: dict, train: tuple, validation: tuple, seed: int) -> None:
        self.network, self.stop, self.draw = Network(params, train[0].shape[1], seed), EarlyStop(), np.random.default_rng(seed)
        self.rounds, self.best, self.best_rounds = 0, -1.0, 0

    def advance(self, rounds: int, train: tuple, validation: tuple) -> None:
        for _ in range(self.rounds, min(rounds, self.network.params["epochs"])):
            if self.stop.done:
                break
            self.network.train(*train, self.draw)
            self.rounds += 1
            self.stop.see(self.network.loss(*validation), np.zeros(0))  # only the score of the best state is needed
            if self.stop.wait == 0:
                self.best, self.best_rounds = f1(self.network.logits(validation[0]) > 0, validation[1]), self.rounds


class PartedNetwork:
    """As ``StagedNetwork``, with an epoch as a pass over a table; tasks' states are averaged (``networks``)."""

    def __init__(self, params: dict, rows: DataFrame, label: str, is_train: Column, n_features: int, seed: int) -> None:
        self.network, self.stop, self.seed = Network(params, n_features, seed), EarlyStop(), seed
        self.rows, self.label, self.is_train = rows, label, is_train
        self.rounds, self.best, self.best_rounds, self.seen = 0, -1.0, 0, 0

    def _pass(self, rows: DataFrame) -> np.ndarray:
        """The next state; notes how good the present one is."""
        told = epoch_pass(rows, {0: self.network}, self.is_train, self.label, self.seed + self.rounds)
        state, loss, score = told.get(0, (self.network.state(), 0.0, 0.0))
        if self.seen < self.rounds:
            self.seen = self.rounds
            self.stop.see(loss, np.zeros(0))
            if self.stop.wait == 0:
                self.best, self.best_rounds = score, self.rounds
        return state

    def advance(self, rounds: int) -> PartedNetwork:
        while not self.stop.done and self.rounds < min(rounds, self.network.params["epochs"]):
            state = self._pass(self.rows)
            if not self.stop.done:
                self.network.load(state)
                self.rounds += 1
        if self.seen < self.rounds:
            self._pass(self.rows.where(~self.is_train))
        return self


def bounded_sample(rows: DataFrame, label: str, split: str, part: str, features: str = "features", seed: int = 42,
                   most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` rows of a split, the ones with the smallest hash of their content."""
    own = rows.where(F.col(split) == part).select(F.col(features).cast("array<double>").alias("x"),
                                                  F.col(label).cast("double").alias("y"))
    first = own.select(F.size("x").alias("n")).first()
    if first is None:
        return np.zeros((0, 1)), np.zeros(0)
    most = max(1, min(most, SAMPLE_BYTES // (8 * max(first["n"], 1))))
    taken = own.orderBy(F.xxhash64("x", "y", F.lit(seed)), "x", "y").limit(most).collect()
    return np.array([r["x"] for r in taken], dtype=float), np.array([r["y"] for r in taken])


def successive_halving(rows: DataFrame, label: str, candidates: list[dict], staged: Callable, stages: tuple[int, ...],
                       split: str = "split", keep: int = KEEP, seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """trial, params (JSON), rounds, best_rounds, f1, stage: how far every candidate came.

    After a stage one in ``keep`` candidates goes on, at least one; equal ones by their number. Trained states are
    kept in a stored table between stages, so a lost executor repeats one stage of its candidates only. Networks are
    trained and scored on all rows; ``sample_rows`` of each split are what trees are searched on.
    """
    if staged is StagedNetwork:
        used = rows.where(F.col(split).isin("train", "val"))
        told = used.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")).collect()
        sizes, width = [r["n"] for r in told], max([r["width"] or 1 for r in told], default=1)
        sample_rows = min(HELD_ROWS, SAMPLE_BYTES // (8 * max(width, 1)))
        if max(sizes, default=0) > sample_rows:
            stored = durable(used.repartition(-(-sum(sizes) // HELD_ROWS)))
            return _halving_in_parts(stored, label, candidates, stages, F.col(split) == "train", width, keep, seed)
    spark = rows.sparkSession
    train, validation = (bounded_sample(rows, label, split, part, seed=seed, most=sample_rows) for part in ("train", "val"))
    held = spark.sparkContext.broadcast((train, validation))  # at most twice SAMPLE_BYTES
    trials = [(i, json.dumps(p), None) for i, p in enumerate(candidates)]
    state = spark.createDataFrame(trials, "trial int, params string, state binary")
    schema = "trial int, params string, rounds int, best_rounds int, f1 double, state binary"
    done, slots = [], max(1, spark.sparkContext.defaultParallelism)

    def advance_to(rounds: int) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            given = held.value
            for batch in batches:
                for row in batch.itertuples(index=False):
                    model = cloudpickle.loads(row.state) if row.state else staged(json.loads(row.params), *given, seed)
                    model.advance(rounds, *given)
                    yield pd.DataFrame({"trial": [row.trial], "params": [row.params], "rounds": [model.rounds],
                                        "best_rounds": [model.best_rounds], "f1": [model.best],
                                        "state": [cloudpickle.dumps(model)]})

        return run

    left = len(candidates)
    for k, rounds in enumerate(stages):
        dealt = state.repartition(min(left, 4 * slots), F.xxhash64("trial", F.lit(k)))
        told = durable(dealt.mapInPandas(advance_to(rounds), schema))
        ranked = told.select("trial", "f1", "rounds").orderBy(F.desc("f1"), "trial").collect()  # a row per candidate
        left = len(ranked) if k == len(stages) - 1 else max(1, left // keep)
        on = [r["trial"] for r in ranked[:left]] if k < len(stages) - 1 else []
        done.append(told.where(~F.col("trial").isin(on)).drop("state").withColumn("stage", F.lit(k)))
        state = told.where(F.col("trial").isin(on)).select("trial", "params", "state")
    table = done[0]
    for other in done[1:]:
        table = table.unionByName(other)
    return table


def _halving_in_parts(rows: DataFrame, label: str, candidates: list[dict], stages: tuple[int, ...], is_train: Column,
                      n_features: int, keep: int, seed: int) -> DataFrame:
    """The halving of networks over rows that no task holds; networks wait at the driver between passes."""
    spark = rows.sparkSession
    on = {i: PartedNetwork(p, rows, label, is_train, n_features, seed) for i, p in enumerate(candidates)}
    at_once, done = -(-spark.sparkContext.defaultParallelism // rows.rdd.getNumPartitions()) + 1, []
    for k, rounds in enumerate(stages):
        with ThreadPool(at_once) as pool:
            pool.map(inheritable_thread_target(spark)(lambda model: model.advance(rounds)), on.values(), chunksize=1)
        ranked = sorted(on, key=lambda i: (-on[i].best, i))
        stay = set(ranked[:max(1, len(ranked) // keep)]) if k < len(stages) - 1 else set()
        done += [(i, json.dumps(candidates[i]), m.rounds, m.best_rounds, m.best, k) for i, m in on.items() if i not in stay]
        on = {i: m for i, m in on.items() if i in stay}
    return spark.createDataFrame(done, "trial int, params string, rounds int, best_rounds int, f1 double, stage int")
