"""Boosted trees over all train rows in one job, however many rounds they take.

A cluster-wide tree costs a job for every level, so a thousand rounds cost ten thousand jobs on a table of any size.
Here the rows are dealt into parts of about ``PART_ROWS`` rows (``MOST_PARTS`` parts at most, larger ones beyond that),
every part is boosted by itself with all of its rows, and the model is the parts' mean margin, weighted by rows. With
one part it is ordinary boosting over all rows. Bins come from a bounded sample, as the library's do; a task holds its
rows as one byte per feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from bindmill.operators import search

PART_ROWS = 65_536
MOST_PARTS = 16  # bounds the model, which every scoring task holds
EDGE_ROWS = 10_000  # rows that the bins are cut from


class PartedTrees:
    """Trees of all parts in flat arrays; a leaf is its own left child, and no bin is above its cut."""

    def __init__(self, edges: list[np.ndarray], params: dict, parts: list[tuple[int, list[tuple]]]) -> None:
        self.edges, self.depth = edges, params["maxDepth"]
        rows = max(1, sum(n for n, _ in parts))
        self.trees = [_flat(levels, n / rows * (params["stepSize"] if k else 1.0))
                      for n, trees in parts for k, levels in enumerate(trees)]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = _binned(self.edges, x), np.zeros(len(x))
        for tree in self.trees:
            out += _values(tree, bins, self.depth)
        return out

    def score(self, df: DataFrame, name: str = "predicted_proba", features: str = "features") -> DataFrame:
        """Adds the probability of class 1."""
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(rows: pd.Series) -> pd.Series:
            margins = held.value.margins(np.stack(rows.to_numpy())) if len(rows) else np.zeros(0)
            return pd.Series(np.exp(-np.logaddexp(0.0, -2 * margins)))

        return df.withColumn(name, probability(F.col(features).cast("array<double>")))


def _binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)


def _flat(levels: list[tuple], weight: float) -> tuple:
    """(feature, cut, left child, value) of all nodes; levels are (feature, cut, value)."""
    feature, cut, value = (np.concatenate([level[k] for level in levels]) for k in range(3))
    split = feature >= 0
    starts = np.cumsum([0] + [len(level[0]) for level in levels])
    left = np.arange(len(feature))
    for k, (own, _, _) in enumerate(levels):
        at = starts[k] + np.flatnonzero(own >= 0)
        left[at] = starts[k + 1] + 2 * np.arange(len(at))
    return (np.where(split, feature, 0).astype(np.int64), np.where(split, cut, 255).astype(np.uint8), left,
            value.astype(float) * weight)


def _values(tree: tuple, bins: np.ndarray, depth: int) -> np.ndarray:
    feature, cut, left, value = tree
    node, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins)) * bins.shape[1]
    flat = bins.ravel()
    for _ in range(depth):
        node = left[node] + (flat[row + feature[node]] > cut[node])
    return value[node]


def _boost(bins: np.ndarray, y: np.ndarray, edges: list[np.ndarray], params: dict, draw: np.random.Generator) -> list[tuple]:
    label, margin, trees = 2.0 * y - 1, np.zeros(len(y)), []
    for k in range(params["maxIter"]):
        target = 4 * label / (1 + np.exp(2 * label * margin)) if k else label
        levels = [(feature.astype(np.int32), cut.astype(np.uint8), value)
                  for feature, cut, _, value in search.grow(bins, target, edges, params, draw)]
        margin += _values(_flat(levels, params["stepSize"] if k else 1.0), bins, params["maxDepth"])
        trees.append(levels)
    return trees


def fit_parts(rows: DataFrame, label: str, candidates: list[dict], split: str = "split", train: str = "train",
              seed: int = 42, part_rows: int = PART_ROWS) -> list[PartedTrees]:
    """(features, label, split) -> the candidates' models, each over all train rows."""
    own = rows.where(F.col(split) == train).select(F.col("features").cast("array<double>").alias("x"),
                                                   F.col(label).cast("double").alias("y"))
    parts = max(1, min(MOST_PARTS, -(-own.count() // part_rows)))
    edges = [search._edges(c) for c in search.bounded_sample(rows, label, split, train, seed=seed, most=EDGE_ROWS)[0].T]

    def boost(number: int, params: dict):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read = [(_binned(edges, np.stack(b["x"].to_numpy())), b["y"].to_numpy(dtype=float)) for b in batches if len(b)]
            if read:
                bins, y = np.concatenate([b for b, _ in read]), np.concatenate([y for _, y in read])
                order = np.lexsort((y, *bins.T))  # the exchange gives rows in any order, draws must not
                draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
                trees = _boost(bins[order], y[order], edges, params, draw)
                yield pd.DataFrame({"number": [number], "part": [TaskContext.get().partitionId()], "n": [len(y)],
                                    "trees": [zlib.compress(cloudpickle.dumps(trees), 1)]})

        return run

    told = None
    for number, params in enumerate(candidates):
        fitted = own.repartition(parts).mapInPandas(boost(number, params), "number int, part int, n long, trees binary")
        told = fitted if told is None else told.union(fitted)
    found = sorted(told.collect(), key=lambda r: (r["number"], r["part"])) if candidates else []  # a row per model and part
    return [PartedTrees(edges, p, [(r["n"], cloudpickle.loads(zlib.decompress(r["trees"]))) for r in found if r["number"] == k])
            for k, p in enumerate(candidates)]
