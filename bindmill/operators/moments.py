"""Means, variances and products of many columns from one scan.

A task adds up one block of numbers for all rows it reads: how often two positions are both there, and the sums, squares
and products of their values. Blocks are exchanged once, a row per pair of positions and task, and added. Values are
taken relative to a pivot, the mean of a few rows, so large means cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PIVOT_ROWS = 20
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of a column of arrays; missing vectors, positions and elements are NaN."""
    out = np.full((len(column), width), np.nan)
    for i, row in enumerate(column):
        if row is not None:
            values = np.asarray(row, dtype=float)[:width]
            out[i, :len(values)] = values
    return out


def _stacked(column: pd.Series) -> np.ndarray:
    lengths = {-1 if row is None else len(row) for row in column}
    if len(lengths) == 1 and -1 not in lengths:
        return np.stack(column.to_numpy()).astype(float)
    return _matrix(column, max(lengths, default=0))


def _pivot(df: DataFrame, vector: str) -> np.ndarray:
    """Per position the mean of the values of a few rows."""
    rows = [r[0] for r in df.select(vector).where(F.col(vector).isNotNull()).head(PIVOT_ROWS)]
    values = _matrix(pd.Series(rows, dtype=object), max(map(len, rows), default=0))
    there = np.isfinite(values)
    return np.where(there, values, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)


def pair_sums(df: DataFrame, vector: str, against: str = "all") -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, px, py) of the positions i <= j of a column of arrays of doubles.

    Sums run over the rows where both are present, of values minus the pivots px and py; null and NaN elements are
    missing, and so are positions behind the end of a vector. ``against`` is ``all`` pairs, ``self`` (i = j only) or
    ``first`` (j = 0: every position with the first one).
    """
    pivot = _pivot(df, vector)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            x = _stacked(batch["v"])
            x = x - np.pad(pivot, (0, max(0, x.shape[1] - len(pivot))))[:x.shape[1]]
            here = (~np.isnan(x)).astype(float)
            x = np.where(here > 0, x, 0.0)
            if against == "all":
                mine, squares = [here.T @ here, x.T @ here, here.T @ x], (x * x).T @ here
                mine += [squares, squares.T, x.T @ x]
            else:
                y, there = (x[:, :1], here[:, :1]) if against == "first" else (x, here)
                both = here * there
                mine = [both.sum(0), (x * both).sum(0), (y * both).sum(0), (x * x * both).sum(0), (y * y * both).sum(0),
                        (x * y).sum(0)]
                mine = [m[None, :] for m in mine]
            if total is None:
                total = mine
            else:
                height = max(total[0].shape[0], mine[0].shape[0])
                width = max(total[0].shape[1], mine[0].shape[1])
                total = [np.pad(t, ((0, height - t.shape[0]), (0, width - t.shape[1])))
                         + np.pad(m, ((0, height - m.shape[0]), (0, width - m.shape[1]))) for t, m in zip(total, mine)]
        if total is not None and total[0].size:
            if against == "all":
                i, j = np.triu_indices(len(total[0]))
                values = [t[i, j] for t in total]
            else:
                i = np.arange(total[0].shape[1])
                j, values = i if against == "self" else 0 * i, [t[0] for t in total]
            yield pd.DataFrame({"i": i, "j": j, **dict(zip(SUMS, values))})

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    added = df.select(F.col(vector).alias("v")).mapInPandas(add, schema).groupBy("i", "j").agg(
        *[F.sum(s).alias(s) for s in SUMS])
    pivots = F.array(*[F.lit(float(p)) for p in pivot]).cast("array<double>")
    return added.withColumns({"n": F.col("n").cast("long"), "px": F.coalesce(F.get(pivots, F.col("i")), F.lit(0.0)),
                              "py": F.coalesce(F.get(pivots, F.col("j")), F.lit(0.0))})


def mean(side: str = "x") -> Column:
    return F.when(F.col("n") > 0, F.col(f"p{side}") + F.col(f"s{side}") / F.col("n"))


def squares_about_mean(side: str = "x") -> Column:
    """Sum of squares about the mean, not below zero."""
    return F.greatest(F.col(f"s{side}{side}") - F.col(f"s{side}") ** 2 / F.col("n"), F.lit(0.0))


def variance(sample: bool, side: str = "x") -> Column:
    """Null without rows, and for samples of one row."""
    return F.when(F.col("n") > int(sample), squares_about_mean(side) / (F.col("n") - int(sample)))


def correlation() -> Column:
    """Pearson's r; NaN where a side is constant, null for fewer than two rows."""
    product = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = F.sqrt(squares_about_mean("x")) * F.sqrt(squares_about_mean("y"))
    return F.when(F.col("n") > 1, F.when(spread > 0, product / F.when(spread > 0, spread)).otherwise(F.lit(float("nan"))))


def as_vector(df: DataFrame, columns: list[str], name: str = "v") -> DataFrame:
    return df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias(name))


def segment_means(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of each key's vectors, position by position; missing elements are left out of it.

    A task adds up each batch by key, so a row per batch and key is exchanged; the sums of a key then stand together
    and are added as they come. Vectors may differ in length; rows without key or vector are left out.
    """
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes, keys = pd.factorize(batch["key"], use_na_sentinel=False)
                order = np.argsort(codes, kind="stable")
                x = _stacked(batch["v"])[order]
                starts = np.searchsorted(codes[order], np.arange(len(keys)))
                here = ~np.isnan(x)
                yield pd.DataFrame({"key": keys, "n": list(np.add.reduceat(here.astype(float), starts, axis=0)),
                                    "s": list(np.add.reduceat(np.where(here, x, 0.0), starts, axis=0))})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, s, done = None, np.zeros(0), np.zeros(0), {"key": [], "v": []}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if key is not None and row.key != key:
                    done["key"].append(key), done["v"].append(_mean(n, s))
                    n, s = np.zeros(0), np.zeros(0)
                width = max(len(n), len(row.n))
                n, s = (np.pad(a, (0, width - len(a))) + np.pad(b, (0, width - len(b))) for a, b in ((n, row.n), (s, row.s)))
                key = row.key
            yield pd.DataFrame(done)
            done = {"key": [], "v": []}
        if key is not None:
            yield pd.DataFrame({"key": [key], "v": [_mean(n, s)]})

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"),
                                                                              F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["key"].dataType.simpleString()
    parts = rows.mapInPandas(add, f"key {kind}, n array<double>, s array<double>")
    means = parts.repartition("key").sortWithinPartitions("key").mapInPandas(merge, f"key {kind}, v array<double>")
    return means.select(F.col("key").alias(key), F.transform("v", lambda x: F.when(~F.isnan(x), x)).alias(vector))


def _mean(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(n > 0, s / np.maximum(n, 1.0), np.nan)
