"""Centroid clustering of whole-number vectors of 64 components by bit planes.

A vector is stored as one 64-bit word per bit of its components: bit j of word p is bit p of component j, in two's
complement, so the top word counts negative. The dot product of two vectors is then a sum over pairs of words of
popcount(a AND b) times the words' weights, exact in integers, and so are squared distances. Tasks hold the centroids'
words (64 components each, ``k`` of them), and each gives one row of counts and sums per centroid and round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindmill.llm.common import read
from bindmill.session import durable

WIDTH = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
LIMIT = 1 << 27  # components beyond it could give distances beyond 64 bits
ROWS = 4096  # vectors compared at a time: their words stay in the processor's cache


def plane_count(low: int, high: int) -> int:
    """Words for components from ``low`` to ``high`` in two's complement."""
    return max(int(low).__invert__().bit_length() if low < 0 else 0, int(high).bit_length() if high > 0 else 0) + 1


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, 64) whole numbers -> (planes, rows) words."""
    bits = (values.astype(np.int64)[None] >> np.arange(planes)[:, None, None] & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little")).view("<u8")[:, :, 0].astype(np.uint64)


def from_planes(words: np.ndarray) -> np.ndarray:
    """(planes, rows) words -> (rows, 64) whole numbers."""
    parts = np.ascontiguousarray(words.astype("<u8"))[:, :, None].view(np.uint8)
    bits = np.unpackbits(parts, axis=2, bitorder="little").astype(np.int64)
    return np.tensordot(_weights(len(words)), bits, axes=1)


def _weights(planes: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def dots(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot products of every vector of ``words`` (planes, rows) with one vector ``other`` (planes)."""
    planes = len(words)
    by_power = np.zeros((2 * planes - 1, words.shape[1]), dtype=np.int16)  # at most planes * 64 each
    for p in range(planes):
        for q in range(planes):
            count = np.bitwise_count(words[p] & other[q])
            if (p == planes - 1) != (q == planes - 1):
                by_power[p + q] -= count
            else:
                by_power[p + q] += count
    total = np.zeros(words.shape[1], dtype=np.int64)
    for power in range(2 * planes - 1):
        total += by_power[power].astype(np.int64) << power
    return total


def squares(words: np.ndarray) -> np.ndarray:
    """Squared lengths of the vectors of ``words`` (planes, rows)."""
    weights, total = _weights(len(words)), np.zeros(words.shape[1], dtype=np.int64)
    for p in range(len(words)):
        for q in range(len(words)):
            total += weights[p] * weights[q] * np.bitwise_count(words[p] & words[q])
    return total


def nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and its squared distance, for words (planes, rows)."""
    own = to_planes(centroids, len(words))
    lengths = squares(own)
    chosen, best = [], []
    for at in range(0, words.shape[1], ROWS):
        part = np.ascontiguousarray(words[:, at:at + ROWS])
        length = squares(part)
        number = np.zeros(part.shape[1], dtype=np.int64)
        least = np.full(part.shape[1], np.iinfo(np.int64).max)
        for k in range(len(centroids)):
            distance = length + lengths[k] - 2 * dots(part, own[:, k])
            closer = distance < least
            number[closer], least[closer] = k, distance[closer]
        chosen.append(number)
        best.append(least)
    return np.concatenate(chosen), np.concatenate(best)


def whole_vectors(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down; null unless there are 64, all finite and of a size that is counted."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < LIMIT)
    ok = (F.size(vector) == WIDTH) & F.forall(vector, fits)
    return F.when(ok, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("int")))


def _words(column: pd.Series) -> np.ndarray:
    return np.ascontiguousarray(np.stack(column.to_numpy()).astype(np.int64).T).view(np.uint64)


def _step(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of every centroid's vectors; a centroid without vectors stays."""
    k = len(centroids)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for batch in batches:
            if len(batch):
                words = _words(batch["words"])
                cluster, _ = nearest(words, centroids)
                count += np.bincount(cluster, minlength=k)
                belongs = (cluster[None] == np.arange(k)[:, None]).astype(float)  # sums below 2^53: 10^4 rows of 2^27
                total += (belongs @ from_planes(words).astype(float)).astype(np.int64)
        there = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": there, "n": count[there], "total": list(total[there])})

    parts = stored.select("words").mapInPandas(add, "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(WIDTH)]
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row per centroid
        moved[row["cluster"]] = [row[f"s{j}"] // row["n"] for j in range(WIDTH)]
    return moved


def cluster_vectors(frame: DataFrame, key: str, vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
                    salt: str = "2:", scale: int = SCALE) -> DataFrame:
    """``frame`` without ``vector`` but with cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rows are left out whose vector has not 64 components or holds a null, a NaN, an infinity or a component of 2^27 or
    more after scaling. First centroids are the ``k`` rows (or all, if there are fewer) whose hash of ``salt`` and key
    is smallest; rows of one hash go by their components, a null key counts as an empty text. Equal centroids and ties
    of distance fall to the smaller number. Repeated rows count as often as they are there. New columns replace those
    of the same names.
    """
    new = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    kept = [c for c in frame.columns if c != vector and c.lower() not in new]
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    packed = frame.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                          F.sha2(F.concat(F.lit(salt), name), 256).alias("hash"),
                          whole_vectors(F.col(f"`{vector}`"), scale).alias("v")).where(F.col("v").isNotNull())
    start = packed.select("hash", "v").orderBy("hash", "v").limit(k).collect()  # k rows
    reach = packed.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    planes = plane_count(reach["low"] or 0, reach["high"] or 0)

    @F.pandas_udf("array<long>")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            words = to_planes(np.stack(batch.to_numpy()), planes).view(np.int64).T if len(batch) else []
            yield pd.Series(list(words), dtype=object)

    stored = durable(packed.select("row", pack("v").alias("words")))
    centroids = np.array([row["v"] for row in start], dtype=np.int64).reshape(-1, WIDTH)
    for _ in range(rounds if start else 0):
        centroids = _step(stored, centroids)

    @F.pandas_udf("cluster int, distance long")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, distance = nearest(_words(batch), centroids) if len(batch) else ([], [])
            yield pd.DataFrame({"cluster": number, "distance": distance})

    told = durable(stored.select("row", assign("words").alias("a")).select("row", "a.cluster", "a.distance"))
    sums = {r["cluster"]: r["s"] for r in told.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = F.array(*[F.struct(F.lit(sums.get(i, 0)).cast("long").alias("s"), F.lit(x).alias("name"))
                           for i, x in enumerate(names or [""])])
    own = F.get(by_cluster, F.col("cluster"))
    return told.select("row.*", "cluster", "distance", own["s"].alias("cluster_inertia"),
                       F.lit(sum(sums.values())).cast("long").alias("inertia"), own["name"].alias("centroid_sha256"))


def op12_bit_plane_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector of 64 components with its cluster, distance and the sums over its cluster and over all."""
    return cluster_vectors(read(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")


QUERIES = {"op12_bit_plane_clusters": op12_bit_plane_clusters}
ORACLES: dict[str, str] = {}
