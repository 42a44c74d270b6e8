"""Pair similarity: all pairs of exact-size seeded samples, and near-duplicate pairs of whole tables.

All pairs are scored only inside a sample whose size is a parameter. Its rows are dealt into blocks by hash, blocks meet
by an ordinary join, and scores are counted inside the task that computes them, so pair rows never leave it.

Near-duplicate pairs are searched over every row: rows that share a band of hashes meet, crowded bands in tiles of
bounded size, pairs that a sketch does not rule out are scored exactly. Equal rows are one node, so their pairs are a
count and not rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from bindmill.operators.dedup import exact_sample
from bindmill.session import durable

BLOCK = 128  # rows per block, on average
SCORE_DIGITS = 6
FINGERPRINT_BITS = 2048
MISSED = 1e-4  # chance that a pair right at the limit shares no band
VECTOR_BITS, SET_ROWS = 18, 5  # signs, or least hashes, in a band
SKETCH = 126  # bits of a sketch, in two numbers
SKETCH_SLACK = 5.5  # standard deviations below the agreement of a pair right at the limit
TILE = 1000  # members of a band that are held against each other under one join key
TASK_PAIRS = 20_000  # pairs that are scored in one call, on average
BATCH = 400  # sets whose signatures are made together


def with_fingerprint(df: DataFrame, text: str, name: str = "bits", k: int = 2,
                     bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Adds the set bits of a hashed fingerprint of the distinct word k-grams of a whole text."""
    rows = df.withColumn("_words", F.split(F.lower(F.col(text)), r"\s+"))
    count = F.greatest(F.size("_words") - (k - 1), F.lit(0))
    grams = F.slice("_words", 1, count)
    for shift in range(1, k):
        grams = F.zip_with(grams, F.slice("_words", shift + 1, count), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.withColumn("_grams", F.array_distinct(grams))
    hashed = F.transform("_grams", lambda g: F.conv(F.substring(F.md5(g), 1, 6), 16, 10).cast("int") % bits)
    return rows.withColumn(name, F.array_sort(F.array_distinct(hashed))).drop("_words", "_grams")


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def unit(m: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length == 0, 1.0, length)

    return unit(a) @ unit(b).T


def _tanimoto(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shared = a @ b.T
    either = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - shared
    return np.where(either == 0, 1.0, shared / np.where(either == 0, 1.0, either))


def _dense(values: list, bits: int | None) -> np.ndarray:
    if bits is None:
        return np.array([np.asarray(v, dtype=np.float64) for v in values])
    rows = np.zeros((len(values), bits))
    for i, on in enumerate(values):
        rows[i, np.asarray(on, dtype=int)] = 1.0
    return rows


def pair_scores(df: DataFrame, key: str, vector: str, sample: int, seed: int = 42,
                bits: int | None = None) -> DataFrame:
    """(score, n): how many unordered pairs of the sample have each rounded score.

    Cosine of dense vectors, or Tanimoto of set-bit arrays when ``bits`` is given.
    The sample is cut into blocks; each block meets each later block once.
    """
    rows = exact_sample(df, key, sample, seed).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    n_blocks = max(1, math.ceil(sample / BLOCK))
    block = F.pmod(F.xxhash64("k"), F.lit(n_blocks)).cast("int")
    blocks = durable(rows.groupBy(block.alias("block")).agg(F.collect_list("v").alias("left")))
    partners = blocks.select("block", "left", F.explode(F.sequence("block", F.lit(n_blocks - 1))).alias("partner"))
    meeting = partners.join(blocks.select(F.col("block").alias("partner"), F.col("left").alias("right")),
                            "partner").repartition("block", "partner")
    score = _tanimoto if bits else _cosine

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                scores = score(_dense(row.left, bits), _dense(row.right, bits))
                if row.block == row.partner:
                    scores = scores[np.triu_indices(len(scores), k=1)]
                values, counts = np.unique(np.round(scores.ravel(), SCORE_DIGITS) + 0.0, return_counts=True)
                yield pd.DataFrame({"score": values, "n": counts})

    counted = meeting.select("block", "partner", "left", "right").mapInPandas(count, "score double, n long")
    return durable(counted.groupBy("score").agg(F.sum("n").alias("n")))


def pair_summary(scores: DataFrame, limits: tuple[float, ...]) -> DataFrame:
    """Pairs, median score, and per limit the share above it and the ordered-pair count above it.

    Six decimals leave at most two million distinct scores, so the built-in percentile is bounded.
    """
    total = F.sum("n")

    def tag(limit: float) -> str:
        return f"{int(round(limit * 100)):02d}"

    above = {limit: F.coalesce(F.sum(F.when(F.col("score") > limit, F.col("n"))), F.lit(0)) for limit in limits}
    return scores.agg(
        total.alias("n_pairs"), F.percentile("score", F.lit(0.5), F.col("n")).alias("median_score"),
        *[(n / total).alias(f"share_above_{tag(limit)}") for limit, n in above.items()],
        *[(2 * n).alias(f"ordered_above_{tag(limit)}") for limit, n in above.items()],
    )


SIGNATURE = T.StructType().add("bands", T.ArrayType(T.LongType())).add("low", "long").add("high", "long")


def _n_bands(agree: float, rows: int) -> int:
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-agree ** rows)))


def _packed(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.int64) << np.arange(bits.shape[1])).sum(axis=1)


def _signatures(bands: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
    half = SKETCH // 2
    return pd.DataFrame({"bands": bands.tolist(), "low": _packed(bits[:, :half]), "high": _packed(bits[:, half:SKETCH])})


def sign_agreement(limit: float) -> float:
    return 1 - math.acos(limit) / math.pi


def band_bits(rows: int) -> int:
    """Signs in a band so that unlike vectors of a table of so many rows seldom share one."""
    return max(VECTOR_BITS - 2, math.ceil(math.log2(max(rows, 1))) + 3)


def vector_signature(limit: float, seed: int, bits: int = VECTOR_BITS):
    """Bands of ``bits`` signs of random projections, and a sketch of further signs."""
    n_bands = _n_bands(sign_agreement(limit), bits)

    @F.pandas_udf(SIGNATURE)
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for values in batches:
            length = values.map(len)
            parts = []
            for n, same in values.groupby(length):
                if n not in planes:
                    planes[n] = np.random.default_rng((seed, n)).normal(size=(n, n_bands * bits + SKETCH))
                x = np.stack(same.to_numpy()).astype(np.float64)
                # of unit length, which changes no sign but keeps sums finite
                signs = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes[n] > 0
                numbers = _packed(signs[:, :-SKETCH].reshape(-1, bits)).reshape(len(x), n_bands)
                part = _signatures(numbers | np.arange(n_bands) << bits, signs[:, -SKETCH:])
                parts.append(part.set_index(same.index))
            yield pd.concat(parts).loc[values.index] if parts else pd.DataFrame(columns=["bands", "low", "high"])

    return signature


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def set_signature(limit: float, seed: int):
    """Bands of least hashes, and a sketch of one bit of each of ``SKETCH`` least hashes. Sets are not empty."""
    n_bands = _n_bands(limit, SET_ROWS)
    size = max(SKETCH, n_bands * SET_ROWS)
    salts = np.random.default_rng(seed).integers(1, 1 << 63, size=size, dtype=np.uint64)

    def least(sets: list[np.ndarray]) -> np.ndarray:
        every = _mix(np.concatenate(sets).astype(np.int64).view(np.uint64))
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        with np.errstate(over="ignore"):
            return np.stack([np.minimum.reduceat(_mix(every + salt), starts) for salt in salts], axis=1)

    def signed(sets: list[np.ndarray]) -> pd.DataFrame:
        if not sets:
            return pd.DataFrame(columns=["bands", "low", "high"])
        found = least(sets)
        folded = np.tile(np.arange(n_bands, dtype=np.uint64), (len(sets), 1))
        for k in range(SET_ROWS):
            with np.errstate(over="ignore"):
                folded = _mix(folded * np.uint64(3) + found[:, k:n_bands * SET_ROWS:SET_ROWS])
        return _signatures(folded.view(np.int64), found[:, :SKETCH] & np.uint64(1))

    @F.pandas_udf(SIGNATURE)
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            parts = [signed(values.iloc[k:k + BATCH].tolist()) for k in range(0, max(len(values), 1), BATCH)]
            yield pd.concat(parts, ignore_index=True)

    return signature


def least_agreement(agree: float) -> int:
    """Bits of two sketches that agree at least, for a pair whose bits agree with the given chance."""
    return math.floor(SKETCH * agree - SKETCH_SLACK * math.sqrt(SKETCH * agree * (1 - agree)))


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, SCORE_DIGITS)


def _candidates(signed: DataFrame, agree: float) -> DataFrame:
    """(key, bands, low, high) -> a, b, at: pairs that share a band and whose sketches agree, with one place they met."""
    members = signed.select("key", "low", "high", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(
        "band", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    dealt = durable(members.join(sizes, "band").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    left = dealt.select("band", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("parts") - 1)).alias("j"),
                        F.col("key").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    right = dealt.select("band", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"),
                         F.col("key").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    least = least_agreement(agree)
    differ = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b")))
    met = left.join(right, ["band", "i", "j"]).where(
        ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & (differ <= SKETCH - least))
    return durable(met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min(F.struct("band", "i", "j")).alias("at")))


def cosines(left: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    same = np.array([len(r) == len(left) for r in right])
    out = np.zeros(len(right))
    if same.any():
        out[same] = _cosine(np.asarray(left, dtype=np.float64)[None, :],
                            np.array([r for r in right if len(r) == len(left)], dtype=np.float64))[0]
    return out


def overlaps(left: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Shares of common elements of sorted sets."""
    out = np.zeros(len(right))
    for k, other in enumerate(right):
        x, y = (left, other) if len(left) < len(other) else (other, left)
        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        out[k] = common / (len(x) + len(y) - common)
    return out


def _near_pairs(nodes: DataFrame, signature, agree: float, limit: float, score) -> DataFrame:
    """(key, n, v) -> a, b, n_pairs, score of the pairs above the limit; a row with a = b stands for equal rows.

    Pairs that met in one tile are scored in one task, to which every value goes once.
    """
    nodes = durable(nodes)
    pairs = _candidates(durable(nodes.select("key", signature("v").alias("s")).select("key", "s.*")), agree)
    tasks = max(1, math.ceil(pairs.count() / TASK_PAIRS))
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64("at"), F.lit(tasks)))
    left = pairs.groupBy("task", "a").agg(F.collect_list("b").alias("others")).join(
        nodes.select(F.col("key").alias("a"), "n", "v"), "a")
    right = pairs.select("task", "b").distinct().join(nodes.select(F.col("key").alias("b"), "n", "v"), "b")
    right = right.toDF(*right.columns)  # columns of its own, as both sides read one table
    kind = nodes.schema["key"].dataType
    schema = T.StructType().add("a", kind).add("b", kind).add("n_pairs", "long").add("score", "double")

    def scored(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        values, counts = dict(zip(y["b"], y["v"])), dict(zip(y["b"], y["n"]))
        rows = []
        for row in x.itertuples(index=False):
            scores = rounded(score(row.v, [values[b] for b in row.others]))
            rows += [(row.a, b, row.n * counts[b], s) for b, s in zip(row.others, scores) if s > limit]
        return pd.DataFrame(rows, columns=["a", "b", "n_pairs", "score"])

    apart = left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(scored, schema)
    equal = nodes.where("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"),
                                        F.expr("n * (n - 1) div 2").alias("n_pairs"), F.lit(1.0).alias("score"))
    return apart.unionByName(equal)


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the rows with a key and a vector that has a cosine."""
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("key").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def worded_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words) of the rows with a key and a word."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    return df.select(F.col(key).alias("key"), words.alias("words")).where("key is not null and size(words) > 0")


def near_duplicate_vectors(df: DataFrame, key: str, vector: str, limit: float = 0.95, seed: int = 42) -> DataFrame:
    """(a, b, n_pairs, score): pairs of all rows whose cosine, rounded to six decimals, is above ``limit``.

    ``a`` and ``b`` are the smallest keys of equal vectors, n_pairs counts the pairs of rows. Vectors that are null, of
    length zero or with an element that is no finite number have no cosine and are left out, as are null keys.
    """
    rows = usable_vectors(df, key, vector)
    nodes = rows.groupBy("v").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    return _near_pairs(nodes, vector_signature(limit, seed), sign_agreement(limit), limit, cosines)


def gram_set(words: str, k: int):
    """Sorted 64-bit hashes of the distinct k-grams of a word array; fewer than k words are one gram."""
    count = F.greatest(F.size(words) - (k - 1), F.least(F.size(words), F.lit(1)))
    grams = F.slice(words, 1, count)
    for shift in range(1, k):
        grams = F.zip_with(grams, F.slice(words, shift + 1, count), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))))


def near_duplicate_texts(df: DataFrame, key: str, text: str, limit: float = 0.8, k: int = 2, seed: int = 42) -> DataFrame:
    """(a, b, n_pairs, score): pairs of all texts whose sets of word k-grams overlap (Tanimoto) above ``limit``.

    ``a`` and ``b`` are the smallest keys of texts with the same words, n_pairs counts the pairs of rows. Texts without
    words and null keys are left out. Sets are of 64-bit hashes, as a fingerprint of 2,048 bits is full on long texts.
    """
    rows = worded_texts(df, key, text)
    same = rows.groupBy(F.unhex(F.md5(F.array_join("words", " "))).alias("same")).agg(
        F.min("key").alias("key"), F.count("*").alias("n"))
    nodes = same.join(rows, "key").select("key", "n", gram_set("words", k).alias("v"))
    return _near_pairs(nodes, set_signature(limit, seed), (1 + limit) / 2, limit, overlaps)
