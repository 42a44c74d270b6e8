"""Quality classifier: a factorisation machine over hashed words, structure statistics and document metadata.

The score is the logistic of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``. The pairs cost linear time, as they
equal half of ``(sum v_i x_i)^2 - sum (v_i x_i)^2``, summed over the factors. Statistics and metadata (size, number of
lines) enter as one feature per range, words by a hashed number, scaled to length one. The machine is fitted on a
bounded sample of labelled rows and then scores every whole text where it lies, without an exchange.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindmill.llm.common import read

SAMPLE = 8_000  # labelled rows to fit on, at most
WORD_BITS = 14
FACTORS = 8
EPOCHS = 8
BATCH = 128
LEAST_STEPS = 400  # few labelled rows are gone through more often
RATE = 0.08
DECAY = 1e-4
SEED = 11
THRESHOLD = 0.3
FOLDS = 5
EDGES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95])
RANGES = len(EDGES) + 1
STATISTICS = 14
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The signs that are counted together.
SIGNS, STOPS = b"#*$%&<>@^~{}[]=+\\_/", b".,;:?'\"()-"


def statistics(text: str, words: list[str], counts: Counter) -> np.ndarray:
    """Shares in 0..1 that describe how a text is built, the size and the number of lines among them."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, n_words = max(1, int(raw.sum())), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    most = sorted(counts.values(), reverse=True)[:3]
    return np.array([
        raw[65:91].sum() / letters, raw[48:58].sum() / n, sum(raw[c] for c in SIGNS) / n, raw[124] / n, raw[33] / n,
        sum(raw[c] for c in STOPS) / n, raw[128:].sum() / n, min(1.0, n / n_words / 20), len(counts) / n_words,
        (most[0] if most else 0) / n_words, sum(most) / n_words, 1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log2(n) / 20), min(1.0, np.log2(1 + len(lines)) / 12)])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features of a text."""
    text = text or ""
    words = WORD.findall(text)
    counts = Counter(words)
    levels = np.searchsorted(EDGES, statistics(text, words, counts), "right")
    fixed = np.arange(STATISTICS) * RANGES + levels
    hashed = np.fromiter((crc32(w.lower().encode("utf-8", "replace")) for w in counts), np.int64, len(counts))
    hashed = np.unique(hashed & ((1 << WORD_BITS) - 1)) + STATISTICS * RANGES
    values = np.concatenate([np.ones(len(fixed)), np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed))))])
    return np.concatenate([fixed, hashed]), values


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self) -> None:
        size = STATISTICS * RANGES + (1 << WORD_BITS)
        rng = np.random.default_rng(SEED)
        self.bias, self.weights = 0.0, np.zeros(size)
        self.factors = rng.normal(0, 0.02, (size, FACTORS))

    def raw(self, numbers: np.ndarray, values: np.ndarray) -> float:
        scaled = self.factors[numbers] * values[:, None]
        pairs = (scaled.sum(axis=0) ** 2 - (scaled ** 2).sum(axis=0)).sum() / 2
        return float(self.bias + self.weights[numbers] @ values + pairs)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> "Machine":
        """Adaptive gradient steps on the log loss, in batches."""
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(SEED)
        seen_w, seen_v = np.full(len(self.weights), 1e-3), np.full(self.factors.shape, 1e-3)
        batches = -(-len(rows) // BATCH)
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches)) if batches else 0):
            order = rng.permutation(len(rows))
            for begin in range(0, len(order), BATCH):
                picked = order[begin:begin + BATCH]
                numbers = np.concatenate([rows[k][0] for k in picked])
                values = np.concatenate([rows[k][1] for k in picked])
                sizes = np.array([len(rows[k][0]) for k in picked])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                scaled = self.factors[numbers] * values[:, None]
                sums = np.add.reduceat(scaled, starts)
                linear = np.add.reduceat(self.weights[numbers] * values, starts)
                raw = self.bias + linear + (sums ** 2 - np.add.reduceat(scaled ** 2, starts)).sum(axis=1) / 2
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[picked]
                of_row = np.repeat(error / len(picked), sizes)
                by_value = of_row * values
                by_factor = by_value[:, None] * (np.repeat(sums, sizes, axis=0) - scaled)
                used, place = np.unique(numbers, return_inverse=True)
                gradient = np.bincount(place, by_value) + DECAY * self.weights[used]
                seen_w[used] += gradient ** 2
                self.weights[used] -= RATE * gradient / np.sqrt(seen_w[used])
                spread = np.stack([np.bincount(place, by_factor[:, f]) for f in range(FACTORS)], axis=1)
                spread += DECAY * self.factors[used]
                seen_v[used] += spread ** 2
                self.factors[used] -= RATE * spread / np.sqrt(seen_v[used])
                self.bias -= RATE * float(error.mean())
        return self


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a missing id counts as empty text, which is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """(doc_id, text), (doc_id, quality) -> machine.

    Ids with contradictory labels are left out. At most ``sample`` labelled ids are drawn by hash; only their features
    reach the driver. Without labels every text scores 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    single = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    drawn = single.where(F.col("label") == F.col("other")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    wanted = F.broadcast(drawn.select(F.col("doc_id").alias("drawn_id"), "label"))  # at most ``sample`` rows

    @F.pandas_udf("struct<numbers:array<int>,n_fixed:int>")
    def numbers_of(texts: pd.Series) -> pd.DataFrame:
        found = [features(t)[0] for t in texts]
        return pd.DataFrame({"numbers": [x.astype(np.int32) for x in found], "n_fixed": STATISTICS})

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        wanted, F.col("doc_id") == F.col("drawn_id"))
    rows = chosen.dropDuplicates(["doc_id"]).select("doc_id", "label", numbers_of("text").alias("f")).select(
        "doc_id", "label", "f.numbers").toPandas().sort_values("doc_id")
    fitted = []
    for numbers in rows["numbers"]:
        n_words = max(1, len(numbers) - STATISTICS)
        values = np.concatenate([np.ones(STATISTICS), np.full(len(numbers) - STATISTICS, 1 / np.sqrt(n_words))])
        fitted.append((np.asarray(numbers, dtype=np.int64), values))
    return Machine().fit(fitted, rows["label"].to_numpy(dtype=float))


def score_column(spark: SparkSession, machine: Machine, text: Column) -> Column:
    """Score in 0..1 of each whole text; null and empty texts are scored by their statistics."""
    held = spark.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Machine()
        own.bias, own.weights, own.factors = held.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype=float)

    return score(text.cast("string"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay as they are."""
    machine = fit(docs, labels)
    return docs.where(score_column(docs.sparkSession, machine, F.col("text")) >= threshold)


def op2_factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score, its fold and the predicted label."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    machine = fit(docs, read(spark, folder, "labels").select("doc_id", "quality"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         score_column(spark, machine, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op2_factorisation_machine": op2_factorisation_machine}
ORACLES: dict[str, str] = {}
