"""Reproducible shuffle into shards: a keyed Feistel permutation of global row numbers with cycle walking.

A row's place is ``permutation(row number)``; its shard is the place modulo the number of shards and its slot the
place divided by it, so shard sizes differ by one row at most, slots have no gaps, and where a row goes (or which row
sits in a slot) is computed, not looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.llm.common import fresh, number_rows, read, text_of

SHARDS = 16
ROUNDS = 6  # even, so that the halves end with the widths they had
SEED = 20_240_601


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """Avalanche of 64-bit words, the round function of the network."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    words = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed & 0xFFFFFFFFFFFFFFFF)
    return [int(w) for w in words]


def _widths(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _network(x: np.ndarray, widths: tuple[int, int], keys: list[int], back: bool) -> np.ndarray:
    a, b = widths
    left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
    for key in reversed(keys) if back else keys:
        mask = np.uint64((1 << (b if back else a)) - 1)
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
        a, b = b, a
    return (left << np.uint64(b)) | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """A bijection of 0..n-1 (its inverse with ``back``).

    The network permutes the next power of two; values that leave the range walk on through it until they return,
    which a permutation always does. The range is over half of the domain, so half of the walkers stop at each step.
    """
    if n <= 1:
        return np.asarray(numbers, dtype=np.int64)
    widths, keys = _widths(n), _keys(seed)
    out = _network(np.asarray(numbers).astype(np.uint64), widths, keys, back)
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = _network(out[outside], widths, keys, back)
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = int(permute(np.array([number]), n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """Row number that sits in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard_rows(docs: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``.

    Rows are numbered in the order of the named columns, null last, then of all columns, so the result depends on the
    rows and not on files or partitions. Repeated rows get places of their own. An empty table stays empty. If
    ``docs`` has columns named shard or slot, the new ones replace them.
    """
    docs = docs.drop("shard", "slot")
    everything = [F.col(f"`{c}`") for c in docs.columns]
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    ranked = fresh(docs, "row_number")
    numbered = number_rows(docs, [*keys, F.xxhash64(*everything)], ranked)
    n = numbered.count()

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    at = fresh(docs, "place")
    placed = numbered.withColumn(at, place(F.col(ranked)))
    return placed.select(*everything, F.pmod(F.col(at), F.lit(shards)).cast("int").alias("shard"),
                         F.floor(F.col(at) / shards).cast("long").alias("slot"))


def op10_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``: counts at most one apart.

    Null texts count as empty (size 1, checksum 0); repeated rows get slots of their own; equal texts are separate
    rows. Only the digest of a text is dealt, never the text.
    """
    text = F.col("text").cast("string")
    digest = read(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"))
    return shard_rows(digest, ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_feistel_shards": op10_feistel_shards}
ORACLES: dict[str, str] = {}
