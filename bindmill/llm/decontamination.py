"""Benchmark decontamination by greedy string tiling.

Texts and test items are rows of lower-case words. A text and an item that share a seed (``MIN_MATCH`` words in a row)
are tiled: running Karp-Rabin hashes find the matches of a search length, the longest ones that overlap nothing marked
so far are marked as tiles, and the search length falls until it is ``MIN_MATCH``. Tiles may come in any order, so a
passage whose sentences were rearranged is found too. The share of the item's words under tiles decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindmill.llm.common import read

MIN_MATCH = 5  # words in a seed, and in the shortest tile
MIN_COVERAGE = 0.5  # of an item's words
BLOCK_BYTES = 32_000_000  # of items that are held by a task at once; more items go in more blocks
LEAK = "array<struct<item:bigint,words:int,covered:int,tiles:int,longest:int>>"


def tile(text: list[int], item: list[int], spans: list[tuple[int, int]], least: int = MIN_MATCH) -> list[tuple]:
    """Tiles (text place, item place, length) of ``item`` in the ``spans`` of ``text`` that may hold matches."""
    free_text, free_item = {}, [True] * len(item)  # places of the text are free unless listed
    tiles, length = [], max(least, min(len(item), 32))
    while True:
        found = _matches(text, item, spans, free_text, free_item, length)
        for size, t, i in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if any(t + k in free_text or not free_item[i + k] for k in (0, size - 1)):
                continue  # an end is marked: a longer or earlier tile has taken part of it
            if any(t + k in free_text or not free_item[i + k] for k in range(size)):
                continue
            tiles.append((t, i, size))
            for k in range(size):
                free_text[t + k] = False
                free_item[i + k] = False
        if not any(free_item):
            return tiles
        if found:
            continue  # what the last tiles left over may hold further matches of this length
        if length == least:
            return tiles
        length = max(least, length // 2)


def _matches(text: list[int], item: list[int], spans: list[tuple[int, int]], taken: dict, free_item: list[bool],
             length: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of at least ``length`` words as (length, text place, item place)."""
    table: dict[int, list[int]] = {}
    for value, i in _running_hashes(item, 0, len(item), length, lambda k: free_item[k]):
        table.setdefault(value, []).append(i)
    found = []
    for start, end in spans:
        covered: dict[int, int] = {}  # by diagonal, up to where a match has been extended
        for value, t in _running_hashes(text, start, end, length, lambda k: k not in taken):
            for i in table.get(value, ()):
                if covered.get(t - i, -1) >= t or text[t:t + length] != item[i:i + length]:
                    continue
                size = length
                while (t + size < end and i + size < len(item) and text[t + size] == item[i + size]
                       and t + size not in taken and free_item[i + size]):
                    size += 1
                covered[t - i] = t + size - length
                found.append((size, t, i))
    return found


def _running_hashes(words: list[int], start: int, end: int, length: int, free: Callable) -> Iterator[tuple[int, int]]:
    """(hash, place) of each run of ``length`` free words, by a rolling polynomial."""
    base, modulus = 1_000_003, (1 << 61) - 1
    drop = pow(base, length, modulus)
    value = run = 0
    for k in range(start, end):
        if not free(k):
            value = run = 0
            continue
        value = (value * base + words[k] + 1) % modulus
        run += 1
        if run > length:
            value = (value - drop * (words[k - length] + 1)) % modulus
        if run >= length:
            yield value, k - length + 1


class Items:
    """Test items of one block: their words as numbers, and which items hold a seed."""

    def __init__(self, rows: list[tuple[int, str]], min_coverage: float):
        self.vocabulary: dict[str, int] = {}
        self.items, seeds = [], []
        for item_id, text in rows:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            if len(words) >= MIN_MATCH:
                seeds += [(h, len(self.items)) for h in set(seed_hashes(np.array(words, dtype=np.uint64)).tolist())]
                self.items.append((item_id, words))
        self.min_coverage = min_coverage
        self.posting: dict[int, list[int]] = {}
        for value, k in seeds:
            self.posting.setdefault(value, []).append(k)
        self.seeds = np.array(sorted(self.posting), dtype=np.uint64)

    def leaks(self, text: str | None) -> list[dict]:
        """Items that the text covers well enough."""
        if not text or not len(self.seeds):
            return []
        get = self.vocabulary.get
        words = [get(w, 0) for w in tokens(text)]
        if len(words) < MIN_MATCH:
            return []
        numbers = np.array(words, dtype=np.uint64)
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        at = np.flatnonzero(known[MIN_MATCH:] - known[:-MIN_MATCH] == MIN_MATCH)
        if not len(at):
            return []
        hashes = seed_hashes(numbers)[at]
        near = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = self.seeds[near] == hashes
        places: dict[int, list[int]] = {}
        for value, place in zip(hashes[hit].tolist(), at[hit].tolist()):
            for k in self.posting[value]:
                places.setdefault(k, []).append(place)
        out = []
        for k, starts in places.items():
            item_id, item = self.items[k]
            spans = []
            for s in starts:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + MIN_MATCH
                else:
                    spans.append([s, s + MIN_MATCH])
            needed = self.min_coverage * len(item)
            if sum(e - s for s, e in spans) < needed:
                continue  # tiles lie inside the spans
            found = tile(words, item, spans)
            covered = sum(size for _, _, size in found)
            if covered >= needed:
                out.append({"item": item_id, "words": len(item), "covered": covered, "tiles": len(found),
                            "longest": max(size for _, _, size in found)})
        return out


def tokens(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of ``MIN_MATCH`` words; candidates only, tiling compares the words themselves."""
    value = np.zeros(len(words) - MIN_MATCH + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(MIN_MATCH):
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            value = value + words[k:len(words) - MIN_MATCH + 1 + k]
    return value


def _search(held, min_coverage: float) -> Callable[[Column], Column]:
    @F.pandas_udf(LEAK)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Items(held.value, min_coverage)
        for texts in batches:
            yield pd.Series([index.leaks(t) for t in texts], dtype=object)

    return leaks


def leak_columns(items: DataFrame, text: Column, min_coverage: float = MIN_COVERAGE) -> list[Column]:
    """One array of leaks per block of items. A block is at most about ``BLOCK_BYTES`` of text, whatever the number of
    items, and is sent to each task once; a larger benchmark makes more blocks, each searched in turn."""
    spark = items.sparkSession
    clean = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    clean = clean.where(F.col("text").isNotNull())
    size = clean.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    columns = []
    for block in range(blocks):
        part = clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted((tuple(r) for r in part.distinct().collect()), key=repr)  # bounded by the block's size
        columns.append(_search(spark.sparkContext.broadcast(rows), min_coverage)(text))
    return columns


def find_leaks(docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile.

    One row per text and item whose coverage is reached. Null and short texts (under ``MIN_MATCH`` words) leak nothing,
    and items that short are never searched for; equal items are searched for once per item_id. Repeated rows of
    ``docs`` give repeated rows.
    """
    text = F.col("text").cast("string")
    listed = docs.select("doc_id", F.concat(*leak_columns(items, text, min_coverage)).alias("leaks"))
    return listed.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", F.col("leak.item").alias("item_id"), F.col("leak.words").alias("item_words"),
        F.col("leak.covered").alias("covered_words"), (F.col("leak.covered") / F.col("leak.words")).alias("coverage"),
        F.col("leak.tiles").alias("n_tiles"), F.col("leak.longest").alias("longest_tile"))


def drop_leaks(docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` without the rows that leak an item; all columns stay as they are."""
    for leaks in leak_columns(items, F.col("text").cast("string"), min_coverage):
        docs = docs.where(F.size(leaks) == 0)
    return docs


def op1_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item whose words the document covers by half or more."""
    return find_leaks(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))


QUERIES = {"op1_string_tiling": op1_string_tiling}
ORACLES: dict[str, str] = {}
