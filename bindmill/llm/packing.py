"""Packing of token sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut from their end into whole sequences; what is left in front of them, and every
shorter document, is a piece to pack. Pieces are dealt by hash into blocks of about ``BLOCK`` and every block is packed
by ``ISLANDS`` tasks. An individual is a whole packing of the block. Crossover puts well-filled sequences of one parent
into the other whole, takes out the sequences that hold a piece twice, and fits their other pieces in again, longest
first, each where it leaves the least room. After every epoch an island's best packing moves to the next island. The
best island's full sequences are kept; the others are dealt anew, whole, into fewer blocks, until one block is left.
So a task never holds more than a block, and blocks do not each leave sequences half empty.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from bindmill.llm.common import read, text_of
from bindmill.session import durable

CAPACITY = 1024
END = 2  # the id behind every document
BLOCK = 4096  # pieces
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 4
SHARE = 0.5  # of a parent's well-filled sequences that a child gets


class Encoder:
    """Ids of a byte-level BPE file as the ``tokenizers`` library gives them, by a faster way where the two agree.

    They agree if the file does no more than merge byte pairs in the order of the ids; texts that hold a special
    token's name always go to the library itself, and so do all texts of any other file.
    """

    def __init__(self, content: str) -> None:
        self.library = Tokenizer.from_str(content)
        told = json.loads(content)
        self.special = [t["content"] for t in told.get("added_tokens") or []]
        self.quick = self._quick(told)

    def _quick(self, told: dict) -> tiktoken.Encoding | None:
        model, before = told["model"], told.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and not told.get("normalizer") and not model.get("dropout")
                 and not told.get("truncation") and not told.get("padding")
                 and not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
                 and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"))
        if not plain:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in
                                                enumerate(b for b in range(256) if b not in shown)}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(model["vocab"].get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merged)):
            return None
        names = {t: i for t, i in model["vocab"].items() if t not in self.special}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in names.items() if all(c in byte_of for c in t)}
        if len(ranks) != 256 + len(merged):
            return None
        return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None or any(name in text for name in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.quick.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder_of(content: str) -> Encoder:
    """The encoder of a file, built once for each process that runs tasks."""
    return Encoder(content)


def piece_lengths(n: int, capacity: int) -> np.ndarray:
    """Lengths of the pieces of a document of ``n`` ids: whole sequences, and the rest as the first piece."""
    pieces = -(-n // capacity)
    lengths = np.full(pieces, capacity, dtype=np.int64)
    if pieces:
        lengths[0] = n - capacity * (pieces - 1)
    return lengths


def cut_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY,
                  end: int = END, ids: bool = False) -> DataFrame:
    """``docs`` without ``text`` but with piece, start, length, ids_crc32 and, if asked for, ids: one row per piece.

    Null texts are empty; a document without text is its end id alone. New columns replace those of the same names.
    """
    spark = docs.sparkSession
    if vocabulary:  # one file of fixed size
        content = bytes(spark.read.format("binaryFile").load(vocabulary).select("content").first()[0])
    else:
        content = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()
    held = spark.sparkContext.broadcast(content.decode("utf-8"))
    fields = "length array<long>, start array<long>, crc array<long>" + (", ids array<int>" if ids else "")

    @F.pandas_udf(fields)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(held.value)
        for texts in batches:
            rows = []
            for body in texts:
                row = np.append(encoder.ids(body), np.uint32(end)).astype("<u4")
                lengths = piece_lengths(len(row), capacity)
                stops = np.cumsum(lengths)
                crc = [zlib.crc32(row[b - n:b].tobytes()) for b, n in zip(stops.tolist(), lengths.tolist())]
                rows.append([lengths, stops - lengths, crc] + ([row.astype(np.int32)] if ids else []))
            yield pd.DataFrame(rows, columns=["length", "start", "crc", "ids"][:3 + ids])

    new = ("piece", "start", "length", "ids_crc32") + (("ids",) if ids else ())
    kept = [c for c in docs.columns if c != text and c.lower() not in new]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(1)).alias("row"),
                         text_of(F.col(f"`{text}`").cast("string")).alias("body")).select("row", cut("body").alias("own"))
    zipped = F.arrays_zip(F.col("own.length").alias("length"), F.col("own.start").alias("start"),
                          F.col("own.crc").alias("crc"))
    dealt = packed.select("row", "own", F.posexplode(zipped).alias("piece", "part"))
    piece_ids = F.slice("own.ids", (F.col("part.start") + 1).cast("int"), F.col("part.length").cast("int")).alias("ids")
    tail = [piece_ids] if ids else []
    return dealt.select(*[F.col(f"row.`{c}`") for c in kept], "piece", "part.start", "part.length",
                        F.col("part.crc").alias("ids_crc32"), *tail)


def best_fit(pieces: np.ndarray, sizes: np.ndarray, bins: np.ndarray, room: np.ndarray, capacity: int) -> np.ndarray:
    """Puts ``pieces``, in their order, where each leaves the least room; changes ``bins``, returns room of all bins."""
    free, fits, spots = room.tolist(), 0, {}
    for number, left in enumerate(free):
        if left:
            spots.setdefault(left, []).append(number)
            fits |= 1 << left
    for piece, size in zip(pieces.tolist(), sizes[pieces].tolist()):
        wide = fits >> size  # bit r: some bin leaves r
        if wide:
            left = (wide & -wide).bit_length() - 1 + size
            number = spots[left].pop()
            if not spots[left]:
                fits &= ~(1 << left)
        else:
            left, number = capacity, len(free)
            free.append(capacity)
        bins[piece] = number
        left -= size
        free[number] = left
        if left:
            spots.setdefault(left, []).append(number)
            fits |= 1 << left
    return np.array(free, dtype=np.int64)


class Packing:
    """A whole packing of a block: the bin of every piece and what is left in every bin."""

    def __init__(self, bins: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
        self.bins = bins
        self.room = capacity - np.bincount(bins, weights=sizes, minlength=0).astype(np.int64)

    @property
    def score(self) -> tuple[int, int]:
        """Fewer bins are better, then fuller ones."""
        return len(self.room), -int((self.room ** 2).sum())


def fresh_packing(sizes: np.ndarray, order: np.ndarray, capacity: int) -> Packing:
    bins = np.full(len(sizes), -1, dtype=np.int64)
    best_fit(order, sizes, bins, np.zeros(0, np.int64), capacity)
    return Packing(bins, sizes, capacity)


def _refit(bins: np.ndarray, out: np.ndarray, order: np.ndarray, sizes: np.ndarray, capacity: int) -> Packing:
    """The packing whose pieces ``out`` are taken out of their bins and fitted in again in the given order."""
    used, bins = np.unique(np.where(out, -1, bins), return_inverse=True)
    emptied = int(used[0] == -1)
    bins = bins - emptied
    filled = np.bincount(bins[~out], weights=sizes[~out], minlength=len(used) - emptied).astype(np.int64)
    best_fit(order, sizes, bins, capacity - filled, capacity)
    return Packing(bins, sizes, capacity)


def _longest_first(out: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    pieces = np.flatnonzero(out)
    return pieces[np.argsort(-sizes[pieces], kind="stable")]


def crossover(one: Packing, other: Packing, sizes: np.ndarray, capacity: int, draw: np.random.Generator) -> Packing:
    """``one`` with a part of the well-filled bins of ``other`` in it, whole."""
    well_filled = other.room <= np.median(other.room)
    given = well_filled & (draw.random(len(other.room)) < SHARE)
    moved = given[other.bins]
    broken = np.zeros(len(one.room), dtype=bool)
    broken[one.bins[moved]] = True  # these bins hold a piece that is now there twice
    bins = np.where(moved, len(one.room) + other.bins, one.bins)
    out = broken[one.bins] & ~moved
    return _refit(bins, out, _longest_first(out, sizes), sizes, capacity)


def mutation(one: Packing, sizes: np.ndarray, capacity: int, draw: np.random.Generator) -> Packing:
    """``one`` with its emptiest bins and a few others emptied and fitted in again in a disturbed order."""
    emptiest = one.room >= np.sort(one.room)[-max(1, len(one.room) // 20)]
    out = (emptiest | (draw.random(len(one.room)) < 0.05))[one.bins]
    return _refit(one.bins, out, _longest_first(out, sizes * draw.uniform(0.8, 1.0, len(sizes))), sizes, capacity)


def settled(best: Packing, sizes: np.ndarray, capacity: int) -> bool:
    """No packing can be better: as few bins as the ids need, and no more than one bin with room."""
    return len(best.room) == -(-int(sizes.sum()) // capacity) and int((best.room > 0).sum()) <= 1


def evolve(people: list[Packing], sizes: np.ndarray, capacity: int, generations: int,
           draw: np.random.Generator) -> list[Packing]:
    """The population after some generations, best first; parents and children compete."""
    size = len(people)
    people = sorted(people, key=lambda p: p.score)
    for _ in range(generations):
        if settled(people[0], sizes, capacity):
            break
        a, b = draw.choice(size, 2, replace=False) if size > 1 else (0, 0)
        children = [crossover(people[a], people[b], sizes, capacity, draw), crossover(people[b], people[a], sizes, capacity, draw)]
        children.append(mutation(people[0], sizes, capacity, draw))
        people = sorted([*people, *children], key=lambda p: p.score)
        unlike = [p for i, p in enumerate(people) if i == 0 or p.score != people[i - 1].score]
        people = (unlike + [p for p in people if all(p is not u for u in unlike)])[:size]
        people.sort(key=lambda p: p.score)
    return people


def _by_length(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)


def _pack_blocks(pieces: DataFrame, blocks: int, level: int, slack: int, capacity: int, islands: int, epochs: int,
                 generations: int) -> DataFrame:
    """(key, length, bin) -> key, length, sequence_id, offset, kept: false for pieces of bins with over ``slack`` left.

    ``bin`` names the sequence a piece was in so far. Sequences come whole into a block, and are one of its first
    packings, so a block never ends with more of them than it got.
    """
    spark, bins = pieces.sparkSession, [f"b{i}" for i in range(POPULATION)]
    parts = min(blocks * islands, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks * islands // 64)))
    schema = "block long, island int, from int, key long, length int, bin long, " + ", ".join(f"{b} int" for b in bins)

    def island(epoch: int) -> Callable:
        def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            block, number = int(group[0]), int(group[1])
            draw = np.random.default_rng([level, block, number, epoch])
            own = _by_length(pdf[pdf["from"] == number])
            sizes = own["length"].to_numpy(dtype=np.int64)
            if epoch == 0:
                people = [fresh_packing(sizes, np.arange(len(sizes)), capacity)]
                _, so_far = np.unique(own["bin"].to_numpy(), return_inverse=True)
                people += [Packing(so_far, sizes, capacity)] if level else []
                while len(people) < POPULATION:
                    noisy = sizes * draw.uniform(0.9 - 0.1 * number / islands, 1.0, len(sizes))
                    people.append(fresh_packing(sizes, np.argsort(-noisy, kind="stable"), capacity))
            else:
                people = [Packing(own[b].to_numpy(dtype=np.int64), sizes, capacity) for b in bins]
                guests = _by_length(pdf[pdf["from"] != number])
                if len(guests):
                    people = sorted(people, key=lambda p: p.score)[:-1]
                    people.append(Packing(guests["b0"].to_numpy(dtype=np.int64), sizes, capacity))
            people = evolve(people, sizes, capacity, generations, draw)
            told = own[["key", "length", "bin"]].assign(block=block, island=number, **{"from": number},
                                                 **{b: p.bins.astype(np.int32) for b, p in zip(bins, people)})
            if islands == 1 or epoch == epochs - 1:
                return told
            return pd.concat([told, told.assign(island=(number + 1) % islands)])  # the best one moves on

        return run

    def choose(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        best = None
        for number in sorted(pdf["island"].unique()):
            own = _by_length(pdf[pdf["island"] == number])
            sizes = own["length"].to_numpy(dtype=np.int64)
            packing = Packing(own["b0"].to_numpy(dtype=np.int64), sizes, capacity)
            if best is None or packing.score < best[1].score:
                best = own, packing
        own, packing = best
        order = np.argsort(packing.bins, kind="stable")
        keys, sizes, in_bin = (own["key"].to_numpy()[order], own["length"].to_numpy(dtype=np.int64)[order],
                               packing.bins[order])
        first = np.searchsorted(in_bin, in_bin)
        before = np.cumsum(sizes) - sizes
        kept = packing.room[in_bin] <= slack
        return pd.DataFrame({"key": keys, "length": sizes, "sequence_id": keys[first], "offset": before - before[first], "kept": kept})

    dealt = pieces.select(F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "key",
                          F.col("length").cast("int").alias("length"), "bin")
    state = dealt.select("block", "island", F.col("island").alias("from"), "key", "length", "bin",
                         *[F.lit(0).alias(b) for b in bins])
    for epoch in range(epochs):
        state = state.repartition(parts, "block", "island").groupBy("block", "island").applyInPandas(island(epoch), schema)
    return state.select("block", "island", "key", "length", "b0").repartition(parts, "block").groupBy("block").applyInPandas(
        choose, "key long, length int, sequence_id long, offset long, kept boolean")


def pack_pieces(pieces: DataFrame, key: str, length: str, capacity: int = CAPACITY, block: int = BLOCK,
                islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """(key, length from 1 to ``capacity``) -> key, sequence_id, offset; a sequence is named by its first piece's key.

    Keys are distinct longs. Where the pieces left over shrink by less than half from one round of blocks to the next,
    the room a kept sequence may have grows, so the rounds end.
    """
    given = pieces.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{length}`").cast("int").alias("length"))
    whole = given.where(F.col("length") >= capacity).select("key", F.col("key").alias("sequence_id"),
                                                            F.lit(0).cast("long").alias("offset"))
    left = given.where(F.col("length") < capacity).withColumn("bin", F.col("key"))
    done, slack, level = [whole], 0, 0
    n = left.count()
    while n:
        blocks = math.ceil(n / block)
        slack = capacity if blocks == 1 else slack
        packed = durable(_pack_blocks(left, blocks, level, slack, capacity, islands, epochs, generations))
        done.append(packed.where("kept").select("key", "sequence_id", "offset"))
        if slack >= capacity:
            break
        left = packed.where("not kept").select("key", "length", F.col("sequence_id").alias("bin"))
        before, n, level = n, left.count(), level + 1
        if 2 * n > before:
            slack = max(1, 4 * slack)
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY,
                   ids: bool = False, **search: int) -> DataFrame:
    """``docs`` without ``text`` but with piece, start, length, ids_crc32, (ids,) sequence_id, offset: a row per piece.

    Every row is a document of its own, repeated rows too; null texts are empty; texts of any length are cut whole. An
    empty table gives no rows. New columns replace those of the same names.
    """
    new = ("sequence_id", "offset")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in new and c != text])
    cut = cut_documents(kept, text, vocabulary, capacity, ids=ids)
    rows = cut.select(F.struct(*[F.col(f"`{c}`") for c in cut.columns]).alias("row"), "length")
    pieces = durable(rows.withColumn("piece_key", F.monotonically_increasing_id()))  # written once, so keys stay
    places = pack_pieces(pieces, "piece_key", "length", capacity, **search)
    return pieces.join(places, F.col("piece_key") == F.col("key")).select("row.*", *new)


def sequences(packed: DataFrame) -> DataFrame:
    """(ids, sequence_id, offset) -> sequence_id, ids: every sequence's ids, in order."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))  # at most ``capacity`` ids


def op13_grouping_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack_documents(read(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"op13_grouping_packing": op13_grouping_packing}
ORACLES: dict[str, str] = {}
