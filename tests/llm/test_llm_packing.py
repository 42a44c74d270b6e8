"""Packing: ids and pieces against the library, packings against their rules and the least possible number."""

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bindmill.llm import packing
from bindmill.llm.common import read

FILE = Path(public_tokenizers.path("byte_bpe_50k.json"))


LIBRARY = Tokenizer.from_file(str(FILE))


def _library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def _check(rows, texts, capacity=1024):
    """Rows hold every piece of every text once, and sequences are gapless and no longer than allowed."""
    expected = []
    for text in texts:
        ids = _library_ids(text)
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        for p, stop in enumerate(range(first, len(ids) + 1, capacity)):
            start = max(0, stop - capacity)
            part = np.array(ids[start:stop], dtype="<u4")
            expected.append((p, start, stop - start, zlib.crc32(part.tobytes())))
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "  \n\n x", "x" * 3000, "it's I'LL    z", "\r\n\r\n  a", "né 12½ ünï"])
def test_ids_are_the_library_s(text):
    encoder = packing.Encoder(FILE.read_text())
    assert encoder.quick is not None
    assert encoder.ids(text).tolist() == _library_ids(text)[:-1]


def test_other_files_go_to_the_library():
    encoder = packing.Encoder(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    assert encoder.quick is None and len(encoder.ids("some words"))


def test_whole_table_is_packed_tightly(spark, small):
    rows = packing.op13_grouping_packing(spark, small).collect()
    texts = [r["text"] for r in read(spark, small, "documents").select("text").collect()]
    used, least = _check(rows, texts)
    assert used <= least + 1


def test_edge_documents(spark, edge_docs, no_docs):
    docs = edge_docs.withColumnRenamed("row", "offset").withColumnRenamed("key", "piece_key")
    packed = packing.pack_documents(docs, ids=True)
    assert packed.columns == ["doc_id", "lang", "source", "n_chars", "piece_key", "piece", "start", "length", "ids_crc32",
                              "ids", "sequence_id", "offset"]
    rows = packed.collect()
    texts = [r["text"] for r in edge_docs.select("text").collect()]
    _check(rows, texts)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack_documents(no_docs).count() == 0
    _check(packing.pack_documents(edge_docs, capacity=16, block=40).collect(), texts, 16)


def test_many_small_blocks(spark):
    draw = np.random.default_rng(4)
    lengths = [int(x) for x in draw.integers(1, 101, 1500)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, n int")
    rows = packing.pack_pieces(pieces, "k", "n", capacity=100, block=60, islands=3).collect()
    assert sorted(r["key"] for r in rows) == list(range(1500))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], lengths[r["key"]]))
    for parts in bins.values():
        stops = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *stops[:-1]] and stops[-1] <= 100
    assert len(bins) <= 1.03 * 765  # best fit of all at once needs 765; a block of 60 ends with up to one more
    again = packing.pack_pieces(pieces, "k", "n", capacity=100, block=60, islands=3).collect()
    assert sorted(rows) == sorted(again)


def test_large_pieces_that_never_share(spark):
    pieces = spark.range(500).selectExpr("id as k", "600 + cast(id % 7 as int) as n")
    rows = packing.pack_pieces(pieces, "k", "n", block=50).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) == 500 and {r["offset"] for r in rows} == {0}


def _plain_best_fit(order, sizes, capacity):
    room, bins = [], {}
    for i in order:
        fitting = [(left, b) for b, left in enumerate(room) if left >= sizes[i]]
        b = min(fitting)[1] if fitting else len(room)
        if not fitting:
            room.append(capacity)
        bins[i] = b
        room[b] -= sizes[i]
    return sorted(room)


def test_operators_give_whole_packings():
    draw = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.sort(draw.integers(1, 50, draw.integers(1, 120)))[::-1].astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        first = packing.fresh_packing(sizes, order, 50)
        assert sorted(first.room.tolist()) == _plain_best_fit(order.tolist(), sizes.tolist(), 50)
        other = packing.fresh_packing(sizes, draw.permutation(len(sizes)), 50)
        child = packing.crossover(first, other, sizes, 50, draw)
        changed = packing.mutation(other, sizes, 50, draw)
        people = packing.evolve([first, other, child, changed], sizes, 50, 5, draw)
        for p in (first, other, child, changed, *people):
            filled = np.bincount(p.bins, weights=sizes)
            assert (filled <= 50).all() and (filled > 0).all() and (50 - filled == p.room).all()
        assert people[0].score == min(p.score for p in people) <= first.score
