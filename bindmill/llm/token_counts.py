"""Token counts by section: each document is encoded once, whole, and its tokens are dealt to its sections.

Tokens and sections are intervals of the document's bytes. A token inside one section counts there. A token that
crosses a boundary counts for one section by an explicit rule: ``majority`` (most of its bytes, ties to the earlier
section) or ``start`` (its first byte). So sections add up to the document, which separate encoding would not give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.llm.common import fresh, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut into pieces before pairs are merged.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "start")
SECTION = "array<struct<section:int,field:int,start:bigint,bytes:bigint,tokens:bigint,crossing:bigint>>"


def encoder(vocabulary: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a file of ranks, and each token's length in bytes."""
    ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in vocabulary.splitlines() if line)}
    lengths = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), lengths


def section_ends(fields: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """End of each line in the joined document, and its field. A line owns the line feed that ends it."""
    ends, owners, at = [], [], 0
    for k, field in enumerate(fields):
        body = field + b"\n" if k + 1 < len(fields) else field
        feeds = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1
        if not len(feeds) or feeds[-1] < len(body):
            feeds = np.append(feeds, len(body))
        ends.append(feeds + at)
        owners.append(np.full(len(feeds), k))
        at += len(body)
    return np.concatenate(ends), np.concatenate(owners)


def deal(token_ends: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens per section, from the ends of both kinds of intervals."""
    if not len(token_ends):
        return np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(ends, token_ends, "left")
    owner = first.copy()
    across = np.flatnonzero(first < last)
    if rule == "majority":
        for k in across:  # few: tokens that hold a boundary
            inside = np.arange(first[k], last[k] + 1)
            begin = np.maximum(np.concatenate([[0], ends])[inside], starts[k])
            owner[k] = inside[np.argmax(np.minimum(ends[inside], token_ends[k]) - begin)]
    n = len(ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[across], minlength=n)


def count_tokens(docs: DataFrame, fields: list[str], vocabulary: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """``docs`` without ``fields`` but with section, field, start, bytes, n_tokens, n_crossing: one row per line.

    The document is its fields joined by line feeds; sections are its lines, numbered from 0. Null fields are empty.
    An empty document has one section of no bytes and no tokens. New columns replace those of the same names.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    new = ("section", "field", "start", "bytes", "n_tokens", "n_crossing")
    spark = docs.sparkSession
    content = spark.read.format("binaryFile").load(vocabulary).select("content").first()[0]  # one file of fixed size
    held = spark.sparkContext.broadcast(bytes(content))

    @F.pandas_udf(SECTION)
    def sections(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding, lengths = encoder(held.value)
        for rows in batches:
            out = []
            for row in rows:
                parts = [(x or "").encode("utf-8", "replace") for x in row]
                ends, owners = section_ends(parts)
                ids = encoding.encode_ordinary(b"\n".join(parts).decode("utf-8"))
                tokens, crossing = deal(np.cumsum(lengths[np.array(ids, dtype=np.int64)]), ends, rule)
                begins = np.concatenate([[0], ends[:-1]])
                out.append([dict(zip(("section", "field", "start", "bytes", "tokens", "crossing"), values)) for values in
                            zip(range(len(ends)), owners.tolist(), begins.tolist(), (ends - begins).tolist(),
                                tokens.tolist(), crossing.tolist())])
            yield pd.Series(out, dtype=object)

    kept = [c for c in docs.columns if c not in fields and c.lower() not in new]
    part = fresh(docs, "part")
    whole = F.array(*[F.col(f"`{c}`").cast("string") for c in fields])
    dealt = docs.select(*[F.col(f"`{c}`") for c in kept], F.explode(sections(whole)).alias(part))
    inner = {"n_tokens": "tokens", "n_crossing": "crossing"}
    return dealt.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{part}.{inner.get(c, c)}").alias(c) for c in new])


def op3_section_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document with the tokens of the whole document's encoding that fall to it."""
    return count_tokens(read(spark, folder, "documents").select("doc_id", "text"), ["text"]).drop("field")


QUERIES = {"op3_section_tokens": op3_section_tokens}
ORACLES: dict[str, str] = {}
