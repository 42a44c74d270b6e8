"""Exact-count seeded choices without a global sort.

Keys are ordered by a hash token. The token at a given rank is found from
counts per token prefix (at most 65,536 rows, whatever the data), narrowed four
digits at a time until the prefix that holds the rank has few keys to rank.
Membership is then a comparison of each row's own token with that token, a
literal: no join, nothing to skew.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindmill.session import durable

HASH_DIGITS = 32      # of the md5 in a token
STEP_DIGITS = 4       # one narrowing counts at most 16 ** 4 longer prefixes per rank
RANKED_KEYS = 100_000  # keys that one task may rank; more are narrowed further


def token(columns: list[str], seed: int | str) -> Column:
    """Hash of a key followed by the key itself, so that tokens are unique."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])
    return F.concat(F.md5(F.concat(F.lit(f"{seed}|"), key)), F.lit(":"), key)


def rank_tokens(keys: DataFrame, columns: list[str], seed: int | str,
                ranks: Callable[[int], dict[str, int]]) -> dict[str, str | None]:
    """The tokens at the given ranks; ``ranks`` maps the number of keys to a rank per name.

    Rank 0 gives None. The key columns must be unique and free of NULL.
    """
    tokens = durable(keys.select(token(columns, seed).alias("token")))  # read once per narrowing
    wanted = ranks(tokens.count())
    places = {name: ("", rank) for name, rank in wanted.items() if rank > 0}  # prefix, rank inside it
    for length in range(STEP_DIGITS, HASH_DIGITS + 1, STEP_DIGITS):
        if not places:
            break
        inside = tokens.filter(_starts_with(places))
        counted = inside.groupBy(F.substring("token", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("size"))
        sizes = sorted((row["prefix"], row["size"]) for row in counted.collect())
        places = {name: place for name, (outer, rank) in places.items() for place in _narrowed(sizes, outer, rank)}
        if max([size for prefix, size in sizes if prefix in {p for p, _ in places.values()}], default=0) <= RANKED_KEYS:
            break
    if not places:
        return {name: None for name in wanted}

    near = tokens.filter(_starts_with(places)).withColumn("prefix", F.substring("token", 1, length))
    ranked = near.withColumn("at", F.row_number().over(W.partitionBy("prefix").orderBy("token")))
    chosen = F.lit(False)
    for prefix, at in set(places.values()):
        chosen = chosen | ((F.col("prefix") == prefix) & (F.col("at") == at))
    found = {(r["prefix"], r["at"]): r["token"] for r in ranked.filter(chosen).collect()}  # one row per name
    return {name: found.get(places.get(name)) for name in wanted}


def _starts_with(places: dict[str, tuple[str, int]]) -> Column:
    inside = F.lit(False)
    for prefix in sorted({prefix for prefix, _ in places.values()}):
        inside = inside | F.col("token").startswith(prefix)
    return inside


def _narrowed(sizes: list[tuple[str, int]], outer: str, rank: int) -> list[tuple[str, int]]:
    """The longer prefix that holds the rank, and the rank inside it; empty if the rank lies beyond all keys."""
    last = 0
    for prefix, size in sizes:
        if prefix.startswith(outer):
            if rank <= last + size:
                return [(prefix, rank - last)]
            last += size
    return []


def up_to(columns: list[str], seed: int | str, cut: str | None) -> Column:
    """Whether a row's key is among the chosen ones; missing keys never are."""
    if cut is None:
        return F.lit(False)
    chosen = token(columns, seed) <= cut
    for c in columns:
        chosen = F.col(c).isNotNull() & chosen
    return chosen


def key_sample_cut(df: DataFrame, column: str, share: float, seed: int | str) -> str | None:
    """Cut token of a seeded sample of ``floor(share * n)`` distinct keys."""
    keys = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return rank_tokens(keys, [column], seed, lambda n: {"cut": math.floor(share * n)})["cut"]


def sampled_keys(df: DataFrame, column: str, share: float, seed: int | str) -> DataFrame:
    """The sampled keys themselves."""
    return df.filter(up_to([column], seed, key_sample_cut(df, column, share, seed))).select(column).distinct()
