"""Classes of near-duplicate rows of whole tables: connected components of the pairs above a limit.

Rows that share a band of hashes meet. First every row of a band is held against one row of it, the pivot, a few times
with other pivots; that joins dense groups at a cost linear in their size. Only rows of one band that are still in
different classes are then held against each other, in tiles, so a group of m copies never gives m * m pairs. Pairs
that a sketch does not rule out are scored exactly. Equal rows are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bindmill.operators import similarity
from bindmill.operators.components import components
from bindmill.session import durable

STARS = 2  # pivots of a band, one after the other
PIVOT_PAIRS = 2000  # pairs of one pivot that are scored under one join key, on average


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ; ``a`` and ``b`` end the names of their columns."""
    return F.bit_count(F.col(f"low{a}").bitwiseXOR(F.col(f"low{b}"))) + F.bit_count(
        F.col(f"high{a}").bitwiseXOR(F.col(f"high{b}")))


def _scored(pairs: DataFrame, nodes: DataFrame, limit: float, score: Callable) -> DataFrame:
    """(a, b, at) -> a, b of the pairs above the limit; pairs of one ``at`` are scored in one task."""
    tasks = max(1, math.ceil(pairs.count() / similarity.TASK_PAIRS))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("at"), F.lit(tasks)).alias("task"))
    left = dealt.groupBy("task", "a").agg(F.collect_list("b").alias("others")).join(
        nodes.select(F.col("key").alias("a"), "v"), "a")
    right = dealt.select("task", "b").distinct().join(nodes.select(F.col("key").alias("b"), "v"), "b")
    right = right.toDF(*right.columns)  # columns of its own, as both sides read one table
    kind = nodes.schema["key"].dataType

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        values, rows = dict(zip(y["b"], y["v"])), []
        for row in x.itertuples(index=False):
            near = similarity.rounded(score(row.v, [values[b] for b in row.others])) > limit
            rows += [(row.a, b) for b, ok in zip(row.others, near) if ok]
        return pd.DataFrame(rows, columns=["a", "b"])

    schema = T.StructType().add("a", kind).add("b", kind)
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(run, schema)


def _star_pairs(members: DataFrame, turn: int, most: int) -> DataFrame:
    """(band, key, low, high, label) -> a, b, at: members against their band's pivot where labels differ."""
    draw = F.struct(F.xxhash64("key", F.lit(turn)), "key")
    pivots = members.groupBy("band").agg(F.min_by(F.struct("key", "low", "high", "label"), draw).alias("p"))
    pivots = pivots.select(F.col("band").alias("at_band"), F.col("p.key").alias("b"), F.col("p.low").alias("low_b"),
                           F.col("p.high").alias("high_b"), F.col("p.label").alias("label_b"))
    met = members.toDF("band", "a", "low_a", "high_a", "label_a").join(pivots, F.col("band") == F.col("at_band"))
    pairs = durable(met.where((F.col("label_a") != F.col("label_b")) & (_differing("_a", "_b") <= most)).select(
        "a", "b").distinct())
    crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / PIVOT_PAIRS).alias("parts")).withColumnRenamed("b", "pivot")
    return durable(pairs.join(crowd, F.col("b") == F.col("pivot")).select(
        "a", "b", F.struct("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")).alias("at")))


def _cross_pairs(members: DataFrame, most: int) -> DataFrame:
    """(band, key, low, high, label) -> a, b, at: members of one band with different labels, in tiles."""
    several = members.groupBy("band").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("n")).where(
        "labels > 1").select("band", F.ceil(F.col("n") / similarity.TILE).cast("int").alias("parts"))
    several = several.withColumnRenamed("band", "at_band")
    dealt = durable(members.join(several, F.col("band") == F.col("at_band")).drop("at_band").withColumn(
        "tile", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    left = dealt.select("band", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("parts") - 1)).alias("j"),
                        *[F.col(c).alias(f"{c}_a") for c in ("key", "low", "high", "label")])
    right = dealt.select("band", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"),
                         *[F.col(c).alias(f"{c}_b") for c in ("key", "low", "high", "label")])
    met = left.join(right, ["band", "i", "j"]).where(
        ((F.col("i") < F.col("j")) | (F.col("key_a") < F.col("key_b"))) & (F.col("label_a") != F.col("label_b"))
        & (_differing("_a", "_b") <= most))
    return durable(met.groupBy(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).agg(
        F.min(F.struct("band", "i", "j")).alias("at")))


def classes_of(nodes: DataFrame, signature, agree: float, limit: float, score: Callable) -> DataFrame:
    """(key, v) -> node, root of the nodes that have a neighbour; root is the smallest key of the class."""
    nodes = durable(nodes)  # read by every turn
    signed = durable(nodes.select("key", signature("v").alias("s")).select("key", "s.*"))
    each = signed.select(F.explode("bands").alias("band"), "key", "low", "high")
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("at_band"))
    members = durable(each.join(shared, F.col("band") == F.col("at_band"), "left_semi"))
    most = similarity.SKETCH - similarity.least_agreement(agree)
    roots = None

    def labelled() -> DataFrame:
        if roots is None:
            return members.withColumn("label", F.col("key"))
        return members.join(roots, F.col("key") == F.col("node"), "left").select(
            "band", "key", "low", "high", F.coalesce("root", "key").alias("label"))

    for turn in range(STARS + 1):
        now = durable(labelled())
        pairs = _star_pairs(now, turn, most) if turn < STARS else _cross_pairs(now, most)
        if pairs.isEmpty():
            continue
        links = _scored(pairs, nodes, limit, score)
        if roots is not None:
            links = links.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = durable(components(links))
    return nodes.select(F.col("key").alias("node"), F.col("key").alias("root")).where("false") if roots is None else roots


def _equal_rows(rows: DataFrame, same: Column) -> DataFrame:
    """(key, node): every row with the smallest key of the rows that are the same, found by a hash of 128 bits."""
    hashed = rows.select("key", same.alias("same"))
    first = hashed.groupBy("same").agg(F.min("key").alias("node"))
    return durable(hashed.join(first, "same").select("key", "node"))


def _nodes(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` of one key each of the rows that are the same."""
    return rows.join(named.where("key = node").select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def _membership(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node): every row's class, from its node's."""
    rooted = durable(named.join(classes.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        "key", F.coalesce("root", "node").alias("class_id")))
    sizes = rooted.groupBy("class_id").agg(F.count("*").alias("class_size")).withColumnRenamed("class_id", "of")
    return rooted.join(sizes, F.col("class_id") == F.col("of")).select("key", "class_id", "class_size")


def vector_classes(df: DataFrame, key: str, vector: str, limit: float = 0.95, seed: int = 42) -> DataFrame:
    """(key, class_id, class_size): the class of every row under cosines (rounded to six decimals) above ``limit``.

    ``class_id`` is the smallest key of the class; a row without a near copy is a class of its own. Vectors that are
    null, of length zero or with an element that is no finite number have no cosine and are left out, as are null keys.
    """
    rows = similarity.usable_vectors(df, key, vector)
    named = _equal_rows(rows, F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    nodes = durable(_nodes(rows, named))
    signature = similarity.vector_signature(limit, seed, similarity.band_bits(nodes.count()))
    return _membership(named, classes_of(nodes, signature, similarity.sign_agreement(limit), limit, similarity.cosines))


def text_classes(df: DataFrame, key: str, text: str, limit: float = 0.8, k: int = 2, seed: int = 42) -> DataFrame:
    """(key, class_id, class_size): the class of every text under overlaps of word k-gram sets above ``limit``.

    ``class_id`` is the smallest key of the class; a text without a near copy is a class of its own. Texts without
    words and null keys are left out. Sets are of 64-bit hashes, as a fingerprint of 2,048 bits is full on long texts.
    """
    rows = similarity.worded_texts(df, key, text)
    named = _equal_rows(rows, F.unhex(F.md5(F.array_join("words", " "))))
    nodes = _nodes(rows, named).select("key", similarity.gram_set("words", k).alias("v"))
    return _membership(named, classes_of(nodes, similarity.set_signature(limit, seed), (1 + limit) / 2, limit,
                                         similarity.overlaps))
