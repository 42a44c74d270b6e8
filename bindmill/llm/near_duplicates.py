"""Near-duplicate documents by weighted Jaccard similarity: BagMinHash signatures, bands, and an exact check.

A document is a multiset of five-word shingles; a shingle's weight is its count. Every (shingle, weight) pair owns
Poisson points in time: a weight's axis is cut into ranges 0-1, 1-2, 2-4, 4-8, ..., each range has a process whose rate
is its width, every point of it falls to one unit of the range and to one component of the signature, and a shingle
sees the points below its weight. A component keeps the earliest time. Two documents agree in a component with a
probability equal to their weighted Jaccard similarity. Points come in the order of time and a shingle stops when it is
later than the latest component, so a signature costs about one point per shingle, not one per shingle and component.

Documents that agree in a whole band are compared by the exact overlap of their multisets, never pair by pair within a
band: first each with the band's smallest member, then, in bands that still hold several groups, members outside the
largest group with those of other groups that a finer signature does not rule out. Members meet in tiles of bounded
size, which give only the links that join two groups, so a drifting group of near copies gives no more links than it
has members in a tile. Two documents that share a band and are similar end in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bindmill.llm.common import fresh, read, text_key, text_of
from bindmill.llm.hashing import RangeHash, scatter, word_ranges
from bindmill.session import durable

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # a pair at 0.8 shares a band with probability 0.99995
SIZE = BANDS * ROWS
#: Agreeing bits of 125 that a pair needs to be compared: 5.5 standard deviations below what 0.8 gives.
SKETCH_AGREE = 94
#: For members of bands that hold several groups: four bits of each of 2,016 components, and how many of them a pair
#: needs to agree in to be compared, again five standard deviations below what 0.8 gives (1,638, deviation 17.5).
FINE_SIZE, FINE_AGREE = 2016, 1550
SHORT = 2000  # shingles of a text that is compared where its sketch is; pairs with a longer text are joined with the texts
TILE_LEFT, TILE_RIGHT = 1000, 4000  # members of a band that are held against each other in one task
KEPT_CHARS = 8_000_000  # of texts whose shingles a task keeps while it checks pairs
BATCH = 400  # documents whose signatures are made together
BATCH_CHARS = 500_000  # and their characters; a longer text is alone
SIGNATURE = T.StructType().add("bands", T.ArrayType(T.LongType())).add("low", "long").add("high", "long")


def shingles(text: str, hashes: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts; a text of one to four words is one shingle."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts, ends = word_ranges(data)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = hashes.ranges(hashes.prefix(data), starts, ends)
    width = min(SHINGLE, len(words))
    value = np.full(len(words) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            value = scatter(value + words[k:len(words) - width + 1 + k])
    return np.unique(value, return_counts=True)


def bag_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Signatures of ``n`` bags given as (bag, element, integer weight) rows; bags without elements stay infinite."""
    earliest = np.full(n * size, np.inf)
    # one process per element and range of the weight axis that starts below the weight
    ranges = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(owner)), ranges)
    level = np.arange(len(row)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    bag, top = owner[row], weight[row]
    with np.errstate(over="ignore"):
        state = scatter(element[row] + scatter(level.astype(np.uint64) + np.uint64(0xA5A5)))
    time = np.zeros(len(row))
    point = 0
    while len(row):
        with np.errstate(over="ignore"):
            draw = scatter(state + np.uint64((2 * point + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            second = scatter(draw + np.uint64(0x632BE59BD9B4E019))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / width
        part = ((second >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        unit = low + ((second & np.uint64(0xFFFFFFFF)).astype(np.int64) * width >> 32)
        seen = unit < top
        np.minimum.at(earliest, bag[seen] * size + part[seen], time[seen])
        latest = earliest.reshape(n, size).max(axis=1) if point < 8 or point % 8 == 0 else latest
        on = time < latest[bag]
        row, bag, top, low, width, state, time = (x[on] for x in (row, bag, top, low, width, state, time))
        point += 1
    return earliest.reshape(n, size)


def _batches(texts: pd.Series, most: int) -> Iterator[list[str]]:
    """The texts in order, in lists of at most ``most`` texts and ``BATCH_CHARS`` characters."""
    part: list[str] = []
    held = 0
    for text in texts:
        if part and (len(part) == most or held + len(text) > BATCH_CHARS):
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def _signature_rows(texts: list[str], hashes: RangeHash) -> list[dict]:
    bags = [shingles(t, hashes) for t in texts]
    sizes = np.array([len(b[0]) for b in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    signature = bag_minhash(owner, np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), len(bags))
    bits = scatter(signature.view(np.uint64))
    folded = np.zeros((len(bags), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        folded += np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            folded = scatter(folded * np.uint64(3) + bits[:, k::ROWS])
    ones = (bits & np.uint64(1)).astype(np.uint64)
    low = (ones[:, :63] << np.arange(63, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
    high = (ones[:, 63:] << np.arange(SIZE - 63, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
    bands = folded.view(np.int64)
    return [{"bands": bands[k].tolist() if sizes[k] else [], "low": int(low[k]), "high": int(high[k])}
            for k in range(len(bags))]


@F.pandas_udf(SIGNATURE)
def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = RangeHash()
    for texts in batches:
        for part in _batches(texts, BATCH):
            yield pd.DataFrame(_signature_rows(part, hashes), columns=["bands", "low", "high"])


FINE = T.StructType().add("fine", "binary").add("elements", "binary")


def elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The multiset as a sorted set: one hash of each shingle and each of its repeats."""
    value, count = bag
    repeat = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return np.sort(scatter(np.repeat(value, count) + scatter(repeat.astype(np.uint64))))


@F.pandas_udf(FINE)
def fine_sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Four bits of each of ``FINE_SIZE`` components, two to a byte; the elements of texts that are ``SHORT``."""
    hashes = RangeHash()
    for texts in batches:
        for part in _batches(texts, BATCH // 8):
            bags = [shingles(t, hashes) for t in part]
            owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
            signature = bag_minhash(owner, np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]),
                                    len(bags), FINE_SIZE)
            bits = (scatter(signature.view(np.uint64)) & np.uint64(15)).astype(np.uint8)
            packed = bits[:, ::2] << 4 | bits[:, 1::2]
            yield pd.DataFrame([(row.tobytes(), elements(bag).tobytes() if bag[1].sum() <= SHORT else None)
                                for row, bag in zip(packed, bags)], columns=["fine", "elements"])


PAIR = T.StructType().add("a", "binary").add("b", "binary").add("similar", "boolean")


def _packed(fine: pd.Series) -> np.ndarray:
    """Fine sketches as words of sixteen components."""
    return np.frombuffer(b"".join(fine), np.uint64).reshape(len(fine), FINE_SIZE // 16)


def _agreeing(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many components each of the packed rows agrees with ``one``: those whose four bits are all equal."""
    differ = rows ^ one
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    differ &= np.uint64(0x1111111111111111)
    return FINE_SIZE - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)


def _alike_sets(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common) >= threshold


def _compare_tiles(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of different groups whose fine sketches agree enough, each in the first band that both share.

    Pairs of short texts are decided here by their elements, and only those that join two groups are given; pairs with
    a longer text are given undecided.
    """
    a, b, similar = [], [], []
    if len(left) and len(right):
        band, main = left["band"].iloc[0], left["main"].iloc[0]
        x, y = (_packed(f["fine"]) for f in (left, right))
        bands_x, bands_y = (np.array(f["bands"].tolist()) for f in (left, right))
        sets_x, sets_y = ([None if e is None else np.frombuffer(e, np.uint64) for e in f["elements"]]
                          for f in (left, right))
        names = {label: n for n, label in enumerate(dict.fromkeys([*left["label"], *right["label"]]))}
        group_x, group = (np.array([names[v] for v in f["label"]]) for f in (left, right))
        own = np.arange(len(names))  # a label's group, by links found in this tile
        keys = right["key"].to_numpy()
        is_main = np.array([v == main for v in right["label"]])
        for k, (key, pivot) in enumerate(zip(left["key"], left["pivot"])):
            if key == pivot:
                continue  # compared before, as the others are with the pivot below
            apart = np.flatnonzero(own[group] != own[group_x[k]])
            near = apart[_agreeing(y[apart], x[k]) >= FINE_AGREE]
            for j in near.tolist():
                if own[group[j]] == own[group_x[k]] or keys[j] == pivot or not (is_main[j] or key < keys[j]):
                    continue
                shared = np.flatnonzero(bands_x[k] == bands_y[j])
                if bands_x[k][shared[0]] != band:
                    continue
                short = sets_x[k] is not None and sets_y[j] is not None
                if short and not _alike_sets(sets_x[k], sets_y[j], threshold):
                    continue
                a.append(key)
                b.append(keys[j])
                similar.append(short)
                if short:
                    own[own == own[group[j]]] = own[group_x[k]]
    return pd.DataFrame({"a": a, "b": b, "similar": similar})


def _cross_pairs(mixed: DataFrame, fine: DataFrame, threshold: float) -> DataFrame:
    """(band, main, key, label, pivot), (key, fine, elements, bands) -> links and pairs to check, by bounded tiles."""
    counts = mixed.groupBy("band").agg(
        F.ceil(F.sum((F.col("label") != F.col("main")).cast("int")) / TILE_LEFT).cast("int").alias("lefts"),
        F.ceil(F.count("*") / TILE_RIGHT).cast("int").alias("rights"))
    sized = durable(mixed.join(counts, "band"))

    def dealt(df: DataFrame, own: str, salt: str, other: str) -> DataFrame:
        tile = F.pmod(F.xxhash64(F.lit(salt), "key"), F.col(own)).cast("int")
        out = df.withColumn("own", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("own", "other") if own == "lefts" else ("other", "own")
        return out.select("band", "main", "key", "label", "pivot", "fine", "elements", "bands", F.col(pair[0]).alias("i"),
                          F.col(pair[1]).alias("j"))

    left = dealt(sized.where("label <> main").join(fine, "key"), "lefts", "left", "rights")
    right = dealt(sized.join(fine, "key"), "rights", "right", "lefts")
    right = right.toDF(*right.columns)  # columns of its own, as both sides read one table
    by = ["band", "i", "j"]

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _compare_tiles(x, y, threshold)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, PAIR)


def overlap(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets; 0 if both are empty."""
    (x, m), (y, n) = left, right
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.minimum(m, n[at])[y[at] == x].sum())
    return common / (int(m.sum() + n.sum()) - common)


@F.pandas_udf(T.DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    hashes = RangeHash()
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # texts that come in many pairs are read once
    held = 0

    def of(text: str) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        if text not in known:
            if held > KEPT_CHARS:
                known.clear()
                held = 0
            known[text] = shingles(text, hashes)
            held += len(text)
        return known[text]

    for left, right in batches:
        yield pd.Series([overlap(of(a), of(b)) for a, b in zip(left, right)], dtype=float)


def _alike(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    differ = F.bit_count(low.bitwiseXOR(other_low)) + F.bit_count(high.bitwiseXOR(other_high))
    return differ <= SIZE - SKETCH_AGREE


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> node, root: the smallest node that links lead to.

    Alternates two steps on the links: every node's larger neighbours, then its smaller ones, are linked to its
    smallest neighbour. Neighbourhoods are reduced to their minimum before they are exchanged and joined back, so a
    node with very many links is split by the skew join. Ends when a round changes nothing.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("node"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("node")).where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
        small = large.join(least, F.col("u") == F.col("node")).select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = durable(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the (a, b) pairs of keys whose texts are similar enough, by the exact check."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    # the check is in the filter alone: as a column too it would run twice, in two Python workers of every task
    checked = pairs.join(left, "a").join(right, "b").where(similarity("text_a", "text_b") >= threshold)
    return durable(checked.select("a", "b"))


def near_duplicate_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(key, text) -> key, root for the texts that are similar to another one; root is the class's smallest key.

    ``key`` stands for the text, so equal texts are one node from the start.
    """
    signed = durable(docs.select("key", signature("text").alias("s")).select("key", "s.*").dropDuplicates(["key"]))
    members = signed.select(F.explode("bands").alias("band"), "key", "low", "high")
    pivots = members.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("key", "low", "high")).alias("p"))
    shared = durable(members.join(pivots.where("n > 1").drop("n"), "band"))
    stars = shared.where((F.col("key") != F.col("p.key"))
                         & _alike(F.col("low"), F.col("high"), F.col("p.low"), F.col("p.high")))
    pairs = durable(stars.select(F.col("key").alias("a"), F.col("p.key").alias("b")).distinct())
    texts = docs.join(signed.join(shared.select("key").distinct(), "key", "left_semi").select("key"), "key", "left_semi")
    texts = durable(texts.groupBy("key").agg(F.first("text").alias("text")))
    links = _similar(pairs, texts, threshold)
    roots = components(links)

    # bands that hold several groups: their members outside the largest group against the members of other groups
    labelled = shared.join(roots, F.col("key") == F.col("node"), "left").select(
        "band", "key", "low", "high", F.coalesce("root", "key").alias("label"), F.col("p.key").alias("pivot"))
    sizes = labelled.groupBy("band", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("band").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"))
    mixed = durable(labelled.join(largest.where("labels > 1").drop("labels"), "band"))
    fine = texts.join(mixed.select("key").distinct(), "key", "left_semi").select("key", fine_sketch("text").alias("f"))
    fine = durable(fine.select("key", "f.*").join(signed.select("key", "bands"), "key"))
    rest = durable(_cross_pairs(mixed.drop("low", "high"), fine, threshold))
    decided = _similar(rest.where("not similar").drop("similar"), texts, threshold)
    more = rest.where("similar").select("a", "b").union(decided.select("a", "b"))
    if more.isEmpty():
        return roots.select(F.col("node").alias("key"), "root")
    # links between groups: a small graph of its own, whose roots replace those of the groups
    known = durable(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
    side = lambda c: F.coalesce(F.col(c), F.col({"ra": "a", "rb": "b"}[c]))
    joined = more.join(known.select(F.col("node").alias("na"), F.col("root").alias("ra")), F.col("a") == F.col("na"), "left").join(
        known.select(F.col("node").alias("nb"), F.col("root").alias("rb")), F.col("b") == F.col("nb"), "left")
    higher = components(joined.select(side("ra").alias("a"), side("rb").alias("b")))
    nodes = known.union(higher.select("node", F.col("node").alias("root")).join(known.select("node"), "node", "left_anti"))
    return nodes.join(higher.select(F.col("node").alias("group"), F.col("root").alias("top")),
                      F.col("root") == F.col("group"), "left").select(
        F.col("node").alias("key"), F.coalesce("top", "root").alias("root"))


def _rooted(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    classes = near_duplicate_classes(docs, threshold).withColumnRenamed("key", "member")
    return rows.join(classes, F.col("key") == F.col("member"), "left").withColumn("root", F.coalesce("root", "key"))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, text) -> doc_id, class_id (smallest doc_id of the class), class_size: one row per document.

    Equal texts are one class, null and empty texts among them; texts without words are similar to nothing else. Rows
    without a doc_id belong to classes too; a class of only such rows has a null id.
    """
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", text_key(text).alias("key"), text_of(text).alias("text"))
    rooted = durable(_rooted(keyed.select("doc_id", "key"), keyed.select("key", "text"), threshold).select("doc_id", "root"))
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rooted.join(classes, "root").select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class: the smallest doc_id, null last; of rows equal in doc_id and text, one. All columns stay."""
    text = F.col("text").cast("string")
    key, row = fresh(docs, "key"), fresh(docs, "row")
    keyed = docs.select(text_key(text).alias("key"), text_of(text).alias("text"), "doc_id")
    rooted = _rooted(keyed.select("doc_id", "key"), keyed.select("key", "text"), threshold)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("f"))
    kept = durable(first.select(F.col("f.key").alias("kept_key"), F.col("f.doc_id").alias("kept_id")))
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), text_key(text).alias(key))
    chosen = wide.join(kept, (F.col(key) == F.col("kept_key")) & F.col(f"{row}.doc_id").eqNullSafe(F.col("kept_id")),
                       "left_semi")
    return chosen.groupBy(key, F.col(f"{row}.doc_id").alias("id")).agg(F.first(row).alias(row)).select(f"{row}.*")


def op7_bag_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the id and the size of its class of near copies."""
    return near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"op7_bag_minhash": op7_bag_minhash}
ORACLES: dict[str, str] = {}
