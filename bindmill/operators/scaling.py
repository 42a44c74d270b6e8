"""Standardisation fitted on one split, feature assembly, compute-once features."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bindmill.operators import moments
from bindmill.operators.vectors import vector_hygiene
from bindmill.session import durable

SPREAD = 1024  # join keys that rows without a key are dealt to


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """Feature columns as one array of doubles; other columns stay."""
    return df.select(*[c for c in df.columns if c not in columns],
                     F.array(*[F.col(c).cast("double") for c in columns]).alias(name))


def concat_features(df: DataFrame, blocks: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.concat(*[F.col(b).cast("array<double>") for b in blocks])).drop(
        *[b for b in blocks if b != name])


def whole_blocks(df: DataFrame, blocks: list[str], missing: str = "columns", fill: float = 0.0,
                 constant: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, report): rows whose vector columns have no gaps, and one row that tells what went.

    ``missing`` is what goes where a vector or an element is missing: ``columns`` drops the positions that are missing
    in some row and keeps every row, ``rows`` drops the rows, ``fill`` puts ``fill`` there. With ``constant``, positions
    whose present elements are all equal go too. The report has n_rows, n_rows_dropped, n_positions,
    n_positions_dropped (missing or constant) and n_filled.
    """
    if missing not in ("columns", "rows", "fill"):
        raise ValueError(f"unknown choice {missing}")
    hygiene = durable(vector_hygiene(df, blocks))
    size = F.max(F.col("dim") + 1)
    widths = {b: 0 for b in blocks} | {r.block: r.n for r in hygiene.groupBy("block").agg(size.alias("n")).collect()}
    whole = {b: [] for b in blocks}
    for r in hygiene.where("n_missing = 0").select("block", "dim").orderBy("dim").collect():  # one row per position
        whole[r.block].append(r.dim)

    flat = {b: set() for b in blocks}
    for r in hygiene.where("variance = 0").select("block", "dim").collect() if constant else ():
        flat[r.block].add(r.dim)
    places = {b: [i for i in (whole[b] if missing == "columns" else range(widths[b])) if i not in flat[b]] for b in blocks}

    def cell(block: str, at: Column) -> Column:
        """The element, null if it or its vector is missing."""
        return F.nanvl(F.get(F.col(block).cast("array<double>"), at), F.lit(None).cast("double"))

    def broken(block: str) -> Column:
        return F.exists(F.array(*map(F.lit, gaps[block])).cast("array<int>"), lambda i: cell(block, i).isNull())

    def kept(block: str) -> Column:
        at = F.array(*map(F.lit, places[block])).cast("array<int>")
        return F.transform(at, lambda i: F.coalesce(cell(block, i), F.lit(fill)))

    gaps = {b: sorted(set(range(widths[b])) - set(whole[b])) for b in blocks}
    # a block that no row has breaks every row
    lost = reduce(Column.__or__, [broken(b) if widths[b] else F.lit(True) for b in blocks])
    rows = df.where(~lost) if missing == "rows" else df
    rows = rows.withColumns({b: kept(b) for b in blocks}) if missing != "rows" or constant else rows
    n_positions, n_kept = sum(widths.values()), sum(map(len, places.values()))
    if not n_kept:
        raise ValueError(f"every position of {blocks} is missing in some row or constant")
    dropped = F.count_if(lost) if missing == "rows" else F.lit(0).cast("long")
    n_filled = hygiene.agg(F.coalesce(F.sum("n_missing"), F.lit(0))).scalar() if missing == "fill" else F.lit(0)
    report = df.agg(F.count(F.lit(1)).alias("n_rows"), dropped.alias("n_rows_dropped")).select(
        "n_rows", "n_rows_dropped", F.lit(n_positions).cast("long").alias("n_positions"),
        F.lit(n_positions - n_kept).cast("long").alias("n_positions_dropped"),
        n_filled.cast("long").alias("n_filled"))
    return rows, durable(report)


def fit_scaler(train: DataFrame, features: str = "features") -> DataFrame:
    """One row with the mean and population deviation of every feature; a constant feature gets scale 1.

    Missing elements are left out of both. Tasks exchange a row per feature.
    """
    per_feature = moments.pair_sums(train, features, "self").select(
        F.col("i").alias("at"), moments.mean().alias("mean"), F.sqrt(moments.variance(sample=False)).alias("std"))
    scale = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    entries = F.array_sort(F.collect_list(F.struct("at", "mean", scale.alias("scale"))))
    return per_feature.agg(entries.alias("e")).select(F.struct(
        F.transform("e", lambda x: x["mean"]).alias("mean"),
        F.transform("e", lambda x: x["scale"]).alias("scale")).alias("scaler"))


def apply_scaler(df: DataFrame, scaler: DataFrame, features: str = "features") -> DataFrame:
    fitted = df.withColumn("_scaler", scaler.select("scaler").scalar())
    centred = F.zip_with(features, "_scaler.mean", lambda x, m: x - m)
    return fitted.withColumn(features, F.zip_with(centred, "_scaler.scale", lambda x, s: x / s)).drop("_scaler")


def scale_on_train(df: DataFrame, split: str = "split", train: str = "train",
                   features: str = "features") -> DataFrame:
    return apply_scaler(df, fit_scaler(df.filter(F.col(split) == train), features), features)


def attach_per_distinct(df: DataFrame, key: str, compute: Callable[[Iterable], Iterable],
                        schema: str, skip: str | None = None) -> DataFrame:
    """Run a featuriser once per distinct key and join the result back.

    ``compute`` maps an iterator of pandas frames with the key column to frames
    of ``schema`` (key included). Keys containing ``skip`` are not computed.
    Keys meet by a hash of 128 bits, so texts are exchanged once, where they
    are made distinct; missing keys are spread over ``SPREAD`` places.
    """
    def mark(c: Column) -> Column:
        return F.md5(c.cast("string"))

    asked = df.filter(F.col(key).isNotNull()).select(mark(F.col(key)).alias("_mark"), key)
    if skip is not None:
        asked = asked.filter(~F.col(key).contains(skip))
    keys = asked.groupBy("_mark").agg(F.first(key).alias(key)).select(key)
    done = keys.mapInPandas(compute, schema)
    made = done.withColumn("_mark", mark(F.col(key))).drop(key)
    nowhere = F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))
    marked = df.withColumn("_mark", F.coalesce(mark(F.col(key)), nowhere))
    return marked.join(made, "_mark", "left").select(key, *[c for c in df.columns if c != key],
                                                     *[c for c in made.columns if c != "_mark"])
