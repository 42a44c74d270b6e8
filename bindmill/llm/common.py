"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bindmill.session import durable

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(column, F.lit(""))


def n_words(column: Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def text_key(column: Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(text_of(column).cast("binary")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a gapless row number from 0 in the given order.

    Rows are dealt by ranges of the order and sorted inside their partition; a row's number is its place there plus
    the rows of the partitions before, a table of one row per partition. Rows that the order cannot tell apart are
    dealt by their place in the input, so repeated rows never pile up in one range. The dealt rows are written once,
    because ranges come from a sample and must not be drawn twice.
    """
    place, part, before = (fresh(df, x) for x in ("place", "part", "before"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = fresh(df, "tie")
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie))
    stored = durable(dealt.drop(tie).withColumn(place, F.monotonically_increasing_id()))
    stored = stored.withColumn(part, F.shiftrightunsigned(F.col(place), 33))
    counts = stored.groupBy(part).agg(F.count("*").alias(before))  # one row per partition
    counts = counts.withColumn(before, F.sum(before).over(Window.orderBy(part)) - F.col(before))
    number = F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before)
    numbered = stored.join(F.broadcast(counts), part)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))
