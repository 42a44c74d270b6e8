"""Row filters, column hygiene and whole-group gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bindmill.schema import numeric_columns


def measure_filter(df: DataFrame, equal: dict[str, object], positive: str | None = None,
                   present: str | None = None) -> DataFrame:
    """Rows with the given values, a positive measure and/or a present measure."""
    tests: list[Column] = [F.col(c) == v for c, v in equal.items()]
    if positive:
        tests.append(F.col(positive) > 0)
    if present:
        tests.append(F.col(present).isNotNull())
    return df.filter(reduce(Column.__and__, tests))


def not_equal_or_missing(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose value differs; missing values differ from everything."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def same_value(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.filter(F.col(left) == F.col(right))


def constant_shares(df: DataFrame, column: str, value: object) -> DataFrame:
    """How many rows carry one constant, how many do not."""
    hit = F.count_if(F.col(column) == value)
    return df.agg(hit.alias("n_kept"), (F.count(F.lit(1)) - hit).alias("n_other"),
                  F.count(F.lit(1)).alias("n_total"))


def long_enough(df: DataFrame, column: str, least: int) -> DataFrame:
    return df.filter(F.length(column) >= least)


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def drop_columns(df: DataFrame, unwanted: list[str]) -> DataFrame:
    """All columns but the unwanted ones; names that are not there are passed over."""
    return df.select(*[c for c in df.columns if c not in unwanted])


def columns_first(df: DataFrame, first: list[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def column_quality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: rows, missing rows, sample variance. One pass over the table."""
    names = columns or numeric_columns(df)
    stats = [F.struct(F.lit(c).alias("column"),
                      F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("n_null"),
                      F.count(F.lit(1)).alias("n_rows"),
                      F.var_samp(F.col(c).cast("double")).alias("variance")) for c in names]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def clean_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Numeric columns without missing values and with some variance, in table order.

    A single row has no sample variance and keeps its columns.
    """
    good = {r["column"] for r in column_quality(df, columns)
            .filter((F.col("n_null") == 0) & ((F.col("n_rows") < 2) | (F.col("variance") != 0)))
            .select("column").collect()}  # one short row per column
    return [c for c in (columns or numeric_columns(df)) if c in good]


def drop_weak_columns(df: DataFrame, meta: list[str]) -> DataFrame:
    """Meta columns plus the clean numeric columns, each once."""
    numeric = [c for c in clean_columns(df) if c not in meta]
    return df.select(*[c for c in meta if c in df.columns], *numeric)


def group_gate(df: DataFrame, group: str, bad_row: Column) -> DataFrame:
    """Drop every group that holds at least one bad row."""
    bad = df.filter(bad_row).select(group).distinct()
    return df.join(bad, group, "left_anti")


def ratio_gate(df: DataFrame, group: str, doubtful: Column, valid: Column, threshold: float) -> DataFrame:
    """Groups whose doubtful rows exceed a share of the valid rows (at least one)."""
    counted = df.groupBy(group).agg(F.count_if(doubtful).alias("n_doubtful"), F.count_if(valid).alias("n_valid"))
    share = F.col("n_doubtful") / F.greatest(F.col("n_valid"), F.lit(1))
    return counted.withColumn("share", share).filter(F.col("share") > threshold)
