"""Column functions. All stay in the JVM and return NULL instead of raising under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F




def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def p_activity(value_nm: Column | str) -> Column:
    """Negative decimal logarithm of a concentration given in nanomolar."""
    return -F.log10(_c(value_nm) * F.lit(1e-9))


def coverage(start, end, ref_start, ref_end, inclusive: bool = True) -> Column:
    """Share of the reference segment that the observed segment spans."""
    one = F.lit(1 if inclusive else 0)
    return F.try_divide(_c(end) - _c(start) + one, _c(ref_end) - _c(ref_start) + one)


def to_number(col: Column | str) -> Column:
    """Numeric value of a text; anything that is not a number becomes NULL."""
    number = _c(col).try_cast("double")
    return F.when(~F.isnan(number), number)


def digits_to_int(col: Column | str) -> Column:
    """Integer of a token made of digits only; signs and other text give NULL."""
    token = _c(col)
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("int"))


def split_list(col: Column | str, sep: str = ",") -> Column:
    """Distinct, trimmed, non-empty items of a delimited text."""
    items = F.transform(F.split(_c(col), sep), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def composite_key(*cols, sep: str = "|", missing: str = "nan") -> Column:
    """Text key of several columns; a missing part keeps its place."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit(missing)) for c in cols])


def fixed_field(line: Column | str, first: int, last: int) -> Column:
    """Trimmed text of the 1-based columns ``first`` to ``last`` of a fixed-width line."""
    return F.trim(F.substring(_c(line), first, last - first + 1))


def put_field(line: Column | str, first: int, last: int, value: Column) -> Column:
    """Line with the columns ``first`` to ``last`` replaced by ``value``, right-aligned."""
    line, width = _c(line), last - first + 1
    return F.concat(F.substring(line, 1, first - 1), F.lpad(value, width, " "),
                    F.substring(line, F.lit(last + 1), F.length(line)))


def swap_extension(name: Column | str, old: str, new: str) -> Column:
    return F.regexp_replace(_c(name), f"\\.{old}$", f".{new}")


def entry_of_file(file_name: Column | str) -> Column:
    """Part of a file name before its first dot."""
    return F.regexp_extract(_c(file_name), r"^([^.]+)", 1)


def has_word(text: Column | str, words: list[str]) -> Column:
    """Whether one of the words stands alone in the text; letters of any script end no word."""
    alternatives = "|".join(words)
    edge = r"[\p{L}\p{N}_]"
    return F.lower(_c(text)).rlike(f"(?<!{edge})({alternatives})(?!{edge})")


def binary_label(value: Column | str, threshold: float, inclusive: bool = True) -> Column:
    value = _c(value)
    return (value >= threshold if inclusive else value > threshold).cast("int")


def dot(a, b) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    squares = F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def set_tanimoto(a, b) -> Column:
    """Tanimoto similarity of two arrays read as sets."""
    shared = F.size(F.array_intersect(_c(a), _c(b))).cast("double")
    return F.try_divide(shared, F.size(F.array_union(_c(a), _c(b))).cast("double"))


def vector_columns(vector: Column | str, prefix: str, size: int) -> list[Column]:
    """One column ``prefix1 … prefixN`` per vector entry, for export."""
    return [F.get(_c(vector), F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(size)]
