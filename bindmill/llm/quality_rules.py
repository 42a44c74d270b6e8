"""Document rules: base counts, and the distance of a document's histograms to those of its language.

A language's reference is the histogram of character classes and of its most common short words over all its
documents. A document whose histograms lie too far from the reference, by Jensen-Shannon distance (the root of the
divergence in bits, 0 to 1), is rejected; short documents are not judged, as their histograms say little. DataFrame
functions only: every count is made inside the document's row, nothing of a text is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bindmill.llm.common import GAP, WORD, read, text_of
from bindmill.session import durable

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words inside repeated three-word windows
SYMBOLS = "#*$%&|<>"
COMMON = 16  # words per language
COMMON_LENGTH = 5  # a common word has at most so many characters
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.36
CLASSES = ("upper", "other_letter", "digit", "symbol", "punctuation")
CODES = "abcdefghijklmnopqrstuvwxyz"


def _length(column: Column) -> Column:
    return F.length(column).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text_of(text), GAP), "")


def window_hashes(words: str) -> Column:
    """Hashes of all three-word windows of the array ``words``."""
    return F.expr(f"if(size({words}) < 3, cast(array() as array<bigint>), transform(sequence(0, size({words}) - 3), "
                  f"i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])))")


def repeated_words(hashes: str) -> Column:
    """Number of words inside three-word windows that are there twice or more.

    Most texts repeat no window, which the number of distinct hashes tells. Else the hashes are sorted with their
    places, so equal ones stand together; the places of repeated ones, in order, cover up to three words each, fewer
    where the next one starts earlier.
    """
    pairs = f"sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = "(k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)"
    places = f"sort_array(array_compact(transform(s, (x, k) -> if({twice}, x.i, null))))"
    covered = "aggregate(zip_with(r, slice(r, 2, size(r)), (a, b) -> least(3, coalesce(b - a, 3))), 0, (s, x) -> s + x)"
    inner = f"transform(array({places}), r -> {covered})[0]"
    return F.expr(f"if(size(array_distinct({hashes})) = size({hashes}), 0L, "
                  f"cast(transform(array({pairs}), s -> {inner})[0] as bigint))")


def marks_of(text: Column) -> Column:
    """The characters of words that are no letters, in order."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[^\p{L}\s]+"), F.lit(0)), "")


def n_symbols(marks: Column) -> Column:
    return F.regexp_count(marks, F.lit(f"[{SYMBOLS}]")).cast("long")


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    repeated = F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0]
    return F.when(F.instr(text, "\n") > 0, repeated).otherwise(F.lit(0).cast("long"))


def _class_counts(text: Column, marks: Column, word_chars: Column) -> Column:
    """Characters of words by class."""
    upper = F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")
    others, symbols = _length(marks), n_symbols(marks)
    digits = F.regexp_count(marks, F.lit(r"\p{Nd}")).cast("long")
    return F.array(upper, F.greatest(word_chars - others - upper, F.lit(0)), digits, symbols,
                   F.greatest(others - digits - symbols, F.lit(0)))


def _shares(counts: Column) -> Column:
    """Counts as shares of their sum; null where the sum is 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; null if either is null."""
    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)))


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(text, lang) -> ref_lang, common words, class_shares, word_shares: one row per language, null a language too.

    Counts cover all documents; words are counted in the task that reads them before they are exchanged.
    """
    body = docs.select("lang", text_of(F.col("text")).alias("text"))
    parted = body.select("lang", "text", words_of(F.col("text")).alias("words"), marks_of(F.col("text")).alias("marks"))
    classes = parted.select("lang", F.size("words").alias("n_words"), _class_counts(
        F.col("text"), F.col("marks"), _length(F.array_join("words", ""))).alias("c"))
    by_class = durable(classes.groupBy("lang").agg(
        F.array(*[F.sum(F.col("c")[i]).cast("double") for i in range(len(CLASSES))]).alias("class_counts"),
        F.sum("n_words").alias("total")))
    # outer, as Spark would part a text a second time to see that it has words
    words = body.select("lang", F.explode_outer(words_of(F.col("text"))).alias("word"))
    short = words.where(F.length("word") <= COMMON_LENGTH).select("lang", F.lower("word").alias("word"))  # never shorter
    counts = durable(short.where(F.length("word") <= COMMON_LENGTH).groupBy("lang", "word").agg(F.count("*").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common)
    listed = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    keyed = listed.withColumnRenamed("lang", "top_lang")
    both = by_class.withColumnRenamed("lang", "ref_lang").join(
        keyed, F.col("ref_lang").eqNullSafe(F.col("top_lang")), "left").drop("top_lang")
    none = F.array().cast("array<string>")
    found = F.coalesce(F.transform("top", lambda x: x["n"].cast("double")), F.array().cast("array<double>"))
    sums = F.aggregate(found, F.lit(0.0), lambda a, b: a + b)
    word_counts = F.concat(found, F.array(F.coalesce(F.col("total").cast("double"), F.lit(0.0)) - sums))
    listed_words = F.coalesce(F.transform("top", lambda x: x["word"]), none)
    return durable(both.select("ref_lang", listed_words.alias("common"),
                               _shares(F.col("class_counts")).alias("class_shares"),
                               _shares(word_counts).alias("word_shares")))


def judge_documents(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
                    common: int = COMMON) -> DataFrame:
    """(text, lang, ...) -> all columns with the base counts, class_distance, word_distance, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Null languages share a reference. Documents under
    ``MIN_WORDS`` words get no distances. Texts of any length are counted whole, inside their row. New columns replace
    those of the same names.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance",
           "base_failed", "kept")
    kept_columns = [c for c in docs.columns if c.lower() not in new]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row"),
                         F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    refs = references(packed.select("lang", "text"), common)
    reference = ("common", "class_shares", "word_shares")
    counted = packed.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").select(
        "row", *reference, text_of(F.col("text")).alias("text"))
    parted = counted.select("row", *reference, "text", words_of(F.col("text")).alias("words"),
                            marks_of(F.col("text")).alias("marks"))
    code = F.transform(F.filter("words", lambda w: F.length(w) <= COMMON_LENGTH), lambda w: F.substring(
        F.lit("-" + CODES[:common]), (F.coalesce(F.array_position("common", F.lower(w)), F.lit(0)) + 1).cast("int"), 1))
    measured = parted.select(
        "row", *reference, "text", "marks", F.size("words").cast("long").alias("n_words"),
        _length(F.array_join("words", "")).alias("word_chars"), n_symbols(F.col("marks")).alias("n_symbols"),
        _duplicate_lines(F.col("text")).alias("n_dup_lines"), window_hashes("words").alias("hashes"),
        F.replace(F.array_join(code, ""), F.lit("-"), F.lit("")).alias("codes"))
    of_word = [(_length(F.col("codes")) - _length(F.replace("codes", F.lit(letter), F.lit("")))).cast("double")
               for letter in CODES[:common]]
    present = F.slice(F.array(*of_word), 1, F.size("common"))
    with_counts = measured.select(
        "row", *reference, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeated_words("hashes").alias("n_repeat_words"),
        F.concat(present, F.array((F.col("n_words") - _length(F.col("codes"))).cast("double"))).alias("word_counts"),
        F.transform(_class_counts(F.col("text"), F.col("marks"), F.col("word_chars")),
                    lambda x: x.cast("double")).alias("class_counts"))
    long_enough = F.col("n_words") >= MIN_WORDS
    class_distance = F.when(long_enough, distance(_shares(F.col("class_counts")), F.col("class_shares")))
    word_distance = F.when(long_enough, distance(_shares(F.col("word_counts")), F.col("word_shares")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    told = with_counts.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        class_distance.alias("class_distance"), word_distance.alias("word_distance"), failed.alias("base_failed"))
    close = (F.coalesce(F.col("class_distance") <= max_class, F.lit(True))
             & F.coalesce(F.col("word_distance") <= max_word, F.lit(True)))
    return told.select("row.*", *new[:-1], (~F.col("base_failed") & close).alias("kept"))


def op8_distribution_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's base counts, distances to its language, and verdict."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    return judge_documents(docs).drop("text", "lang")


QUERIES = {"op8_distribution_rules": op8_distribution_rules}
ORACLES: dict[str, str] = {}
