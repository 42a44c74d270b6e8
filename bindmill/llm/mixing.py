"""Mixing sources to target weights: Pareto order sampling after whole copies.

Every document expects ``min(limit, c * favour)`` copies; ``c`` is set per source so that the expected words equal the
source's target. The integer part of the expectation is taken for certain. The fraction ``p`` is an inclusion
probability: documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with a hashed uniform ``u``, and the first ones
are taken until the words that are still due are reached (the document at the cut goes where it leaves the smaller
error). The sample's size is thus fixed in words, which is what targets are set in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bindmill.llm.common import n_words, number_rows, read, text_of
from bindmill.session import durable

WEIGHTS = (5, 2, 1)
LIMIT = 3  # copies of a document, and a source's target in units of its size
STEPS = 4096  # ranges that one pass over the ranks tells apart
SEED = "mixture-1"
#: Documents of at least so many words are favoured by one more part each.
FAVOURED_FROM = (50, 200, 1000)


def favour(words: Column) -> Column:
    """1 to 4, by length: longer documents carry more context per copy."""
    return reduce(lambda a, b: a + b, [(words >= least).cast("int") for least in FAVOURED_FROM], F.lit(1))


def _uniform(*columns: Column) -> Column:
    """In (0, 1), from a hash of the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, size) -> source, source_size, weight, target; sources by code point, null last.

    The water level (words per unit of weight) rises until no source is above ``limit`` times its size; only the
    level and the number of full sources reach the driver.
    """
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "rank")
    parts = F.array(*[F.lit(float(w)) for w in weights])
    weighed = durable(ranked.select("source", F.col("size").alias("source_size"), F.element_at(
        parts, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).alias("weight")))
    cap = F.col("source_size") * float(limit)
    level, full = 0.0, -1
    while True:
        above = (F.col("weight") * F.lit(level) >= cap) if full >= 0 else F.lit(False)
        row = weighed.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(above, cap)).alias("capped"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("full")).first()
        if not row["open"] or row["full"] == full:
            break
        level, full = (row["words"] - (row["capped"] or 0.0)) / row["open"], row["full"]
    return weighed.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _copies_per_favour(due: Column, words: list[Column], limit: int) -> Column:
    """The factor c with sum(min(limit, c * g) * words of class g) = due, for classes g = 1, 2, ...

    Classes fill up from the most favoured one; the first number of full classes that leaves no other above the limit
    is the right one.
    """
    choice = F.lit(float(limit))  # all full
    for full in reversed(range(len(words))):
        open_classes = [(g + 1, w) for g, w in enumerate(words)][:len(words) - full]
        left = due - sum((float(limit) * w for w in words[len(words) - full:]), F.lit(0.0))
        rest = sum((float(g) * w for g, w in open_classes), F.lit(0.0))
        factor = F.when(rest > 0, left / rest)
        choice = F.when(factor * open_classes[-1][0] <= limit, factor).otherwise(choice)
    return choice


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(mix_source, mix_size, mix_draw, + any) -> the same rows with mix_source_size, mix_target, mix_copies.

    ``mix_draw`` is a uniform in (0, 1) that depends on the document alone. Rows are read several times, so ``docs``
    should be a stored table. Sizes of 0 take no words and get the certain copies alone. Rows of equal rank are equal
    in draw and size; which of them is taken at the cut does not matter.
    """
    classes = range(1, len(FAVOURED_FROM) + 2)
    part = docs.withColumn("mix_part", favour(F.col("mix_size")))
    words = part.groupBy(F.col("mix_source").alias("source")).agg(
        F.sum("mix_size").alias("size"),
        *[F.sum(F.when(F.col("mix_part") == g, F.col("mix_size")).otherwise(0)).alias(f"words_{g}") for g in classes])
    words = durable(words)
    of_class = [F.col(f"words_{g}").cast("double") for g in classes]
    factor = _copies_per_favour(F.col("target"), of_class, limit)
    expected = lambda g, c: F.least(F.lit(float(limit)), c * g)
    certain = sum((F.floor(expected(F.lit(g), F.col("factor"))) * w for g, w in zip(classes, of_class)), F.lit(0.0))
    targets = source_targets(words.select("source", "size"), weights, limit).withColumnRenamed("source", "s")
    plan = durable(words.join(targets, words["source"].eqNullSafe(targets["s"])).withColumn("factor", factor).select(
        F.col("source").alias("plan_source"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), "factor", (F.col("target") - certain).alias("due")))

    def with_rank(df: DataFrame) -> DataFrame:
        joined = df.join(plan, F.col("mix_source").eqNullSafe(F.col("plan_source")))
        mean = expected(F.col("mix_part"), F.col("factor"))
        p, u = mean - F.floor(mean), F.col("mix_draw")
        odds = (u / (1 - u)) * (1 - p) / F.when(p > 0, p)  # random odds over inclusion odds
        return joined.withColumn("mix_certain", F.floor(mean).cast("long")).withColumn(
            "mix_rank", F.when(F.col("mix_size") > 0, odds / (1 + odds)))

    ranked = with_rank(part)
    step = F.least(F.floor(F.col("mix_rank") * STEPS), F.lit(STEPS - 1)).cast("int")
    fine = F.least(F.floor((F.col("mix_rank") * STEPS - F.col("step")) * STEPS), F.lit(STEPS - 1)).cast("int")

    def crossing(df: DataFrame, by: str, due: str, out: str) -> DataFrame:
        """Per source the first range whose running words reach what is due, and what is due inside it."""
        order = Window.partitionBy("plan_source").orderBy(by)  # at most STEPS rows per source
        sums = df.groupBy("plan_source", by).agg(F.sum("mix_size").alias("w"), F.first(due).alias("d"))
        run = sums.withColumn("upto", F.sum("w").over(order)).where(F.col("upto") >= F.col("d"))
        first = run.withColumn("n", F.row_number().over(order)).where("n = 1")
        return first.select(F.col("plan_source").alias(f"{out}_source"), F.col(by).alias(out),
                            (F.col("d") - F.col("upto") + F.col("w")).alias(f"{out}_due"))

    def beside(df: DataFrame, cut: DataFrame, out: str) -> DataFrame:
        return df.join(cut, F.col("plan_source").eqNullSafe(F.col(f"{out}_source")), "left")

    stepped = ranked.withColumn("step", step).withColumn("fine", fine)
    drawn = stepped.where(F.col("mix_rank").isNotNull())
    cut = durable(crossing(drawn, "step", "due", "cut"))
    inside = beside(drawn, cut, "cut").where(F.col("step") == F.col("cut"))
    fine_cut = durable(crossing(inside, "fine", "cut_due", "fine_cut"))
    last = durable(beside(inside, fine_cut, "fine_cut").where(F.col("fine") == F.col("fine_cut")).groupBy(
        "plan_source", "mix_rank", "mix_size", "fine_cut_due").agg(F.count("*").alias("n")))
    order = Window.partitionBy("plan_source").orderBy("mix_rank", "mix_size")
    before = F.sum(F.col("mix_size") * F.col("n")).over(order) - F.col("mix_size") * F.col("n")
    taken_last = last.withColumn("before", before).where(
        F.col("before") + F.col("mix_size") * F.col("n") / 2 <= F.col("fine_cut_due"))
    edge = durable(taken_last.groupBy("plan_source").agg(F.max("mix_rank").alias("edge")).select(
        F.col("plan_source").alias("edge_source"), "edge"))
    judged = beside(beside(stepped, cut, "cut"), fine_cut, "fine_cut")
    judged = judged.join(edge, F.col("plan_source").eqNullSafe(F.col("edge_source")), "left")
    below = F.when(F.col("cut").isNull(), F.col("due") > 0).otherwise(
        (F.col("step") < F.col("cut")) | (F.col("step") == F.col("cut")) & F.coalesce(
            (F.col("fine") < F.col("fine_cut")) | (F.col("mix_rank") <= F.col("edge")), F.lit(False)))
    extra = F.coalesce((F.col("mix_rank").isNotNull() & below).cast("long"), F.lit(0))
    return judged.withColumn("mix_copies", F.col("mix_certain") + extra).select(
        *[F.col(f"`{c}`") for c in docs.columns], "mix_source_size", "mix_target", "mix_copies")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it (0 to ``limit`` times); all columns are kept as they are.

    Null sources are a source of their own, null texts have size 0. Rows are told apart by doc_id and text; repeated
    rows share the decision of their rank.
    """
    text = F.col("text").cast("string")
    prefix = "mixed__"
    wide = docs.select(F.struct("*").alias(prefix + "row"), F.col("source").cast("string").alias("mix_source"),
                       n_words(text).alias("mix_size"), _uniform(F.col("doc_id"), text_of(text)).alias("mix_draw"))
    thin = durable(wide.groupBy("mix_source", "mix_size", "mix_draw").agg(F.count("*").alias("mix_rows")))
    expanded = thin.withColumn("mix_nth", F.explode(F.sequence(F.lit(1), F.col("mix_rows")))).drop("mix_rows")
    mixed = mix(expanded, weights, limit).where(F.col("mix_copies") > 0).groupBy(
        F.col("mix_source").alias("s"), F.col("mix_draw").alias("u"), F.col("mix_size").alias("z")).agg(
        F.min("mix_copies").alias("copies"))
    joined = wide.join(mixed, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_draw") == F.col("u"))
                       & (F.col("mix_size") == F.col("z")))
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(f"{prefix}row.*")


def op4_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes from it.

    Null texts have size 0 and give no words; null sources are one source, ordered last.
    """
    text = F.col("text").cast("string")
    sizes = durable(read(spark, folder, "documents").select(
        "doc_id", F.col("source").cast("string").alias("mix_source"), n_words(text).alias("mix_size"),
        _uniform(F.col("doc_id"), text_of(text)).alias("mix_draw")))
    mixed = mix(sizes)
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").cast("long").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
        F.col("mix_copies").alias("copies"))


QUERIES = {"op4_pareto_mix": op4_pareto_mix}
ORACLES: dict[str, str] = {}
