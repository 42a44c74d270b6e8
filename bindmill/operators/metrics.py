"""Binary classifier scores, for any number of splits in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindmill.operators.grouping import running_totals
from bindmill.session import durable

ACTIVITY_CUT = 6.5
DECISION_CUT = 0.5


def predict(df: DataFrame, score: str, name: str = "predicted_label", threshold: float = DECISION_CUT) -> DataFrame:
    return df.withColumn(name, (F.col(score) >= threshold).cast("int"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, split: str, label: str, prediction: str) -> DataFrame:
    hit, said = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(split).agg(
        F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"),
        F.count_if(~hit & ~said).alias("tn"), F.count_if(hit & ~said).alias("fn"))


def threshold_metrics(df: DataFrame, split: str, label: str, prediction: str) -> DataFrame:
    """Confusion counts, accuracy, recall, precision, F1 and MCC; 0 where a denominator is 0."""
    return _with_metrics(confusion(df, split, label, prediction))


def _with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "recall": _ratio(tp, tp + fn),
        "precision": _ratio(tp, tp + fp), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt(product))})


def _per_score(df: DataFrame, split: str, label: str, score: str) -> DataFrame:
    return df.groupBy(split, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _area(per_score: DataFrame, split: str) -> DataFrame:
    ranked = running_totals(per_score.filter("_score is not null"), [split], "_score", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(split).agg(F.when(pairs > 0, F.try_divide(wins, pairs)).alias("auc"))


def roc_auc(df: DataFrame, split: str, label: str, score: str) -> DataFrame:
    """Area under the ROC curve per split; ties count half, one class only gives NULL."""
    return _area(_per_score(df, split, label, score), split)


def evaluate(df: DataFrame, split: str, label: str, score: str, threshold: float = DECISION_CUT) -> DataFrame:
    """All metrics of all splits; ``df`` is computed once, as a stored table of counts per score."""
    counted = durable(_per_score(df, split, label, score))
    said = F.col("_score") >= threshold
    counts = counted.groupBy(split).agg(*[
        F.coalesce(F.sum(F.when(asked, F.col(kind))), F.lit(0)).alias(name)
        for name, asked, kind in (("tp", said, "pos"), ("fp", said, "neg"), ("tn", ~said, "neg"), ("fn", ~said, "pos"))])
    return _with_metrics(counts).join(_area(counted, split), split, "left")


def class_report(df: DataFrame, split: str, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    c = confusion(df, split, label, prediction)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.alias("support"))

    one = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    zero = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fp + fn), tn + fp)
    total = tp + fp + tn + fn
    accuracy = _ratio(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [_ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])]
    rows = [row("0", *zero), row("1", *one), row("accuracy", accuracy, accuracy, accuracy, total),
            row("macro avg", *macro, total), row("weighted avg", *weighted, total)]
    return c.select(split, F.inline(F.array(*rows)))


def well_predicted(df: DataFrame, label: str, score: str, keep: list[str],
                   threshold: float = DECISION_CUT) -> DataFrame:
    """Rows whose prediction is right, with label, score and prediction."""
    scored = predict(df, score, threshold=threshold)
    return scored.filter(F.col("predicted_label") == F.col(label)).select(
        *keep, F.col(label).alias("true_label"), F.col(score).alias("predicted_proba"), "predicted_label")
