"""Evaluation metrics: accuracy, confusion matrices, kappa, AUC, mask agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import attach_row, running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def accuracy(df: DataFrame, correct: str = "is_correct") -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("correct"))
    return out.withColumn("percent", _ratio(F.col("correct") * 100, F.col("total")))


def confusion_matrix(df: DataFrame, labels: Sequence[int], gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Long matrix (gt, pred, n) over the full label grid; pairs outside the list are ignored."""
    values = [int(x) for x in labels]
    counts = (
        df.where(F.col(gt).isin(values) & F.col(pred).isin(values))
        .groupBy(F.col(gt).cast("int").alias("gt"), F.col(pred).cast("int").alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    items = F.array(*[F.lit(v) for v in values])
    grid = df.sparkSession.range(1).select(F.explode(items).alias("gt")).withColumn("pred", F.explode(items))
    return grid.join(counts, ["gt", "pred"], "left").select("gt", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_wide(matrix: DataFrame, labels: Sequence[int]) -> DataFrame:
    return matrix.groupBy("gt").pivot("pred", [int(x) for x in labels]).agg(F.sum("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Per class: sensitivity, specificity, precision, F1, support; a zero denominator gives 0."""
    # each cell counts for its gt class, its pred class and the total: three small sums, one pass
    cells = matrix.select(
        "n",
        F.explode(F.array_distinct(F.array("gt", "pred"))).alias("label"), "gt", "pred",
    )
    per = cells.groupBy("label").agg(
        F.sum(F.when((F.col("gt") == F.col("label")) & (F.col("pred") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("gt") == F.col("label")) & (F.col("pred") != F.col("label")), F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when((F.col("gt") != F.col("label")) & (F.col("pred") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
    )
    with_total = attach_row(per, matrix.agg(F.sum("n").alias("total")))
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    tn = F.col("total") - tp - fn - fp
    rates = with_total.select(
        "label", (tp + fn).alias("support"), _ratio(tp, tp + fn).alias("sensitivity"),
        _ratio(tn, tn + fp).alias("specificity"), _ratio(tp, tp + fp).alias("precision"),
    )
    p, s = F.col("precision"), F.col("sensitivity")
    return rates.withColumn("f1", _ratio(p * s * 2, p + s))


def averaged_f1(per_class: DataFrame) -> DataFrame:
    """Macro and support-weighted precision, recall and F1."""
    support = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), support)

    return per_class.agg(
        F.avg("f1").alias("macro_f1"), weighted("f1").alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"), weighted("precision").alias("weighted_precision"),
        F.avg("sensitivity").alias("macro_recall"), weighted("sensitivity").alias("weighted_recall"),
    )


def quadratic_kappa(matrix: DataFrame) -> DataFrame:
    """1 - Σ w·O / Σ w·E with w = (i-j)².

    Σ w·E needs only the moments of the two label distributions, so no row × column product is formed.
    """
    i, j, n = F.col("gt").cast("double"), F.col("pred").cast("double"), F.col("n")
    m = matrix.agg(
        F.sum(n).alias("n"), F.sum((i - j) * (i - j) * n).alias("o"),
        F.sum(i * n).alias("si"), F.sum(j * n).alias("sj"), F.sum(i * i * n).alias("sii"), F.sum(j * j * n).alias("sjj"),
    )
    expected = F.col("sii") + F.col("sjj") - F.try_divide(F.col("si") * F.col("sj") * 2, F.col("n"))
    return m.select((F.lit(1.0) - F.try_divide("o", expected)).alias("kappa"))


def balanced_accuracy(per_class: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur."""
    return per_class.where("support > 0").agg(F.avg("sensitivity").alias("balanced_accuracy"))


def auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rank AUC with averaged ties. Rows collapse to distinct scores with counts before any ordering.

    A positive with score x beats the negatives below x and half of those equal to x.
    """
    table = (
        df.where(F.col(score).isNotNull() & positive.isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("__x"))
        .agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    )
    sums = running_sums(table, by, "__x", {"q_upto": "q"})
    wins = F.sum(F.col("p") * (F.col("q_upto") - F.col("q") * 0.5))
    totals = sums.groupBy(*by).agg(wins.alias("wins"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    area = F.try_divide(F.col("wins"), F.col("n_pos").cast("double") * F.col("n_neg"))
    return totals.select(*by, area.alias("auc"), "n_pos", "n_neg")


def auc_ovo(df: DataFrame, probs: str, label: str, classes: int, average: str = "macro") -> DataFrame:
    """One-vs-one AUC: for each class pair the mean of both directions; macro or prevalence-weighted mean."""
    others = F.filter(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: c != F.col(label))
    # a row meets each other class twice: as positive of its own class, as negative of the other's
    pairs = F.flatten(F.transform(others, lambda c: F.array(
        F.struct(F.col(label).cast("int").alias("a"), c.alias("b"), F.get(F.col(probs), F.col(label).cast("int")).alias("s"), F.lit(True).alias("pos")),
        F.struct(c.alias("a"), F.col(label).cast("int").alias("b"), F.get(F.col(probs), c).alias("s"), F.lit(False).alias("pos")),
    )))
    rows = df.select(F.explode(pairs).alias("r")).select("r.*")
    directed = auc(rows, "s", F.col("pos"), ["a", "b"])
    pair = directed.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(
        F.avg("auc").alias("auc"), (F.max(F.col("n_pos") + F.col("n_neg"))).alias("n")
    )
    if average == "macro":
        return pair.agg(F.avg("auc").alias("auc"))
    if average == "weighted":
        return pair.agg(F.try_divide(F.sum(F.col("auc") * F.col("n")), F.sum("n")).alias("auc"))
    raise ValueError(f"unknown average {average!r}")


def mask_agreement(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Agreement of two binary masks given as one row per pixel with 0/1 flags.

    Dice of two empty masks is 1. The ratio family is all 0 as soon as one of them cannot be computed.
    ``positive_agreement`` is the intersection over all pixels.
    """
    a, p = F.col(actual) > 0, F.col(predicted) > 0
    c = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a & p).alias("tp"), F.count_if(a & ~p).alias("fn"),
        F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"),
    )
    tp, fn, fp, tn, n = (F.col(x) for x in ("tp", "fn", "fp", "tn", "n"))
    sens, spec, prec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp), F.try_divide(tp, tp + fp)
    values = {
        "acc": F.try_divide(tp + tn, n), "sensitivity": sens, "specificity": spec, "precision": prec,
        "g_mean": F.sqrt(sens * spec), "f1": F.try_divide(prec * sens * 2, prec + sens),
        "mse": F.try_divide((fn + fp).cast("double"), n), "iou": F.try_divide(tp, tp + fn + fp),
    }
    usable = None
    for v in values.values():
        usable = v.isNotNull() if usable is None else usable & v.isNotNull()
    dice = F.when(tp * 2 + fn + fp == 0, 1.0).otherwise(F.try_divide(tp * 2, tp * 2 + fn + fp))
    return c.select(
        *by, dice.alias("dice"), F.try_divide(tp, n).alias("positive_agreement"),
        *[F.when(usable, v).otherwise(F.lit(0.0)).alias(k) for k, v in values.items()],
    )
