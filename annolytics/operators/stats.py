"""Grouped statistics and reports over classified, generated and measured rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import _null_safe, attach_row, running_sums


def classification_stats(df: DataFrame, dataset: str = "dataset", label: str = "label") -> DataFrame:
    """Counts per dataset, type and subtype and over all datasets, with percent of the dataset total.

    Rows are first counted per (dataset, type, subtype); the grouping sets run over those counts.
    ``level`` is total, unclassified, classified, type or subtype; dataset is null over all.
    """
    base = df.groupBy(
        F.col(dataset).alias("dataset"), F.col(f"{label}.type").alias("type"), F.col(f"{label}.subtype").alias("subtype")
    ).agg(F.count(F.lit(1)).alias("n"))
    flagged = base.withColumn("known", F.col("type").isNotNull())
    sets = flagged.groupingSets(
        [("dataset",), ("dataset", "known"), ("dataset", "known", "type"), ("dataset", "known", "type", "subtype"),
         (), ("known",), ("known", "type"), ("known", "type", "subtype")],
        "dataset", "known", "type", "subtype",
    ).agg(
        F.sum("n").alias("n"), F.grouping("dataset").alias("g_d"), F.grouping("known").alias("g_k"),
        F.grouping("type").alias("g_t"), F.grouping("subtype").alias("g_s"),
    )
    level = (
        F.when(F.col("g_k") == 1, "total")
        .when((F.col("g_t") == 1) & F.col("known"), "classified")
        .when(F.col("g_t") == 1, "unclassified")
        .when(F.col("g_s") == 1, "type")
        .otherwise("subtype")
    )
    rows = sets.withColumn("level", level).where(F.col("known").isNull() | F.col("known") | (F.col("level") == "unclassified"))
    totals = rows.where("level = 'total'").select(F.col("dataset").alias("__d"), F.col("n").alias("total"))
    joined = rows.join(totals, F.col("dataset").eqNullSafe(F.col("__d")))
    return joined.select("dataset", "level", "type", "subtype", "n", (F.col("n") / F.col("total") * 100).alias("percent"))


def top_answers(df: DataFrame, k: int = 20, answer: str = "ground_truth_answer", label: str = "label") -> DataFrame:
    """Most common answers among unclassified rows; ties by answer."""
    return (
        df.where(F.col(label).isNull()).groupBy(F.col(answer).alias("answer")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "answer").limit(k)
    )


def frequent_answers(df: DataFrame, k: int = 20, answer: str = "ground_truth_answer", label: str = "label", tracked: int = 100_000) -> DataFrame:
    """``top_answers`` in one small aggregation per task: a frequent-items sketch over hashes names candidates, whose
    rows are then counted exactly. Whole texts are not grouped.

    An answer can be missed only when it occurs less often than all rows divided by about a third of ``tracked``.
    """
    rows = df.where(F.col(label).isNull()).select(F.col(answer).alias("answer")).where("answer IS NOT NULL").withColumn("__h", F.xxhash64("answer"))
    sketch = rows.agg(F.call_function("approx_top_k", F.col("__h"), F.lit(min(10 * k, tracked)), F.lit(tracked)).alias("found"))
    candidates = sketch.select(F.explode("found.item").alias("__h"))  # at most 10 k rows
    kept = rows.join(F.broadcast(candidates), "__h")
    counts = kept.groupBy("__h").agg(F.count(F.lit(1)).alias("n"), F.min("answer").alias("answer"))
    return counts.select("answer", "n").orderBy(F.desc("n"), "answer").limit(k)


def run_report(df: DataFrame, trajectory: str = "trajectory", type_col: str = "type", subtype_col: str = "subtype") -> DataFrame:
    """Total, success and failed counts and the type-subtype distribution of successes, as (section, name, n, percent)."""
    ok = F.col(trajectory).isNotNull()
    name = F.concat_ws("-", type_col, subtype_col)
    counts = df.groupBy(ok.alias("ok"), name.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    def line(section: str, name: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("name"), F.col("n").alias("n"))

    outcome = F.when(F.col("ok"), "success").otherwise("failed")
    lines = F.array(line("status", F.lit("total")), line("status", outcome), line("type", F.when(F.col("ok"), F.col("kind"))))
    parts = counts.select(F.explode(lines).alias("r")).select("r.*").where("name is not null")
    sums = parts.groupBy("section", "name").agg(F.sum("n").alias("n"))
    base = counts.agg(F.sum("n").alias("__total"), F.sum(F.when(F.col("ok"), F.col("n"))).alias("__ok"))
    joined = attach_row(sums, base)
    whole = F.when(F.col("section") == "status", F.col("__total")).otherwise(F.col("__ok"))
    return joined.select("section", "name", "n", F.coalesce(F.try_divide(F.col("n") * 100, whole), F.lit(0.0)).alias("percent"))


def tool_usage(df: DataFrame, log: str = "tool_execution_log") -> DataFrame:
    return (
        df.select(F.explode(log).alias("e")).groupBy(F.col("e.tool_name").alias("tool_name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def batch_status(log: DataFrame, dataset: str = "dataset", status: str = "status", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last status per dataset, then datasets per status; every known status is listed."""
    last = log.groupBy(dataset).agg(F.max_by(status, F.struct(*order)).alias("status"))
    counts = last.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    known = log.sparkSession.createDataFrame([("completed",), ("failed",), ("skipped",), ("pending",)], "status string")
    return counts.join(F.broadcast(known), "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def method_means(df: DataFrame, metrics: Sequence[str], method: str = "method") -> DataFrame:
    return df.groupBy(F.col(method).alias("method")).agg(*[F.avg(m).alias(m) for m in metrics])


def delta_vs_baseline(df: DataFrame, metrics: Sequence[str], baseline: str, method: str = "method") -> DataFrame:
    """Mean of each metric per method, and its difference to the baseline method's mean."""
    means = method_means(df, metrics, method)
    base = means.where(F.col("method") == baseline).select(*[F.col(m).alias(f"__b_{m}") for m in metrics])
    joined = attach_row(means, base)
    return joined.select(
        "method", *metrics, *[(F.col(m) - F.col(f"__b_{m}")).alias(f"{m}_delta") for m in metrics]
    )


def class_distribution(df: DataFrame, label: str, split: str | None = None, percent: bool = True) -> DataFrame:
    """Rows per (split, class) with share of the split and an ``n (p%)`` text.

    The share is multiplied by 100 in the text; ``percent=False`` prints the bare fraction with a % sign.
    """
    split_col = F.lit("all") if split is None else F.col(split)
    counts = df.groupBy(split_col.alias("split"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("split").agg(F.sum("n").alias("__t"))
    joined = counts.join(totals, "split").withColumn("share", F.col("n") / F.col("__t"))
    shown = F.col("share") * 100 if percent else F.col("share")
    return joined.select("split", "label", "n", "share", F.format_string("%d (%.2f%%)", "n", shown).alias("text"))


def positive_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of positive rows in each 0/1 column: (category, positives, total, share)."""
    sums = df.agg(*[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(c) for c in columns], F.count(F.lit(1)).alias("__n"))
    return sums.unpivot(["__n"], list(columns), "category", "positives").select(
        "category", "positives", F.col("__n").alias("total"), F.try_divide("positives", "__n").alias("share")
    )


def histogram(
    df: DataFrame, value: str, by: Sequence[str], bins: int = 258, lo: float = -1.0, hi: float = 257.0
) -> DataFrame:
    """Fixed-width counts per group over [lo, hi), values clipped into the range, empty bins present."""
    width = (hi - lo) / bins
    clipped = F.least(F.greatest(F.floor((F.col(value) - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, clipped.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_pair(
    df: DataFrame, value: str, is_healthy: Column, by: Sequence[str], bins: int = 258, lo: float = -1.0, hi: float = 257.0
) -> DataFrame:
    """Both classes' histograms side by side: (by, bin, healthy, diseased), empty bins present."""
    flagged = df.withColumn("__h", is_healthy)
    h = histogram(flagged, value, [*by, "__h"], bins, lo, hi)
    return h.groupBy(*by, "bin").agg(
        F.sum(F.when(F.col("__h"), F.col("n")).otherwise(0)).alias("healthy"),
        F.sum(F.when(~F.col("__h"), F.col("n")).otherwise(0)).alias("diseased"),
    )


def ks_binned(hist: DataFrame, by: Sequence[str], healthy: str = "healthy", diseased: str = "diseased", bins: int = 258) -> DataFrame:
    """Largest distance of the two cumulative shares over the inner bins.

    The outermost bins' counts replace their inner neighbours' before the outer bins are dropped,
    so counts of bins 1 and ``bins-2`` themselves are overwritten.
    """
    # 258 rows per group at most: the fold over one group is bounded by the bin count
    source = F.when(F.col("bin") == 0, 1).when(F.col("bin") == bins - 1, bins - 2).otherwise(F.col("bin"))
    kept = hist.where(~F.col("bin").isin(1, bins - 2)).withColumn("bin", source)
    ordered = kept.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("bin", F.col(healthy).cast("double").alias("h"), F.col(diseased).cast("double").alias("d")))).alias("b"),
        F.sum(healthy).alias("nh"), F.sum(diseased).alias("nd"),
    )
    zero = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("d"), F.lit(0.0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        h, d = acc["h"] + x["h"], acc["d"] + x["d"]
        gap = F.abs(h / F.col("nh") - d / F.col("nd"))
        return F.struct(h.alias("h"), d.alias("d"), F.greatest(acc["best"], gap).alias("best"))

    ks = F.aggregate("b", zero, step, lambda acc: acc["best"])
    return ordered.select(*by, F.when((F.col("nh") > 0) & (F.col("nd") > 0), ks).alias("ks"))


def ks_exact(df: DataFrame, value: str, is_a: Column, by: Sequence[str]) -> DataFrame:
    """Two-sample KS distance over raw values: distinct values with counts, then distributed prefix sums."""
    table = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(
        F.count_if(is_a).alias("a"), F.count_if(~is_a).alias("b")
    )
    sums = running_sums(table, by, "__x", {"ca": "a", "cb": "b"})
    totals = table.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    joined = _null_safe(sums, totals, by, "inner") if by else attach_row(sums, totals)
    gap = F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))
    return joined.groupBy(*by).agg(F.max(gap).alias("ks"))


def consistency(hist: DataFrame, by: Sequence[str], counts: Sequence[str] = ("healthy", "diseased")) -> DataFrame:
    """Population standard deviation over images and bins together, per group and class."""
    return hist.groupBy(*by).agg(*[F.stddev_pop(c).alias(f"{c}_std") for c in counts])


def mean_histogram(hist: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    return hist.groupBy(*by, "bin").agg(F.avg(count).alias("mean_n"))


def method_separability(df: DataFrame, lesions: Sequence[str] | None = None, channels: Sequence[str] = ("red", "green", "blue"),
                        method: str = "method_name", lesion: str = "lesion_name") -> DataFrame:
    """Least score over rows per channel, then the greatest over channels."""
    rows = df if lesions is None else df.where(F.col(lesion).isin(*lesions))
    worst = rows.groupBy(F.col(method).alias("method")).agg(*[F.min(c).alias(c) for c in channels])
    best = F.greatest(*channels) if len(channels) > 1 else F.col(channels[0])
    return worst.select("method", best.alias("separability"))


def correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r over complete pairs (infinities count as 1) with its two-sided p value."""
    def finite(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(F.abs(x) == float("inf"), 1.0).otherwise(F.when(F.isnan(x), None).otherwise(x))

    pairs = df.select(*by, finite(a).alias("x"), finite(b).alias("y")).where("x is not null and y is not null")
    r = pairs.groupBy(*by).agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("p", p_value_of_r(F.col("r"), F.col("n")))


@F.pandas_udf(T.DoubleType())
def _two_sided_p(r: pd.Series, n: pd.Series) -> pd.Series:
    def incomplete_beta(a: float, b: float, x: float) -> float:
        """Regularised incomplete beta by its continued fraction (Lentz)."""
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - incomplete_beta(b, a, 1 - x)
        front = math.exp(
            math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
        ) / a
        f, c, d = 1.0, 1.0, 0.0
        for i in range(1000):
            m = i // 2
            if i == 0:
                num = 1.0
            elif i % 2 == 0:
                num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
            if abs(1 - c * d) < 1e-14:
                break
        return front * (f - 1)

    def one(rv, nv):
        if rv is None or rv != rv or nv < 3:
            return None if nv < 2 or rv is None or rv != rv else 1.0
        free = nv - 2
        return incomplete_beta(free / 2, 0.5, max(0.0, 1 - rv * rv))

    return pd.Series([one(rv, nv) for rv, nv in zip(r, n)], dtype="float64")


def p_value_of_r(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation: one value per aggregated row."""
    return _two_sided_p(r, n)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * count) per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return attach_row(counts, total).select("label", "n", (F.col("__n") / (F.col("__k") * F.col("n"))).alias("weight"))


def melt_channels(df: DataFrame, ids: Sequence[str], channels: Sequence[str] = ("red", "green", "blue")) -> DataFrame:
    return df.unpivot(list(ids), list(channels), "channel", "score")


def valid_summary(df: DataFrame, column: str, sentinel: float = -1) -> DataFrame:
    """n, mean, median and sample standard deviation over rows that are not the sentinel."""
    ok = df.where(F.col(column) != sentinel).select(F.col(column).cast("double").alias("v"))
    basic = ok.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return attach_row(basic, exact_median(ok, "v")).select("n", "mean", "median", "std")


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One-row ``median`` through distinct values and distributed prefix sums, not one task's memory."""
    table = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("c"))
    sums = running_sums(table, [], "__x", {"upto": "c"})
    ranked = attach_row(sums, table.agg(F.sum("c").alias("__n")))
    low, high = F.floor((F.col("__n") + 1) / 2), F.ceil((F.col("__n") + 1) / 2)
    middle = ranked.where((F.col("upto") >= low) & (F.col("upto") - F.col("c") < high))
    return middle.agg(((F.min("__x") + F.max("__x")) / 2).alias("median"))


def listing(df: DataFrame, name: str, column: str, sentinel: float = -1, digits: int = 3) -> DataFrame:
    """Per-image text, ``N/A`` for missing values."""
    shown = F.format_string(f"%.{digits}f", F.col(column).cast("double"))
    missing = F.col(column).isNull() | (F.col(column) == sentinel)
    return df.select(F.col(name).alias("name"), F.when(missing, "N/A").otherwise(shown).alias("value"))
