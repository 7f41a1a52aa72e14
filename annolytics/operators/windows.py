"""Ranked rows, group maxima, latest rows, weighted means, grid sectors and zones."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_blocks


def top_n(df: DataFrame, by: Sequence[str], method: str, score: str, n: int = 2, keep: str | None = None) -> DataFrame:
    """Per group, the ``n`` methods with the highest mean score (ties by name), plus the baseline."""
    means = df.groupBy(*by, method).agg(F.avg(score).alias("mean_score"))
    w = Window.partitionBy(*by).orderBy(F.desc("mean_score"), method)
    best = means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    if keep is None:
        return best
    # rank of the baseline by counting better rows, so the limited ranking above keeps its early cut-off
    base = means.where(F.col(method) == keep)
    extra = base.join(best.select(*by, method), [*by, method], "left_anti").withColumn("rank", F.lit(None).cast("int"))
    return best.unionByName(extra)


def report_top_n(
    df: DataFrame, by: Sequence[str], method: str, score: str, epoch: str, baseline: str, n: int = 2, after: int = 20
) -> DataFrame:
    """Report of training runs: mean scores of epochs later than ``after``, the ``n`` best methods per group, and
    how far each is above the ``baseline`` method, as numbers and as text. ``delta`` is given where it is among
    the ``n`` largest of its group too; without a baseline it is null."""
    means = df.where(F.col(epoch) > after).groupBy(*by, method).agg(F.avg(score).alias("mean_score"))
    base = means.where(F.col(method) == baseline).select(*by, F.col("mean_score").alias("__base"))
    gain = means.join(base, list(by), "left").withColumn("delta", F.col("mean_score") - F.col("__base")).drop("__base")
    group = Window.partitionBy(*by)
    ranked = gain.withColumns({
        "rank": F.row_number().over(group.orderBy(F.desc("mean_score"), method)),
        "__gain": F.row_number().over(group.orderBy(F.desc("delta"), method)),
    })
    best = ranked.where(F.col("rank") <= n).withColumn("delta", F.when(F.col("__gain") <= n, F.col("delta"))).drop("__gain")
    return delta_text(best, "mean_score", "delta")


def delta_text(df: DataFrame, value: str, delta: str, name: str = "text") -> DataFrame:
    return df.withColumn(name, F.when(F.col(value).isNotNull() & F.col(delta).isNotNull(), F.format_string("%.3f (%.3f)", value, delta)))


def arg_max_rows(df: DataFrame, by: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """Whole row of the group maximum; the smallest ``order`` on a tie. Combines before the shuffle."""
    top = df.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.max(score).alias("__m")
    )
    # two combinable passes: the maximum, then the first row among those that reach it
    tied = df.join(top, list(by)).where(F.col(score) == F.col("__m")).drop("__m")
    rest = [c for c in df.columns if c not in by]
    return tied.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def scale_by_group_max(df: DataFrame, by: Sequence[str], value: str, name: str = "scaled") -> DataFrame:
    """Value over its group's maximum: the aggregate is joined back, so a big group stays spread out."""
    top = df.groupBy(*by).agg(F.max(value).alias("__m"))
    return df.join(top, list(by)).withColumn(name, F.try_divide(value, "__m")).drop("__m")


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def call_fingerprint(tool: str, args: Column) -> Column:
    """md5 of ``tool:`` and the arguments as JSON with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(args)))
    return F.md5(F.concat(F.col(tool), F.lit(":"), F.to_json(ordered)))


def dedup_calls(df: DataFrame, fingerprint: str, order: Sequence[str]) -> DataFrame:
    """Last write per fingerprint."""
    return latest_per_key(df, [fingerprint], order)


def evict(df: DataFrame, tool: str, column: str = "tool_name") -> DataFrame:
    """Forget one tool's results, by its name."""
    return df.where(~F.col(column).eqNullSafe(F.lit(tool)))


def drop_mock(df: DataFrame, flag: Column) -> DataFrame:
    return df.where(~F.coalesce(flag, F.lit(False)))


def call_stats(df: DataFrame, tool: str = "tool_name") -> DataFrame:
    return df.groupBy(tool).agg(F.count(F.lit(1)).alias("n"))


def ewma(df: DataFrame, by: Sequence[str], seq: str, value: str, span: int, name: str = "ewma") -> DataFrame:
    """Exponentially weighted mean, α = 2/(span+1), started at the first value. ``seq`` counts from 0.

    Inside a block of m positions and the m before it, the mean is a running sum of scaled values. m is
    such that anything older weighs less than 1e-100, so blocks are independent, no power overflows, and
    a long group is never held by one task.
    """
    alpha = 2 / (span + 1.0)
    keep = 1 - alpha
    if keep <= 0:
        return df.select(*by, seq, value, F.col(value).cast("double").alias(name))
    m = max(1, math.ceil(230 / -math.log(keep)))
    blocks = in_blocks(df.select(*by, seq, value), seq, before=m, size=m)
    at = F.col(seq) - (F.col("__block") - 1) * m  # 0 … 2m-1 inside a block and its halo
    weight = F.when(F.col(seq) == 0, 1.0).otherwise(alpha)
    w = Window.partitionBy(*by, "__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(F.col(value) * weight * F.pow(F.lit(keep), -at)).over(w)
    return blocks.withColumn(name, scaled * F.pow(F.lit(keep), at)).where("__home").select(*by, seq, value, name)


# Ring radii of the grid in disc diameters, and the divisor that estimates the diameter.
RINGS = (("central", 0.33), ("inner", 1.0), ("outer", 2.0))
FOVEA_DISC_DIVISOR = 2.5


def sector_counts(points: DataFrame, centers: DataFrame, image: str = "image", lesion: str = "lesion", area: str | None = None) -> DataFrame:
    """Lesion count and area per (image, lesion, ring, quadrant) of a grid round the fovea.

    ``centers`` holds (image, fovea_x, fovea_y, disc_x, disc_y). Quadrants are turned so that nasal points
    to the disc; image y grows downwards. The central ring has no quadrants; points beyond two
    disc diameters are outside the grid.
    """
    turn = 2 * math.pi
    j = points.join(centers, image)
    dx, dy = F.col("x") - F.col("fovea_x"), F.col("y") - F.col("fovea_y")
    ox, oy = F.col("disc_x") - F.col("fovea_x"), F.col("disc_y") - F.col("fovea_y")
    dd = F.sqrt(ox * ox + oy * oy) / FOVEA_DISC_DIVISOR
    dist = F.sqrt(dx * dx + dy * dy)
    ring = None
    for label, r in RINGS:
        ring = F.when(dist <= dd * r, label) if ring is None else ring.when(dist <= dd * r, label)
    angle = F.pmod(F.atan2(dy, dx) - F.atan2(oy, ox) + math.pi / 4, F.lit(turn))
    quadrant = F.element_at(
        F.array(*[F.lit(q) for q in ("nasal", "inferior", "temporal", "superior")]),
        F.least(F.floor(angle / (turn / 4)).cast("int"), F.lit(3)) + 1,
    )
    rows = j.select(image, lesion, ring.alias("ring"), quadrant.alias("q"), *([area] if area else []))
    placed = rows.where("ring is not null").withColumn(
        "quadrant", F.when(F.col("ring") == "central", "all").otherwise(F.col("q"))
    )
    size = F.sum(area) if area else F.count(F.lit(1))
    return placed.groupBy(image, lesion, "ring", "quadrant").agg(
        F.count(F.lit(1)).alias("n"), size.cast("double").alias("area")
    )


def assign_zones(points: DataFrame, discs: DataFrame, image: str = "image") -> DataFrame:
    """Each point once per zone it lies in: whole, B = (2r, 3r], C = (2r, 5r] round the disc centre."""
    j = points.join(discs.select(image, "disc_x", "disc_y", "disc_r"), image)
    dx, dy = F.col("x") - F.col("disc_x"), F.col("y") - F.col("disc_y")
    d, r = F.sqrt(dx * dx + dy * dy), F.col("disc_r")
    outside = d > r * 2
    zones = F.array_compact(F.array(
        F.lit("whole"), F.when(outside & (d <= r * 3), "B"), F.when(outside & (d <= r * 5), "C")
    ))
    return j.select(*points.columns, F.explode(zones).alias("zone"))
