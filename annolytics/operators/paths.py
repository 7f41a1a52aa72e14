"""Curve measures over ordered points (image, vessel, seq, x, y); ``seq`` is dense and starts at 0.

Neighbour lookups run on blocks of consecutive points with a small halo (see ``ordering``), so a very
long path is spread over tasks; everything else is combinable aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_blocks

KEY = ("image", "vessel")


def _steps(points: DataFrame, by: Sequence[str], lag: int = 1, lead: int = 0, block: int | None = None) -> DataFrame:
    """Points with previous (and next) coordinates as x_1, y_1, … and xn, yn."""
    extra = {} if block is None else {"size": block}
    b = in_blocks(points.select(*by, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "seq", lag, lead, **extra)
    w = Window.partitionBy(*by, "__block").orderBy("seq")
    cols = {}
    for i in range(1, lag + 1):
        cols[f"x_{i}"], cols[f"y_{i}"] = F.lag("x", i).over(w), F.lag("y", i).over(w)
    if lead:
        cols["xn"], cols["yn"] = F.lead("x", 1).over(w), F.lead("y", 1).over(w)
    return b.withColumns(cols).where("__home").drop("__home")


def _dist(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def _ends() -> list[Column]:
    p = F.struct("x", "y")
    return [F.min_by(p, "seq").alias("a"), F.max_by(p, "seq").alias("z")]


def path_lengths(points: DataFrame, by: Sequence[str] = KEY, block: int | None = None) -> DataFrame:
    """Per path: points, length, chord and length/chord."""
    step = _dist(F.col("x_1"), F.col("y_1"), F.col("x"), F.col("y"))
    s = _steps(points, by, block=block).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(step), F.lit(0.0)).alias("length"), *_ends()
    )
    chord = _dist(F.col("a.x"), F.col("a.y"), F.col("z.x"), F.col("z.y"))
    return s.select(*by, "n", "length", chord.alias("chord"), F.try_divide(F.col("length"), chord).alias("tortuosity"))


def path_tortuosity(
    points: DataFrame, min_points: int = 10, inclusive: bool = False, by: Sequence[str] = KEY, block: int | None = None
) -> DataFrame:
    """Per image: mean tortuosity over paths with more than ``min_points`` points (at least, if ``inclusive``)."""
    p = path_lengths(points, by, block)
    kept = p.where(F.col("n") >= min_points) if inclusive else p.where(F.col("n") > min_points)
    return kept.groupBy(by[0]).agg(
        F.count(F.lit(1)).alias("vessels"), F.avg("tortuosity").alias("tortuosity"), F.sum("length").alias("length")
    )


def inflection_metrics(points: DataFrame, by: Sequence[str] = KEY, block: int | None = None) -> DataFrame:
    """Inflections, inflection-count tortuosity and tortuosity density per path.

    A point is an inflection when the sign of the y step into it differs from the sign of the step out
    of it. The path is cut before each inflection; the part after the last one does not count.
    """
    flagged = _steps(points, by, lag=1, lead=1, block=block).withColumn(
        "turn",
        F.when(
            F.col("y_1").isNotNull() & F.col("yn").isNotNull()
            & (F.signum(F.col("y") - F.col("y_1")) != F.signum(F.col("yn") - F.col("y"))), 1
        ).otherwise(0),
    )
    # running number of turns: inside each block, plus the turns of earlier blocks (one row per block)
    inside = Window.partitionBy(*by, "__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = flagged.withColumn("__c", F.sum("turn").over(inside))
    totals = flagged.groupBy(*by, "__block").agg(F.sum("turn").alias("__t"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__block", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__o"))
    seg = local.join(offsets, [*by, "__block"]).withColumn("segment", F.col("__c") + F.col("__o"))
    step = _dist(F.col("x_1"), F.col("y_1"), F.col("x"), F.col("y"))
    parts = seg.groupBy(*by, "segment").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(step), F.lit(0.0)).alias("walk"),
        F.coalesce(F.sum(F.when(F.col("turn") == 0, step)), F.lit(0.0)).alias("curve"), *_ends(),
    )
    chord = _dist(F.col("a.x"), F.col("a.y"), F.col("z.x"), F.col("z.y"))
    excess = F.when(chord > 0, F.col("curve") / chord - 1).otherwise(0.0)
    first = F.min_by("a", "segment")
    last = F.max_by("z", "segment")
    per = parts.withColumn("excess", excess).groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("segment").alias("inflections"), F.sum("walk").alias("length"),
        F.sum("excess").alias("all_excess"), F.max_by("excess", "segment").alias("tail_excess"),
        first.alias("a"), last.alias("z"),
    )
    k = F.col("inflections")
    tort = F.try_divide(F.col("length"), _dist(F.col("a.x"), F.col("a.y"), F.col("z.x"), F.col("z.y")))
    density = (k - 1) / k + F.try_divide(F.col("all_excess") - F.col("tail_excess"), "length")
    return per.select(
        *by, "n", "inflections", (tort * (k + 1)).alias("inflection_tortuosity"),
        F.when(k > 0, density).otherwise(0.0).alias("tortuosity_density"),
    )


def smooth_path(points: DataFrame, window: int = 4, by: Sequence[str] = KEY, block: int | None = None) -> DataFrame:
    """Trailing mean over ``window`` points, shorter at the start."""
    extra = {} if block is None else {"size": block}
    b = in_blocks(points, "seq", before=window - 1, **extra)
    w = Window.partitionBy(*by, "__block").orderBy("seq").rowsBetween(-(window - 1), 0)
    return b.withColumns({"sx": F.avg("x").over(w), "sy": F.avg("y").over(w)}).where("__home").drop("__home", "__block")


def curvature_tortuosity(points: DataFrame, by: Sequence[str] = KEY, block: int | None = None) -> DataFrame:
    """|∫ curvature| by centred differences and the trapezoid rule; the second difference is divided by 4.

    Null when some inner point has no direction (its two neighbours coincide).
    """
    s = _steps(points, by, lag=1, lead=1, block=block).where("x_1 is not null and xn is not null")
    x1, y1 = (F.col("xn") - F.col("x_1")) / 2, (F.col("yn") - F.col("y_1")) / 2
    x2, y2 = (F.col("xn") - F.col("x") * 2 + F.col("x_1")) / 4, (F.col("yn") - F.col("y") * 2 + F.col("y_1")) / 4
    k = F.try_divide(x1 * y2 - x2 * y1, F.pow(y1 * y1 + x1 * x1, F.lit(1.5)))
    # the trapezoid sum over unit spacing is the plain sum less half of both ends
    agg = s.select(*by, "seq", k.alias("k")).groupBy(*by).agg(
        F.sum("k").alias("s"), F.min_by("k", "seq").alias("k0"), F.max_by("k", "seq").alias("k1"),
        F.count(F.lit(1)).alias("m"), F.count("k").alias("mk"),
    )
    value = F.abs(F.col("s") - (F.col("k0") + F.col("k1")) / 2)
    return agg.select(*by, F.when(F.col("m") == F.col("mk"), value).alias("curvature_tortuosity"))


def line_fit_tortuosity(points: DataFrame, samples: int = 6, by: Sequence[str] = KEY) -> DataFrame:
    """How well the chord line explains sampled points (every max(round(n/samples), 1)-th, ends excluded).

    With a zero division x and y are swapped; if that fails too the value is 1. Needs 4 points, else null.
    """
    ends = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *_ends())
    stepped = ends.withColumn("step", F.greatest(F.bround(F.col("n") / samples), F.lit(1)).cast("long"))
    j = points.select(*by, "seq", "x", "y").join(stepped, list(by))
    inner = j.where((F.col("seq") >= 1) & (F.col("seq") < F.col("n") - 1) & ((F.col("seq") - 1) % F.col("step") == 0))
    # at most about 2·samples points per path are left: they fit one row
    rows = inner.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("a").alias("a"), F.first("z").alias("z"),
        F.array_sort(F.collect_list(F.struct("seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("p"),
    )

    def ratio(u: str, v: str) -> Column:
        def total(f) -> Column:
            return F.aggregate("p", F.lit(0.0), lambda s, q: s + f(q))

        a_u, a_v = F.col(f"a.{u}").cast("double"), F.col(f"a.{v}").cast("double")
        slope = F.try_divide(F.col(f"z.{v}") - a_v, F.col(f"z.{u}") - a_u)
        mean = total(lambda q: q[v]) / F.size("p")
        top = total(lambda q: F.pow((q[u] - a_u) * slope + a_v - mean, F.lit(2)))
        bottom = total(lambda q: F.pow(q[v] - mean, F.lit(2)))
        return F.try_divide(top, bottom)

    value = F.coalesce(ratio("x", "y"), ratio("y", "x"), F.lit(1.0))
    fit = F.when(F.isnan(value), 0.0).otherwise(value)
    return rows.select(*by, F.when(F.col("n") >= 4, fit).alias("line_fit"))


def share_above(fits: DataFrame, threshold: float = 0.8, by: str = "image") -> DataFrame:
    """Per image: share of paths whose line fit exceeds the threshold."""
    return fits.where("line_fit is not null").groupBy(by).agg(
        F.count(F.lit(1)).alias("vessels"),
        (F.count_if(F.col("line_fit") > threshold) / F.count(F.lit(1))).alias("share"),
    )
