"""Measurements over sparse pixel tables (image, x, y, class): areas, boxes, extents, calibres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .examples import VESSEL_FEATURES, VESSEL_TYPES, ZONES


def area_metrics(px: DataFrame, dims: DataFrame, image: str = "image", vessel: str = "vessel", skeleton: str | None = None) -> DataFrame:
    """Positive pixels over all pixels, and mean width = vessel pixels / skeleton pixels."""
    aggs = [F.count_if(F.col(vessel) > 0).alias("positives")]
    if skeleton:
        aggs.append(F.count_if(F.col(skeleton) > 0).alias("skeleton"))
    counts = px.groupBy(image).agg(*aggs)
    out = dims.join(counts, image, "left").select(
        image, "width", "height", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts.columns if c != image]
    )
    out = out.withColumn("density", F.try_divide("positives", F.col("width") * F.col("height")))
    return out.withColumn("mean_width", F.try_divide("positives", "skeleton")) if skeleton else out


def box_dimension(px: DataFrame, dims: DataFrame, image: str = "image") -> DataFrame:
    """Box-counting dimension with box sizes 2ⁿ … 4, counting boxes neither empty nor full.

    Pixels collapse to 4-boxes once; larger boxes are summed from those, not from pixels. A partial box
    at the edge is full only at size². Null when some size has no counted box.
    """
    x, y = F.col("x"), F.col("y")
    # distinct pixels of a 4-box as a 16-bit mask, so duplicates need no separate shuffle
    bit = F.expr("shiftleft(1, cast((y % 4) * 4 + x % 4 as int))")
    small = px.groupBy(image, F.floor(x / 4).alias("bx"), F.floor(y / 4).alias("by")).agg(
        F.bit_count(F.bit_or(bit)).cast("long").alias("n")
    )
    side = F.floor(F.log2(F.least("width", "height"))).cast("int")
    levels = dims.select(image, F.explode(F.sequence(F.lit(2), side)).alias("level")).where("level >= 2")
    # levels per image: log2(side)-1 rows
    per = dims.select(image, F.sequence(F.lit(2), side).alias("levels"))
    spread = small.join(per, image).select(image, "bx", "by", "n", F.explode("levels").alias("level"))
    scaled = spread.groupBy(
        image, "level",
        F.expr("shiftright(bx, level - 2)").alias("bx"), F.expr("shiftright(by, level - 2)").alias("by"),
    ).agg(F.sum("n").alias("n"))
    full = F.expr("shiftleft(1L, 2 * level)")
    counts = scaled.where(F.col("n") < full).groupBy(image, "level").agg(F.count(F.lit(1)).alias("boxes"))
    table = levels.join(counts, [image, "level"], "left").withColumn("log_size", F.col("level") * F.log(F.lit(2.0)))
    slope = F.regr_slope(F.log("boxes"), F.col("log_size"))
    return table.groupBy(image).agg(
        F.when(F.count("boxes") == F.count(F.lit(1)), -slope).alias("fractal_dimension")
    )


def disc_metrics(px: DataFrame, image: str = "image", kind: str = "kind") -> DataFrame:
    """Extents of disc and cup, cup/disc ratios and the cup centroid; -1 where they cannot be computed."""
    def where(k: str, c: Column) -> Column:
        return F.when(F.col(kind) == k, c)

    x, y = F.col("x"), F.col("y")
    aggs = []
    for k in ("disc", "cup"):
        for axis, c in (("x", x), ("y", y)):
            aggs += [F.min(where(k, c)).alias(f"{k}_min_{axis}"), F.max(where(k, c)).alias(f"{k}_max_{axis}"),
                     F.avg(where(k, c)).alias(f"{k}_mean_{axis}")]
    e = px.groupBy(image).agg(*aggs)

    def extent(k: str, axis: str) -> Column:
        return F.coalesce(F.col(f"{k}_max_{axis}") - F.col(f"{k}_min_{axis}"), F.lit(-1)).cast("long")

    out = e.withColumns({
        "disc_height": extent("disc", "y"), "disc_width": extent("disc", "x"),
        "cup_height": extent("cup", "y"), "cup_width": extent("cup", "x"),
    })

    def ratio(a: str, b: str) -> Column:
        ok = (F.col(a) >= 0) & (F.col(b) > 0)
        return F.when(ok, F.col(a) / F.col(b)).otherwise(F.lit(-1.0))

    return out.withColumns({
        "CDR_vertical": ratio("cup_height", "disc_height"), "CDR_horizontal": ratio("cup_width", "disc_width"),
        "cup_centre_x": F.coalesce(F.col("cup_mean_x").cast("long"), F.lit(-1)),
        "cup_centre_y": F.coalesce(F.col("cup_mean_y").cast("long"), F.lit(-1)),
    })


def disc_flags(metrics: DataFrame, vessels: DataFrame, dims: DataFrame, image: str = "image") -> DataFrame:
    """``plausible``, ``macular_centred`` and ``laterality`` from disc metrics, vessel pixels and image size."""
    centre = metrics.select(image, "cup_centre_x")
    sides = vessels.select(image, "x").join(centre, image).groupBy(image).agg(
        F.count_if(F.col("x") < F.col("cup_centre_x")).alias("left_n"),
        F.count_if(F.col("x") >= F.col("cup_centre_x")).alias("right_n"),
    )
    j = metrics.join(dims.select(image, F.col("height").alias("__size")), image).join(sides, image, "left")
    size = F.col("__size")
    inside = F.col("cup_centre_x").between(F.col("disc_min_x"), F.col("disc_max_x")) & F.col("cup_centre_y").between(
        F.col("disc_min_y"), F.col("disc_max_y")
    )
    ok = (
        (F.col("disc_width") < size / 3) & (F.col("disc_height") < size / 3) & inside
        & (F.col("cup_height") < F.col("disc_height")) & (F.col("cup_width") < F.col("disc_width"))
    )
    ex, ey = F.col("disc_mean_x") - size / 2, F.col("disc_mean_y") - size / 2
    near = F.sqrt(ex * ex + ey * ey) / size < 0.1
    known = F.col("cup_mean_x").isNotNull() & F.col("disc_mean_x").isNotNull()
    plausible = F.coalesce(ok, F.lit(False))
    left, right = F.coalesce("left_n", F.lit(0)), F.coalesce("right_n", F.lit(0))
    return j.select(
        image, plausible.alias("plausible"),
        F.when(known, ~(plausible & F.coalesce(near, F.lit(False)))).alias("macular_centred"),
        F.when(known, F.when(left > right, "Right").otherwise("Left")).alias("laterality"),
    )


def lesion_stats(components: DataFrame, dims: DataFrame, image: str = "image", lesion: str = "lesion") -> DataFrame:
    """Per image and lesion: components, area ratio, mean area, dispersion = std_pop / mean (0 for one)."""
    s = components.groupBy(image, lesion).agg(
        F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.avg("area").alias("mean_area"),
        F.stddev_pop("area").alias("__sd"),
    )
    return s.join(dims, image).select(
        image, lesion, "n", F.try_divide("area", F.col("width") * F.col("height")).alias("area_ratio"), "mean_area",
        F.when(F.col("n") > 1, F.try_divide("__sd", "mean_area")).otherwise(F.lit(0.0)).alias("dispersion"),
    )


def lesion_compactness(components: DataFrame, min_area: int = 5, image: str = "image", lesion: str = "lesion") -> DataFrame:
    """Variant: components of at least ``min_area``; total area over total bounding-box area."""
    box = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    return components.where(F.col("area") >= min_area).groupBy(image, lesion).agg(
        F.count(F.lit(1)).alias("n"), F.avg("area").alias("mean_area"),
        F.try_divide(F.sum("area"), F.sum(box)).alias("compactness"),
    )


# Coefficients of the two calibre formulas.
def _pair(a: Column, b: Column, formula: str, vtype: Column) -> Column:
    if formula == "knudtson":
        root = F.sqrt(a * a + b * b)
        return F.when(vtype == "artery", root * 0.88).otherwise(root * 0.95)
    if formula == "hubbard":
        artery = F.sqrt(a * a * 0.87 + b * b * 1.01 - a * b * 0.22 - 10.76)
        return F.when(vtype == "artery", artery).otherwise(F.sqrt(a * a * 0.72 + b * b * 0.91 + 450.05))
    raise ValueError(f"unknown formula {formula!r}")


def vessel_calibre(widths: DataFrame, formula: str = "knudtson", image: str = "image", vessel: str = "vessel_id") -> DataFrame:
    """Equivalent calibre of the six widest vessels per (image, zone, vtype), paired widest with narrowest
    over three rounds; -1 with fewer than six. ``widths`` has one row per vessel with its mean ``width``."""
    group = [image, "zone", "vtype"]
    w = Window.partitionBy(*group).orderBy(F.desc("width"), vessel)
    six = widths.withColumn("__r", F.row_number().over(w)).where("__r <= 6").groupBy(*group).agg(
        F.array_sort(F.collect_list(F.col("width").cast("double"))).alias("w")  # six values at most
    )
    v = F.col("vtype")

    def at(arr: Column, i: int) -> Column:
        return F.get(arr, F.lit(i))

    ws = F.col("w")
    rounds = six.withColumn("r1", F.array_sort(F.array(*[_pair(at(ws, i), at(ws, 5 - i), formula, v) for i in range(3)])))
    r1 = F.col("r1")
    rounds = rounds.withColumn("r2", F.array_sort(F.array(_pair(at(r1, 0), at(r1, 2), formula, v), at(r1, 1))))
    r2 = F.col("r2")
    return rounds.select(*group, F.when(F.size("w") < 6, -1.0).otherwise(_pair(at(r2, 0), at(r2, 1), formula, v)).alias("calibre"))


def avr(df: DataFrame, artery: str, vein: str, guard: bool = True, name: str = "AVR") -> DataFrame:
    """Artery / vein ratio. The plain form gives 1 when both are -1; ``guard`` turns negative ratios into -1."""
    ratio = F.try_divide(artery, vein)
    return df.withColumn(name, F.when(ratio < 0, -1.0).otherwise(ratio) if guard else ratio)


def pivot_features(long: DataFrame, filename: str = "Filename", columns: Sequence[str] | None = None) -> DataFrame:
    """Long metrics → one row per file, ``<metric>_<type>_<zone>`` in fixed order, absent columns skipped."""
    known = [f"{m}_{v}_{z}" for z in ZONES for v in VESSEL_TYPES for m in VESSEL_FEATURES] if columns is None else list(columns)
    named = long.withColumn("__name", F.concat_ws("_", "metric", "vessel_type", "zone")).where(F.col("__name").isin(known))
    present = {r[0] for r in named.select("__name").distinct().collect()}  # at most len(known) names
    order = [c for c in known if c in present]
    return named.groupBy(filename).pivot("__name", order).agg(F.avg("value"))
