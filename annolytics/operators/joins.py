"""Joins of measurement, quality and state tables. Strategies are left to the optimizer unless a side
is known to be small by its size in bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_features(disc: DataFrame, binary: DataFrame, artery: DataFrame, vein: DataFrame, key: str = "Name") -> DataFrame:
    out = disc
    for t in (binary, artery, vein):
        out = out.join(t, key, "full_outer")
    return out


def merge_zones(whole: DataFrame, zone_b: DataFrame, zone_c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole image ⟗ (zone B ⟗ zone C), both on all ``keys``, where missing equals missing.

    Other columns that occur in both zones get ``_zone_b`` / ``_zone_c``; what then still occurs in both the
    whole-image table and the zones gets ``_x`` / ``_y``. Rows whose keys differ stay rows of their own. A key
    that repeats on both sides gives each combination, as the merge asks for; make such keys unique before.
    """
    shared = (set(zone_b.columns) & set(zone_c.columns)) - set(keys)
    b = zone_b.select(*[F.col(c).alias(f"{c}_zone_b" if c in shared else c) for c in zone_b.columns])
    c = zone_c.select(*[
        F.col(x).alias(f"__{x}" if x in keys else f"{x}_zone_c" if x in shared else x) for x in zone_c.columns
    ])
    zones = _outer_on(b, c, keys)
    both = (set(whole.columns) & set(zones.columns)) - set(keys)
    w = whole.select(*[F.col(x).alias(f"__{x}" if x in keys else f"{x}_x" if x in both else x) for x in whole.columns])
    z = zones.select(*[F.col(x).alias(f"{x}_y" if x in both else x) for x in zones.columns])
    out = _outer_on(z, w, keys)
    return out.select(*keys, *[x for x in w.columns if not x.startswith("__")], *[x for x in z.columns if x not in keys])


def _outer_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on ``keys``, which ``right`` has with ``__`` in front; null equals null."""
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(right[f"__{k}"])
        cond = part if cond is None else cond & part
    return left.join(right, cond, "full_outer").select(
        *[F.coalesce(left[k], right[f"__{k}"]).alias(k) for k in keys],
        *[x for x in left.columns if x not in keys], *[x for x in right.columns if not x.startswith("__")],
    )


def first_stem(c: str | Column) -> Column:
    """File name up to the first dot."""
    return F.substring_index(F.col(c) if isinstance(c, str) else c, ".", 1)


def last_stem(c: str | Column) -> Column:
    """Base name up to the last dot."""
    base = base_name(c)
    return F.regexp_replace(base, r"(?s)(?<=.)\.[^.]*$", "")


def base_name(c: str | Column) -> Column:
    return F.substring_index(F.col(c) if isinstance(c, str) else c, "/", -1)


def attach_quality(disc: DataFrame, quality: DataFrame, features: DataFrame) -> DataFrame:
    """Disc metrics ⋈ quality on the stem before the first dot, then ⋈ features on Filename."""
    q = quality.select(first_stem("Name").alias("__stem"), F.col("quality").alias("QuickQual_quality"))
    d = disc.withColumn("__stem", first_stem("Filename"))
    return d.join(q, "__stem").drop("__stem").join(features, "Filename")


def lookup_scale(df: DataFrame, res: DataFrame, name: str = "Name", fundus: str = "fundus") -> DataFrame:
    """Resolution per image; ``error`` says so when the image is not listed."""
    out = df.join(res.select(F.col(fundus).alias("__f"), "res"), F.col(name) == F.col("__f"), "left").drop("__f")
    text = F.concat(F.lit("no resolution for "), F.col(name).cast("string"))
    return out.withColumn("error", F.when(F.col("res").isNull(), text))


def lookup_by_name(
    df: DataFrame, table: DataFrame, key: str, table_path: str, order: Sequence[str], by: str = "basename",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """First matching table row by base name or by stem; ``found`` tells whether there was one."""
    norm = {"basename": base_name, "stem": last_stem}[by]
    carried = [c for c in (columns or table.columns) if c != "__k"]
    first = table.withColumn("__k", norm(table_path)).groupBy("__k").agg(
        F.min_by(F.struct(*carried), F.struct(*order)).alias("match")
    )
    keyed = df.withColumn("__k", norm(key))
    return keyed.join(first, "__k", "left").drop("__k").withColumn("found", F.col("match").isNotNull())


def pair_eyes(df: DataFrame, patient: str, side: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per patient with the first left and the first right row's values as ``<col>_L`` / ``<col>_R``.

    A patient with only one eye keeps a row in which every value is null.
    """
    first = df.groupBy(patient).agg(*[
        F.min_by(F.when(F.col(side) == s, F.struct(*columns)), F.when(F.col(side) == s, F.struct(*order))).alias(s)
        for s in ("L", "R")
    ])
    both = F.col("L").isNotNull() & F.col("R").isNotNull()
    return first.select(patient, *[
        F.when(both, F.col(f"{s}.{c}")).alias(f"{c}_{s}") for c in columns for s in ("L", "R")
    ])


def pending(examples: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Examples whose key is not in the completed set (failures are completed too)."""
    return examples.join(progress.select(key), key, "left_anti")


def extend_progress(progress: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    return progress.select(key).unionByName(finished.select(key)).distinct()


# Extensions tried after the bare name, in this order.
IMAGE_EXTENSIONS = (".jpg", ".png", ".JPG", ".PNG")


def resolve_files(
    df: DataFrame, manifest: DataFrame, name: str, path: str = "path", exts: Sequence[str] = IMAGE_EXTENSIONS
) -> DataFrame:
    """Rows whose file is in the manifest, with the first match among bare name and extensions."""
    tries = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.concat(F.col(name), F.lit(e)).alias("path")) for i, e in enumerate(["", *exts])
    ])
    # one candidate list per distinct name, so repeated names are looked up once
    names = df.select(name).where(F.col(name).isNotNull()).distinct().select(name, F.explode(tries).alias("t"))
    hits = names.join(manifest.select(F.col(path).alias("__p")).distinct(), F.col("t.path") == F.col("__p"), "left_semi")
    best = hits.groupBy(name).agg(F.min("t")["path"].alias("resolved"))
    return df.join(best, name)


def join_scores(task: DataFrame, separability: DataFrame, key: str = "method") -> DataFrame:
    return task.join(separability, key, "full_outer")


def match_pseudo_labels(test: DataFrame, preds: DataFrame, test_path: str, pred_path: str) -> DataFrame:
    """Test images ⋈ prediction files of the same stem; names with ``binary`` or ``perf`` do not count."""
    usable = preds.where(~base_name(pred_path).contains("binary") & ~base_name(pred_path).contains("perf"))
    return test.withColumn("__k", last_stem(test_path)).join(
        usable.select(last_stem(pred_path).alias("__k"), F.col(pred_path).alias("label_path")), "__k"
    ).drop("__k")


def coverage(required: DataFrame, available: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Per required name: status and the real name, found directly or through the alias table."""
    have = available.select(F.col(name).alias("__a")).distinct()
    al = aliases.select(F.col("alias").alias("__alias"), F.col("real").alias("__real"))
    direct = required.join(have.withColumnRenamed("__a", "__direct"), F.col(name) == F.col("__direct"), "left")
    mapped = direct.join(al, F.col(name) == F.col("__alias"), "left")
    via = mapped.join(have.withColumnRenamed("__a", "__via"), F.col("__real") == F.col("__via"), "left")
    real = F.coalesce("__direct", "__via")
    note = F.when(real.isNotNull(), real).when(
        F.col("__real").isNotNull(), F.concat(F.lit("mapped to "), F.col("__real"), F.lit(" but not loaded"))
    ).otherwise(F.lit("no mapping"))
    return via.select(
        *required.columns, F.when(real.isNotNull(), "available").otherwise("missing").alias("status"), note.alias("real_name")
    )


def coverage_summary(rows: DataFrame) -> DataFrame:
    out = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "available").alias("available"),
        F.count_if(F.col("status") == "missing").alias("missing"),
    )
    return out.withColumns({
        f"{c}_percent": F.coalesce(F.try_divide(F.col(c) * 100, F.col("total")), F.lit(0.0)) for c in ("available", "missing")
    })


def min_distance(
    points: DataFrame, centers: DataFrame, image: str = "image", x_scale: float = 1.0, y_scale: float = 1.0
) -> DataFrame:
    """Least distance of scaled points to the image's reference point; null for images without points."""
    dx, dy = F.col("x") * x_scale - F.col("cx"), F.col("y") * y_scale - F.col("cy")
    near = points.select(image, "x", "y").join(centers.select(image, "cx", "cy"), image).groupBy(image).agg(
        F.min(F.sqrt(dx * dx + dy * dy)).alias("distance")
    )
    return centers.join(near, image, "left")
