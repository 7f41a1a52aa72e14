"""Records → examples, slices, filters and labels (projections)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nonempty, pixel_scale, quality_verdict, scale_resolution
from ..functions.text import contains_any
from ..plans import rules as R
from .ordering import rows_between

# Field names accepted for each part of a flat record, in order of preference.
QUESTION_KEYS = ["question", "Question", "q"]
ANSWER_KEYS = ["ground_truth_answer", "correct_answer", "answer", "Answer", "gt_answer", "a"]
IMAGE_KEYS = ["image_path", "image", "Image", "img_path", "image_file"]
USER_ROLES = ["human"]
REPLY_ROLES = ["gpt", "assistant", "model"]


def _first_key(df: DataFrame, keys: Sequence[str]) -> Column:
    """First non-empty value among the keys this frame has; a list counts by its first element."""
    parts = []
    for k in keys:
        if k in df.columns:
            kind = df.schema[k].dataType.typeName()
            value = F.get(F.col(k), F.lit(0)) if kind == "array" else F.col(k).cast("string")
            if kind == "string":  # a list that was read as text
                as_list = F.from_json(F.when(F.ltrim(F.col(k)).startswith("["), F.col(k)), "array<string>")
                value = F.when(as_list.isNotNull(), F.get(as_list, F.lit(0))).otherwise(F.col(k))
            parts.append(nonempty(value))
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def _by_role(conversations: Column, roles: Sequence[str], pick: str, position: int) -> Column:
    values = F.transform(
        F.filter(conversations, lambda t: F.lower(t["from"]).isin(*roles)), lambda t: nonempty(t["value"])
    )
    if pick == "first":
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))
    if pick == "last":
        return F.try_element_at(values, F.lit(-1))
    if pick == "positional":
        return nonempty(F.get(conversations, F.lit(position))["value"])
    raise ValueError(f"unknown pick {pick!r}")


def normalize_examples(df: DataFrame, pick: str = "first", keep: Sequence[str] = ()) -> DataFrame:
    """Conversation or flat records → (question, image_path, ground_truth_answer), incomplete rows dropped.

    ``pick`` chooses among turns of one role: first non-empty, last, or by position (0 and 1).
    A record that has a conversation is read from it alone, without falling back to flat keys.
    """
    q, a = _first_key(df, QUESTION_KEYS), _first_key(df, ANSWER_KEYS)
    if "conversations" in df.columns:
        turns = F.col("conversations")
        q = F.when(turns.isNotNull(), _by_role(turns, USER_ROLES, pick, 0)).otherwise(q)
        a = F.when(turns.isNotNull(), _by_role(turns, REPLY_ROLES, pick, 1)).otherwise(a)
    out = df.select(
        *keep, q.alias("question"), _first_key(df, IMAGE_KEYS).alias("image_path"), a.alias("ground_truth_answer")
    )
    return out.dropna(subset=["question", "image_path", "ground_truth_answer"])


def slice_rows(
    df: DataFrame, order: Sequence[str], start: int = 0, end: int | None = None, batch: int | None = None
) -> DataFrame:
    """Rows [start, end) in ``order``, then at most ``batch`` of them, in no certain order. ``end=0`` means no end."""
    sizes = [n for n in ((end - start) if end else None, batch) if n is not None]
    stop = start + min(sizes) if sizes else None
    if stop is not None and stop <= start:
        return df.limit(0)
    return rows_between(df, order, start, stop) if start or stop is not None else df


def filter_by_type(df: DataFrame, wanted: str | None, expanded: str = "answer_text", label: str = "label") -> DataFrame:
    """Classified rows of a type. ``B`` keeps rows whose answer could still turn into a correction
    case; ``E`` keeps every classified row."""
    rows = df.where(F.col(label).isNotNull())
    if wanted is None or wanted == "E":
        return rows
    if wanted == "B":
        return rows.where(may_become_correction(F.col(expanded)))
    return rows.where(F.col(f"{label}.type") == wanted)


def may_become_correction(answer_lower: Column) -> Column:
    return contains_any(answer_lower, [*R.DR_WORDS, *R.AMD_WORDS, *R.HEALTHY_WORDS])


def gradable_labels(
    df: DataFrame, gradable: str = "adjudicated_gradable", grade: str = "adjudicated_dr_grade", on_bad: str = "error"
) -> DataFrame:
    """Drop rows marked '0' (only that value), then read the grade as an integer ``label``."""
    if on_bad not in ("error", "skip"):
        raise ValueError(f"unknown on_bad {on_bad!r}")
    rows = df.where(~F.col(gradable).cast("string").eqNullSafe(F.lit("0")))
    parsed = F.col(grade).try_cast("int")
    if on_bad == "skip":
        return rows.withColumn("label", parsed).where(F.col("label").isNotNull())
    message = F.concat(F.lit("label is not an integer: "), F.coalesce(F.col(grade).cast("string"), F.lit("null")))
    return rows.withColumn("label", F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("int")))


def coalesce_eye_label(df: DataFrame, patient: str, image: str, left: str, right: str, ext: str = ".jpg") -> DataFrame:
    """Label from the left eye, else the right; rows with neither are dropped. Adds a relative path."""
    raw = F.coalesce(nonempty(left), nonempty(right))
    path = F.concat_ws("/", F.col(patient).cast("string"), F.concat(F.col(image).cast("string"), F.lit(ext)))
    return df.withColumn("label", raw.try_cast("int")).withColumn("path", path).where(raw.isNotNull())


def threshold(df: DataFrame, t: float | None, score: str = "score") -> DataFrame:
    return df if t is None else df.where(F.col(score) >= t)


def quality_gate(df: DataFrame, max_bad: float = 0.25) -> DataFrame:
    return df.withColumn("verdict", quality_verdict("Prediction", "softmax_bad", max_bad))


def quality_counts(gated: DataFrame) -> DataFrame:
    return gated.agg(
        F.count_if(F.col("verdict") == "good").alias("good"), F.count_if(F.col("verdict") == "bad").alias("bad")
    )


def add_pixel_scale(df: DataFrame, radius: str = "radius", res: str = "res") -> DataFrame:
    return df.withColumn("Scale", pixel_scale(radius)).withColumn("Scale_resolution", scale_resolution(radius, res))


def default_resolution(df: DataFrame, image: str, res: float = 0.008) -> DataFrame:
    return df.select(F.col(image).alias("fundus"), F.lit(res).alias("res"))


def sentinel_to_null(df: DataFrame, sentinel: float = -1, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = _numeric(df) if columns is None else columns
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel).cast(df.schema[c].dataType)) for c in chosen})


def null_to_sentinel(df: DataFrame, sentinel: float = -1, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = _numeric(df) if columns is None else columns
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel).cast(df.schema[c].dataType)) for c in chosen})


def drop_all_sentinel_columns(df: DataFrame, sentinel: float = -1) -> DataFrame:
    """Drop columns in which every row is the sentinel: one aggregate pass, one row to the driver."""
    numeric = _numeric(df)
    if not numeric:
        return df
    flags = df.agg(*[F.bool_and(F.col(c).eqNullSafe(F.lit(sentinel))).alias(c) for c in numeric]).first()
    return df.drop(*[c for c in numeric if flags[c]])


def _numeric(df: DataFrame) -> list[str]:
    names = {"integer", "long", "double", "float", "short", "byte"}
    return [f.name for f in df.schema.fields if f.dataType.typeName() in names]


# The measurement columns of the wide feature table.
VESSEL_FEATURES = ["vessel_density", "fractal_dimension", "average_global_calibre", "average_local_calibre",
                   "tortuosity_distance", "tortuosity_density"]
VESSEL_TYPES = ["binary", "artery", "vein"]
ZONES = ["whole", "B", "C"]
DISC_FIELDS = {"laterality": "laterality", "macular_centred": "macular_centred", "disc_height_px": "disc_height",
               "disc_width_px": "disc_width", "cup_height_px": "cup_height", "cup_width_px": "cup_width",
               "cdr_vertical": "CDR_vertical", "cdr_horizontal": "CDR_horizontal"}
LARGE_VESSEL_FIELDS = {"CRAE_artery_B": "CRAE_Knudtson_artery_B", "CRAE_artery_C": "CRAE_Knudtson_artery_C",
                       "CRVE_vein_B": "CRVE_Knudtson_vein_B", "CRVE_vein_C": "CRVE_Knudtson_vein_C",
                       "AVR_B": "AVR_B", "AVR_C": "AVR_C"}


def features_to_nested(df: DataFrame, filename: str = "Filename") -> DataFrame:
    """Wide feature row → filename, quality, optic_disc, vessel_features[type][zone][metric], large_vessel_metrics.

    Only columns that exist are carried; a missing quality or disc value is -1.
    """
    have = set(df.columns)

    def string_map(pairs: list[tuple[str, Column]], kind: str) -> Column:
        if not pairs:
            return F.create_map().cast(f"map<string,{kind}>")
        return F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])

    def field(name: str) -> Column:
        if name in have:
            return F.col(name)
        return F.lit("Unknown") if name == "laterality" else F.lit(-1)

    types = []
    for v in VESSEL_TYPES:
        zones = []
        for z in ZONES:
            metrics = [(m, F.col(f"{m}_{v}_{z}").cast("double")) for m in VESSEL_FEATURES if f"{m}_{v}_{z}" in have]
            if metrics:
                zones.append((z, string_map(metrics, "double")))
        types.append((v, string_map(zones, "map<string,double>")))
    large = [(k, F.col(c).cast("double")) for k, c in LARGE_VESSEL_FIELDS.items() if c in have]
    return df.select(
        F.col(filename).alias("filename"),
        F.struct(field("QuickQual_quality").cast("double").alias("quickqual_score")).alias("quality"),
        F.struct(*[field(c).alias(k) for k, c in DISC_FIELDS.items()]).alias("optic_disc"),
        string_map(types, "map<string,map<string,double>>").alias("vessel_features"),
        string_map(large, "double").alias("large_vessel_metrics"),
    )


def nested_to_long(nested: DataFrame) -> DataFrame:
    """Inverse for the vessel part: one row per (filename, vessel_type, zone, metric)."""
    return (
        nested.select("filename", F.explode("vessel_features").alias("vessel_type", "zones"))
        .select("filename", "vessel_type", F.explode("zones").alias("zone", "metrics"))
        .select("filename", "vessel_type", "zone", F.explode("metrics").alias("metric", "value"))
    )


def long_to_wide(long: DataFrame, filename: str = "filename") -> DataFrame:
    """(filename, vessel_type, zone, metric, value) → one wide row per file with fixed column order."""
    names = [f"{m}_{v}_{z}" for z in ZONES for v in VESSEL_TYPES for m in VESSEL_FEATURES]
    name = F.concat_ws("_", "metric", "vessel_type", "zone")
    return long.withColumn("__name", name).groupBy(filename).pivot("__name", names).agg(F.first("value", True))
