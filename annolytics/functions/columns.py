"""Column functions: labels, gates, boxes, scores, previews. All run inside codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def preview(c: str | Column, n: int) -> Column:
    """First ``n`` characters, with ``...`` only when something was cut off."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


# The two groupings of five severity grades into three.
GRADE_SCHEMES = {"referable": {0: 0, 1: 1, 2: 1, 3: 1, 4: 2}, "paired": {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}}


def remap_grade(grade: str | Column, scheme: str) -> Column:
    pairs = [F.lit(v) for item in GRADE_SCHEMES[scheme].items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(grade).cast("int")), F.lit(-1))


def quality_verdict(prediction: str | Column, softmax_bad: str | Column, max_bad: float = 0.25) -> Column:
    p = col(prediction)
    good = (p == 0) | ((p == 1) & (col(softmax_bad) < max_bad))
    return F.when(good, "good").otherwise("bad")


def pixel_scale(radius: str | Column) -> Column:
    return col(radius) * 2 / F.lit(912.0)


def scale_resolution(radius: str | Column, res: str | Column) -> Column:
    return col(res) * pixel_scale(radius) * 1000


def roi_box(
    x: str | Column, y: str | Column, half: int = 250,
    width: str | Column | None = None, height: str | Column | None = None,
) -> Column:
    """Square around a point, floored at 0 and cut at the image edge; a fixed box when there is no point."""
    cx, cy = col(x).cast("int"), col(y).cast("int")
    x1, y1 = F.greatest(cx - half, F.lit(0)), F.greatest(cy - half, F.lit(0))
    x2 = cx + half if width is None else F.least(cx + half, col(width).cast("int"))
    y2 = cy + half if height is None else F.least(cy + half, col(height).cast("int"))
    given = cx.isNotNull() & cy.isNotNull()
    pick = lambda c, default: F.when(given, c).otherwise(F.lit(default))
    return F.struct(
        pick(x1, 256).alias("x1"), pick(y1, 256).alias("y1"), pick(x2, 768).alias("x2"), pick(y2, 768).alias("y2"),
        F.when(given, (x2 > x1) & (y2 > y1)).otherwise(F.lit(True)).alias("valid"),
    )


def dme_risk(distance: str | Column, disc_diameter: str | Column) -> Column:
    """Risk 2 within a third of the disc diameter, 1 within one diameter, else 0 (also without lesions)."""
    d, dd = col(distance), col(disc_diameter)
    level = F.when(d.isNull(), 0).when(d <= dd / 3, 2).when(d <= dd, 1).otherwise(0)
    return F.struct(level.alias("risk_level"), F.try_divide(d, dd).alias("distance_dd"))


def severity_score(
    drusen_l: str | Column, drusen_r: str | Column, pigment_l: str | Column, pigment_r: str | Column,
    amd_l: str | Column, amd_r: str | Column,
) -> Column:
    """Two-eye severity 0-5: 5 per late-disease eye, 1 per pigment eye, 1 per large-drusen eye,
    1 when both eyes have intermediate drusen; a patient with a missing eye scores 0."""
    def one(c: str | Column, value: int, points: int) -> Column:
        return F.when(col(c) == value, points).otherwise(0)

    both = F.when((col(drusen_l) == 1) & (col(drusen_r) == 1), 1).otherwise(0)
    total = (
        one(amd_l, 1, 5) + one(amd_r, 1, 5) + one(pigment_l, 1, 1) + one(pigment_r, 1, 1)
        + one(drusen_l, 2, 1) + one(drusen_r, 2, 1) + both
    )
    complete = None
    for c in (drusen_l, drusen_r, pigment_l, pigment_r, amd_l, amd_r):
        complete = col(c).isNotNull() if complete is None else complete & col(c).isNotNull()
    return F.when(complete, F.least(total, F.lit(5))).otherwise(F.lit(0))


def argmax_prediction(probs: str | Column, labels: Sequence[str] | None = None) -> Column:
    """Arg-max class (the first on a tie), its name and its probability."""
    p = col(probs)
    best = F.array_max(p)
    idx = (F.array_position(p, best) - 1).cast("int")
    name = idx.cast("string") if labels is None else F.element_at(F.array(*[F.lit(x) for x in labels]), idx + 1)
    return F.struct(idx.alias("class_id"), name.alias("label"), best.alias("confidence"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once. Inside a lambda an expression is computed again for
    every element; a lambda variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exp_normalize(values: Column) -> Column:
    """Turn an array of scores into probabilities."""
    def shares(e: Column) -> Column:
        return bind(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total))

    return bind(F.transform(values, lambda v: F.exp(v)), shares)


def l2_normalize(vec: str | Column) -> Column:
    """Unit vector; the zero vector is returned as it is."""
    v = col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return bind(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
