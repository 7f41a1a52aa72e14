"""Connected components (8-neighbour) of sparse pixels, tile by tile, merged across tile borders.

A tile bounds what one task holds, however large an image is. Components of a tile are named by their
first pixel; border contacts form a much smaller graph, whose components are found by star contraction
(``graph.py``), in rounds that grow with the logarithm of its size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .graph import connected_components

_HALF = ((1, 0), (-1, 1), (0, 1), (1, 1))  # half of the eight neighbours; the rest follow by symmetry
_ROW = 1 << 32  # pixel name = y · 2³² + x: names order pixels by row, then column


def tile_labels(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest pixel name of each pixel's component, for whole tiles numbered by ``group``.

    x and y count inside the tile (below 1,000), so (group, y, x) packs into one sortable number.
    """
    place = (group.astype(np.int64) << 20) | ((y.astype(np.int64) + 1) << 10) | (x.astype(np.int64) + 1)
    order = np.argsort(place, kind="stable")
    ordered = place[order]
    left, right = [], []
    for dx, dy in _HALF:
        wanted = ordered + (dy << 10) + dx
        at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
        hit = ordered[at] == wanted
        left.append(np.flatnonzero(hit))
        right.append(at[hit])
    u, v = np.concatenate(left), np.concatenate(right)
    lab = np.arange(len(ordered))
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    first = np.empty(len(ordered), dtype=np.int64)
    first[order] = order[lab]
    return first  # position of the component's first pixel


def label_components(px: DataFrame, by: Sequence[str] = ("image", "lesion"), tile: int = 256) -> DataFrame:
    """Adds ``component`` (name of the component's first pixel) to distinct pixels with x, y ≥ 0.

    Tiles are shuffled by (image, tile) and sorted, and each task labels all complete tiles of an Arrow
    batch at once; it holds one batch and one tile at most.
    """
    if tile > 1000:
        raise ValueError("tile side must be at most 1000")
    keys = [*by, "__ty", "__tx"]
    pixels = px.select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    tiled = pixels.withColumns({"__tx": F.floor(F.col("x") / tile), "__ty": F.floor(F.col("y") / tile)})
    sorted_tiles = tiled.repartition(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([pixels.schema[c] for c in by] + [
        T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("node", T.LongType())
    ])

    def label(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        first = tile_labels(np.cumsum(starts), x % tile, y % tile)
        pdf["node"] = y[first] * _ROW + x[first]
        return pdf[[*by, "x", "y", "node"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if rows.empty:
                continue
            same = np.ones(len(rows), dtype=bool)
            for k in keys:
                c = rows[k].to_numpy()
                same[1:] &= c[1:] == c[:-1]
            starts = ~same
            starts[0] = True
            last = np.flatnonzero(starts)[-1]
            if last:
                yield label(rows.iloc[:last].copy(), starts[:last])
            held = rows.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield label(held, np.zeros(len(held), dtype=bool))

    local = materialize(sorted_tiles.mapInPandas(run, schema))  # used three times below

    # tile borders
    rim = local.where((F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _HALF])
    reach = rim.select(*by, "x", "y", F.col("node").alias("a"), F.explode(steps).alias("s")).select(
        *by, "a", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"),
    )
    contacts = reach.join(rim.withColumnRenamed("node", "b"), [*by, "x", "y"]).where("a != b").select(*by, "a", "b")
    edges = materialize(contacts.distinct())
    if edges.isEmpty():
        return local.withColumnRenamed("node", "component")
    name = lambda node: F.struct(*by, F.col(node).alias("node"))
    parts = connected_components(edges.select(name("a").alias("src"), name("b").alias("dst")))
    labels = parts.select("node.*", F.col("component.node").alias("label"))
    joined = local.join(labels, [*by, "node"], "left")
    return joined.select(*by, "x", "y", F.coalesce("label", "node").alias("component"))


def component_table(labelled: DataFrame, by: Sequence[str] = ("image", "lesion")) -> DataFrame:
    """One row per component: area and extents."""
    return labelled.groupBy(*by, "component").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    )
