"""Connected components of an edge table in rounds that grow with the logarithm of its size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.session import materialize

ONE_TASK = 1 << 20  # edges that a task holds at once, 16 MB of long ids; an eighth of it for other names


def smallest_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes, from edges ``a``-``b``."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        # the larger root of an edge hangs below the smallest root that it meets
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _ordered(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct node first stands, in ascending order, and the number of each node in that order."""
    if pa.types.is_integer(nodes.type):
        return np.unique(nodes.to_numpy(), return_index=True, return_inverse=True)[1:]
    keys = nodes.to_pylist()
    if pa.types.is_struct(nodes.type):
        keys = [tuple((v is not None, v) for v in k.values()) for k in keys]
    first: dict = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    order = sorted(first)
    number = dict(zip(order, range(len(order))))
    return np.array([first[k] for k in order]), np.array([number[k] for k in keys])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        nodes = pa.concat_arrays([b.column(c) for c in ("hi", "lo") for b in held])
        at, number = _ordered(nodes)
        least = smallest_members(*np.split(number, 2), len(at))
        below = np.flatnonzero(least != np.arange(len(at)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(at[below])), nodes.take(pa.array(at[least[below]]))], names=["hi", "lo"])


def _settles(kind: T.DataType) -> int:
    """By what the number of edges in a task is divided for nodes of a type; 0 where none may be."""
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return 1
    parts = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind]
    return 8 if all(isinstance(k, (T.IntegerType, T.LongType, T.StringType)) for k in parts) else 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = ONE_TASK) -> DataFrame:
    """``node`` and ``component`` (its smallest member) of all nodes with an edge to another node.

    Alternates two steps on edges that point to smaller nodes: every larger neighbour of a node is joined to
    the smallest one of the node's neighbourhood, then every smaller neighbour is. Each step keeps components
    as they are, and paths shrink to stars. A node with very many neighbours is met with one row of its own
    minimum, so its edges can be split between tasks. Once at most ``one_task`` edges are left (an eighth
    for names that are strings or structs of strings and integers), one task settles them.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    pairs = materialize(pairs)
    share = _settles(pairs.schema["hi"].dataType)
    while True:
        if share and pairs.count() <= one_task // share:
            pairs = materialize(pairs.repartition(1).mapInArrow(_settled, pairs.schema))
            break
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        pairs = materialize(small)
        # stars: every larger node has one parent, and no parent has one
        above = pairs.groupBy("hi").agg(F.count("*").alias("n"))
        below = pairs.select(F.col("lo").alias("hi")).distinct().withColumn("n", F.lit(1).cast("long"))
        if above.unionByName(below).groupBy("hi").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
            break
    stars = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
