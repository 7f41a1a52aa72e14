"""Exact top-k inner products by a three-phase uniform threshold.

A vector is cut into ``PARTS`` parts; each part gives a list of partial scores for a query, moved up by the
list's lowest value so that none is negative.

1. Each list's ``k`` best entries are gathered, with their rows' sums over all lists. The k-th best sum of a
   query, split evenly over the lists, is its cutoff: a row below the cutoff in every list can't be among the
   best ``k``.
2. The cutoffs go back with the queries, and every list looks up its entries that reach them. From these, a
   row has a sum known so far and an upper bound, in which a list without an entry counts as the cutoff. Rows
   whose upper bound reaches the k-th best sum are sent; then the k-th best known sum discards more of them.
3. The remaining rows' scores are computed in full, and the best ``k`` are taken.

Rows and queries meet in blocks of bounded size (``BLOCK_VALUES`` components each), joined on the number of the
query block; every task holds one block of each. Among rows with equal vectors only the ``k + 1`` smallest
ids can be in a result, so the others of a hot vector leave before any score is computed.

Defined results: null vectors, and vectors with a null or non-finite component, are neither queries nor
candidates, as are rows with a null id. Vectors meet only those of the same length. Rows that repeat id and
vector are one candidate, and one id with several vectors is as many candidates and queries, whose results are
ranked together; a query's own id is no candidate. An empty table has no results. Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.session import materialize

from .words import map_batches

PARTS = 2
BLOCK_VALUES = 1 << 17  # components in a block: 1 MB
_EXACT = float(1 << 52)


def floored(vector: str, scale: int = 256) -> Column:
    """Components as floor(scale * x), or null if any is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(usable & (F.size(vector) > 0), F.transform(values, lambda x: F.floor(x * scale).cast("long")))


def _blocks(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """Blocks of vectors of one length: ids with row numbers, and their matrix, as bytes."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))).repartition("dim", "bucket")

    def build(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dim):
                at, most = np.flatnonzero(dim == d), max(1, BLOCK_VALUES // int(d))
                for i in range(0, len(at), most):
                    part = batch.take(pa.array(at[i : i + most]))
                    matrix = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(d)], pa.int32()), pa.array([part.column("id").to_numpy().tobytes() + part.column("row").to_numpy().tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())],
                        names=["dim", f"{name}_ids", f"{name}_matrix"],
                    )

    return dealt.mapInArrow(build, f"dim int, {name}_ids binary, {name}_matrix binary")


def _names(raw: bytes) -> np.ndarray:
    """Ids and row numbers."""
    return np.frombuffer(raw, dtype=np.int64).reshape(2, -1)


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer matrix of inner products; in floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _cuts(dim: int) -> list[int]:
    return [dim * i // PARTS for i in range(PARTS + 1)]


def _best(columns: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` largest of each column."""
    k = min(k, len(columns))
    return np.argpartition(-columns, k - 1, axis=0)[:k]


def top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's ``k`` best rows, ties to the
    smaller id. ``queries`` has the same columns as ``vectors``."""

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), floored(vector, scale).alias("v"))
        return rows.where("id IS NOT NULL AND v IS NOT NULL").distinct().withColumn("dim", F.size("v"))

    same = Window.partitionBy("dim", "v").orderBy("id")
    # an id may have several vectors, so rows go by numbers until the end
    rows = materialize(usable(vectors).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n").withColumn("row", F.monotonically_increasing_id()))
    asked = materialize(usable(queries).withColumn("row", F.monotonically_increasing_id()))
    size = F.coalesce(F.sum("dim"), F.lit(0)).cast("long")
    row_blocks = materialize(_blocks(rows, "row", 1 + 2 * rows.agg(size).first()[0] // BLOCK_VALUES))
    asked_blocks = materialize(_blocks(asked, "ask", 1 + 2 * asked.agg(size).first()[0] // BLOCK_VALUES).withColumn("ask_block", F.monotonically_increasing_id()))
    numbers = asked_blocks.groupBy("dim").agg(F.collect_list("ask_block").alias("ask_blocks"))
    spread = row_blocks.join(numbers, "dim").select("dim", "row_ids", "row_matrix", F.explode("ask_blocks").alias("ask_block"))
    meet = spread.join(asked_blocks, ["dim", "ask_block"])

    def parts_of(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            (ids, at), (asks, ask_at) = _names(r["row_ids"]), _names(r["ask_ids"])
            a, b, cut = _matrix(r["row_matrix"], r["dim"]), _matrix(r["ask_matrix"], r["dim"]), _cuts(r["dim"])
            own = ids[:, None] == asks[None, :]
            yield r, at, ask_at, own, [products(a[:, i:j], b[:, i:j]) for i, j in zip(cut, cut[1:])]

    def local_lists(batch: pa.RecordBatch):
        for _, numbers, asks, own, parts in parts_of(batch):
            for part, p in enumerate(parts):
                low = p.min(axis=0)
                at = _best(np.where(own, low, p), k)
                col = np.broadcast_to(np.arange(len(asks)), at.shape)
                keep = ~own[at, col]
                n = int(keep.sum())
                full = sum(x[at, col] for x in parts)[keep]
                yield {"ask": asks[col[keep]], "part": np.full(n, part), "row": numbers[at[keep]], "p": p[at, col][keep], "full": full, "low": low[col[keep]]}

    lists = map_batches(meet, local_lists, "ask long, part int, row long, p long, full long, low long")
    lists = materialize(lists)
    lows = lists.groupBy("ask", "part").agg(F.min("low").alias("low"))
    order = Window.partitionBy("ask", "part").orderBy(F.desc("p"), "row")
    heads = lists.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    by_part = lows.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("part", "low"))).alias("lows"), F.sum("low").alias("base"))
    sums = heads.groupBy("ask", "row").agg(F.max("full").alias("s"))
    kth = Window.partitionBy("ask").orderBy(F.desc("s"))
    first = sums.withColumn("n", F.row_number().over(kth)).where(F.col("n") == k).select("ask", F.col("s").alias("tau"))
    tau = F.coalesce(F.col("tau") - F.col("base"), F.lit(0))
    cutoffs = by_part.join(first, "ask", "left").select("ask", tau.alias("tau"), F.ceil(tau / PARTS).cast("long").alias("cutoff"), "lows.low")

    ask_ids = map_batches(asked_blocks, lambda b: ({"ask_block": np.full(len(q), n), "ask": q, "place": np.arange(len(q))} for n, q in zip(b.column("ask_block").to_pylist(), (_names(x)[1] for x in b.column("ask_ids").to_pylist()))), "ask_block long, ask long, place int")
    packed = ask_ids.join(cutoffs, "ask", "left").groupBy("ask_block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("tau", F.lit(0)).alias("tau"), F.coalesce("cutoff", F.lit(0)).alias("cutoff"), "low"))).alias("limits"))

    def sufficient(batch: pa.RecordBatch):
        for r, numbers, asks, own, parts in parts_of(batch):
            cutoff, tau = (np.array([x[c] for x in r["limits"]], dtype=np.int64) for c in ("cutoff", "tau"))
            low = np.array([x["low"] or [0] * PARTS for x in r["limits"]], dtype=np.int64)
            moved = [p - low[:, i] for i, p in enumerate(parts)]
            sent = [(m >= cutoff) & ~own for m in moved]
            upper = sum(np.where(s, m, cutoff) for s, m in zip(sent, moved))
            at, col = np.nonzero(np.logical_or.reduce(sent) & (upper >= tau))
            known = sum(np.where(s, m, 0)[at, col] for s, m in zip(sent, moved))
            yield {"ask": asks[col], "row": numbers[at], "known": known, "upper": upper[at, col]}

    entries = materialize(map_batches(meet.join(packed, "ask_block"), sufficient, "ask long, row long, known long, upper long"))
    better = Window.partitionBy("ask").orderBy(F.desc("known"))
    second = entries.withColumn("n", F.row_number().over(better)).where(F.col("n") == k).select("ask", F.col("known").alias("tau"))
    left = entries.join(second, "ask", "left").where(F.col("upper") >= F.coalesce("tau", F.lit(0))).select("ask", "row")

    full = left.join(rows.select("row", F.col("id").alias("vec_id"), F.col("v").alias("a")), "row").join(asked.select(F.col("row").alias("ask"), F.col("id").alias("query_id"), F.col("v").alias("b")), "ask")
    scored = full.where(F.size("a") == F.size("b")).select(
        "query_id", "vec_id", F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x).alias("score")
    )
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
