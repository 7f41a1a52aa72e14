"""Vector index on disk: vectors as parquet (by cell for IVF), the other columns by buckets of ids and in the order
of ids, and a one-row settings table."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import SparkSession

from ..operators.retrieval import ID_BUCKET, VectorIndex, other_columns, with_bucket

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def save_index(index: VectorIndex, path: str, buckets: int = BUCKETS) -> None:
    """Write an index. Texts and other columns go to ``buckets`` folders by id; choose as many as searches have
    hits, or fewer, so that most folders stay closed."""
    rows = index.rows if index.rows is not None else other_columns(index.vectors, index)
    stored = replace(index, buckets=buckets if len(rows.columns) > 1 else 0)
    kept = [c for c in index.vectors.columns if c in (index.id_col, index.vec_col, "cell")]
    writer = index.vectors.select(kept).write.mode("overwrite")
    if index.centroids is not None:
        writer = writer.partitionBy("cell")
    writer.parquet(f"{path}/vectors")
    if stored.buckets:
        keyed = with_bucket(rows.drop(ID_BUCKET), stored)
        keyed.repartitionByRange(ID_BUCKET, index.id_col).sortWithinPartitions(ID_BUCKET, index.id_col).write.mode("overwrite").partitionBy(ID_BUCKET).parquet(f"{path}/rows")
    centroids = [] if index.centroids is None else index.centroids.tolist()
    row = (index.dimension, index.kind, index.metric, len(centroids), index.id_col, index.vec_col, centroids, index.nprobe, stored.buckets)
    index.vectors.sparkSession.createDataFrame(
        [row], "dimension int, index_type string, metric string, nlist int, id_col string, vec_col string, centroids array<array<double>>, nprobe int, buckets int"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    for part in ("vectors", "settings"):
        fs, target = _fs(spark, f"{path}/{part}")
        if not fs.exists(target):
            raise FileNotFoundError(f"no vector index at {path}")
    s = spark.read.parquet(f"{path}/settings").first()
    centroids = np.array(s.centroids) if s.nlist else None
    rows = spark.read.parquet(f"{path}/rows") if s.buckets else None
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), s.dimension, s.metric, s.id_col, s.vec_col, centroids, s.nprobe, rows, s.buckets)


def clear_index(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    if fs.exists(target):
        fs.delete(target, True)
