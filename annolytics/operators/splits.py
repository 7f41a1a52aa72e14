"""Splits, resampling, unions and upserts. Membership depends on key hashes, never on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import HASH_BUCKET_DIGITS, _null_safe, hash_order, with_cuts


def stratified_split(df: DataFrame, label: str, key: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Exactly round(n·frac) rows of each class become ``test``, the rest ``train``."""
    order = hash_order(seed, key)
    rows = with_cuts(df, [label], order, {"cut": lambda n: F.round(n * F.lit(frac)).cast("long")})
    split = F.when(F.coalesce(F.col("__order") <= F.col("cut"), F.lit(False)), "test").otherwise("train")
    return rows.withColumn("split", split).select(*df.columns, "split")


def fraction_split(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """Consecutive parts of a hash shuffle: int(n·cumulative fraction) rows each, the last takes the rest."""
    names = list(fractions)
    order = hash_order(seed, key)
    cuts, upto = {}, 0.0
    for name in names[:-1]:
        upto += fractions[name]
        cuts[f"cut_{name}"] = lambda n, f=upto: F.floor(n * F.lit(f) + F.lit(1e-9)).cast("long")
    rows = with_cuts(df, [], order, cuts)
    split = None
    for name in names[:-1]:
        hit = F.coalesce(F.col("__order") <= F.col(f"cut_{name}"), F.lit(False))
        split = F.when(hit, name) if split is None else split.when(hit, name)
    out = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return rows.withColumn("split", out).select(*df.columns, "split")


def halve(df: DataFrame, key: str, seed: int = 42, names: Sequence[str] = ("val", "test")) -> DataFrame:
    """Shuffle by hash, first floor(n/2) rows to the first part."""
    return fraction_split(df, key, {names[0]: 0.5, names[1]: 0.5}, seed)


def _numbered(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with a dense 0-based ``__i`` in hash order, ranked inside hash buckets."""
    keyed = df.withColumn("__o", hash_order(seed, key))
    keyed = keyed.withColumn("__b", F.conv(F.substring("__o", 1, HASH_BUCKET_DIGITS), 16, 10).cast("int"))
    counts = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__p"))
    local = keyed.withColumn("__rn", F.row_number().over(Window.partitionBy("__b").orderBy("__o")))
    return _null_safe(local, offsets, ["__b"], "inner").withColumn(
        "__i", (F.col("__p") + F.col("__rn") - 1).cast("long")
    ).drop("__o", "__b", "__p", "__rn")


def oversample_to(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """All rows, plus seeded draws with replacement until there are ``n``; unchanged if already that many.

    ``draw`` is null for original rows and the number of the draw for added ones.
    """
    have = df.count()
    base = df.withColumn("draw", F.lit(None).cast("long"))
    if n <= have or have == 0:
        return base
    spin = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}#"), F.col("id").cast("string"))), 1, 15), 16, 10)
    draws = df.sparkSession.range(n - have).select(F.col("id").alias("draw"), (spin.cast("long") % have).alias("__i"))
    added = draws.join(_numbered(df, key, seed), "__i").drop("__i")
    return base.unionByName(added.select(*df.columns, "draw"))


def merge_splits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that keep their own split, together with newly split rows."""
    return old.unionByName(new, allowMissingColumns=True)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_results(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """New rows replace old rows of the same key; the last one wins inside a batch."""
    rest = [c for c in old.columns if c != key]
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__batch", F.lit(1)))
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("__batch", *order)).alias("r"))
    return last.select(key, "r.*").select(*old.columns)


BUCKET = "key_bucket"


def _key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias(BUCKET)


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Store ``df`` by hash buckets of ``key``, one folder each, for ``upsert_stored``. Choose ``buckets`` so that
    one holds a few files' worth of rows."""
    df.withColumn(BUCKET, _key_bucket(key, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert_stored(new: DataFrame, path: str, key: str, order: Sequence[str], buckets: int = 64) -> None:
    """Upsert ``new`` into a table that ``write_keyed`` stored with as many ``buckets``. Only buckets that hold a
    key of ``new`` are read and written again; the files of all others stay as they are.

    The merged buckets are first kept in the shared folder, as a folder cannot be read and replaced at once; a job
    that fails before the last write leaves the table as it was.
    """
    spark = new.sparkSession
    keyed = new.withColumn(BUCKET, _key_bucket(key, buckets))
    touched = [r[0] for r in keyed.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    merged = upsert(old.drop(BUCKET), keyed.drop(BUCKET), key, order)
    merged = materialize(merged.withColumn(BUCKET, _key_bucket(key, buckets)))
    merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
