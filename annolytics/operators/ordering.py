"""Ranks, prefix sums and neighbour windows that stay spread out when one group is huge.

A plain ``row_number().over(partitionBy(g))`` or ``lag`` puts a whole group into one task. Here
every window is partitioned by (group, bucket), with buckets that each hold a small part of the
order, and only one total per (group, bucket) is combined across buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_DIGITS = 4  # 65,536 buckets of a uniform hash
BLOCK = 8192  # positions per neighbour-window block
SAMPLED = 16  # random rows per range bucket that its bounds are taken from


def hash_order(seed: int, *keys: str) -> Column:
    """A seeded order that depends on key values only, never on partitioning; unique if keys are."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.concat(F.md5(F.concat(F.lit(f"{seed}|"), text)), F.lit("|"), text)


def group_key(keys: Sequence[str], name: str = "__k") -> Column:
    """Several columns as one struct. Inside a struct null equals null, so the key joins plainly, and a
    window partitioned by it needs no second shuffle before the join."""
    return F.struct(*keys).alias(name)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join with null matching null, keeping the left copy of the keys."""
    r = right.select(group_key(keys), *[c for c in right.columns if c not in keys])
    return left.withColumn("__k", group_key(keys)).join(r, "__k", how).drop("__k")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is computed once per row, whatever uses them later.

    A plain projection can be copied by the optimizer into every later filter and expression that names
    it. A generator is not copied: filters on its output stay above it, other filters still move below.
    """
    name = "__once"
    packed = F.struct(*[c.alias(k) for k, c in columns.items()])
    rows = df.select("*", F.explode(F.array(packed)).alias(name))
    return rows.select(*df.columns, *[F.col(f"{name}.{k}").alias(k) for k in columns])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a single-row frame to every row as a scalar subquery; no join takes place."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("__row", row).select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in one_row.columns])


def hash_cuts(
    df: DataFrame, by: Sequence[str], order: Column, take: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Per group, the order value of the ``take(n)``-th row, without sorting the rows.

    Counts per (group, hash bucket) find the one bucket that holds each cut; only that bucket's
    rows are ranked. Returns ``by``, ``n`` and one nullable column per name in ``take``.
    """
    keyed = df.select(*by, order.alias("__o"))
    keyed = keyed.withColumn(
        "__b", F.conv(F.substring("__o", 1, HASH_BUCKET_DIGITS), 16, 10).cast("int")
    )
    counts = keyed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("__cum", F.sum("__n").over(group.orderBy("__b"))).withColumn(
        "n", F.sum("__n").over(group)
    )
    totals = counts.groupBy(*by).agg(F.max("n").alias("n"))
    out = totals
    for name, size in take.items():
        want = size(F.col("n"))
        edge = counts.where((F.col("__cum") >= want) & (F.col("__cum") - F.col("__n") < want)).select(
            *by, "__b", (want - F.col("__cum") + F.col("__n")).alias("__need")
        )
        # at most 65,536 bucket numbers: rows of other buckets stay where they are
        near = keyed.join(F.broadcast(edge.select("__b").distinct()), "__b", "left_semi")
        ranked = _null_safe(near, edge, [*by, "__b"], "inner").withColumn(
            "__rn", F.row_number().over(group.orderBy("__o"))
        )
        cut = ranked.where(F.col("__rn") == F.col("__need")).select(*by, F.col("__o").alias(name))
        out = _null_safe(out, cut, by, "left") if by else attach_row(out, cut)
    return out


def with_cuts(
    df: DataFrame, by: Sequence[str], order: Column, take: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """``df`` plus ``__order`` and the cut columns of its group (one row per group joined on)."""
    cuts = hash_cuts(df, by, order, take)
    base = df.withColumn("__order", order)
    if by:
        return _null_safe(base, cuts, by, "left")
    return attach_row(base, cuts)


def entire(df: DataFrame) -> DataFrame:
    """``df`` with all columns computed, whichever of them are used later: branches that need different columns
    then have the same exchange below them, which runs once."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__row")).select("__row.*")


def order_bounds(df: DataFrame, order: Sequence[Column], buckets: int) -> DataFrame:
    """One row: ``bounds``, up to ``buckets - 1`` ascending values of ``order`` (structs o0, o1, ...) between which
    about equally many rows lie.

    They are quantiles of one random row for each class of a hash, the row with the smallest hash. This combines
    before the shuffle, takes one pass and no job while the plan is built, and ties in the first column are parted
    by the next ones. It depends on the rows alone: every use and every retry sees the same bounds, which random
    sketches do not promise.
    """
    names = [f"o{i}" for i in range(len(order))]
    rows = df.select(*[c.alias(n) for c, n in zip(order, names)]).withColumn("__h", F.xxhash64(*names))
    sampled = rows.groupBy(F.pmod("__h", F.lit(SAMPLED * buckets)).alias("__c")).agg(*[F.min_by(n, "__h").alias(n) for n in names])
    listed = sampled.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("s"))
    at = lambda i: F.get("s", F.floor(i * F.size("s") / buckets).cast("int"))
    quantiles = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), at)
    return listed.select(F.array_distinct(F.filter(quantiles, lambda q: q.isNotNull())).alias("bounds"))


def _bucket(bounds: Column, key: Column, buckets: int) -> Column:
    """How many of the ascending ``bounds`` are not above ``key``, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(bounds, n + step - 1) <= key, step).otherwise(0))


def with_range_bucket(df: DataFrame, order: Sequence[Column], name: str = "__b", buckets: int | None = None) -> DataFrame:
    """``df`` plus the number of its range bucket along ``order``; nulls come first."""
    if buckets is None:
        buckets = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    placed = attach_row(df.withColumn("__order", key), order_bounds(df, order, buckets))
    return placed.withColumn(name, _bucket(F.col("bounds"), F.col("__order"), buckets)).drop("bounds", "__order")


def _bucket_offsets(b: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per (group, bucket): totals of all earlier buckets of the group, under ``__k``."""
    totals = b.groupBy("__k").agg(*[c.alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*[F.col("__k")[c] for c in by]) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(F.col("__k")["__b"]).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__k", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def running_sums(
    df: DataFrame, by: Sequence[str], order: str, sums: dict[str, str], buckets: int | None = None
) -> DataFrame:
    """Inclusive prefix sums along ``order`` (unique within a group)."""
    b = with_range_bucket(entire(df), [F.col(order)], buckets=buckets).withColumn("__k", group_key([*by, "__b"]))
    offsets = _bucket_offsets(b, by, {f"__p_{c}": F.sum(c) for c in sums.values()})
    inside = Window.partitionBy("__k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[F.sum(c).over(inside).alias(f"__s_{c}") for c in sums.values()])
    return local.join(offsets, "__k").select(
        *df.columns, *[(F.col(f"__s_{c}") + F.col(f"__p_{c}")).alias(n) for n, c in sums.items()]
    )


def dense_rank_in_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str = "seq",
    buckets: int | None = None,
) -> DataFrame:
    """0-based position inside each group, along ascending ``order`` (unique within a group)."""
    b = with_range_bucket(df, order, buckets=buckets).withColumn("__k", group_key([*by, "__b"]))
    offsets = _bucket_offsets(b, by, {"__p": F.count(F.lit(1))})
    local = b.withColumn("__rn", F.row_number().over(Window.partitionBy("__k").orderBy(*order)))
    return local.join(offsets, "__k").select(
        *df.columns, (F.col("__p") + F.col("__rn") - 1).cast("long").alias(name)
    )


def rows_between(df: DataFrame, order: Sequence[str], start: int, stop: int | None, buckets: int = 512) -> DataFrame:
    """Rows whose position in ``order`` is in [start, stop); no ``stop``: to the last. They come in no certain order.

    The keys at both positions are found with an order-statistics table: one count per range bucket tells which
    buckets hold them, and only rows of these are ranked, in buckets of their own. The slice then is a filter
    between two keys, without a sort or a shuffle of its rows. Ties in ``order`` go by a hash of the whole row. Only
    rows that equal the one at an edge in all columns are numbered, to keep the right number of them.
    """
    edges = {"1": start, "2": stop}
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*df.columns).alias("h"))
    keys = with_range_bucket(df.select(key.alias("__key")), [F.col("__key")], buckets=buckets)
    counts = keys.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    table = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))

    def holds(position: int | None) -> Column:
        return (F.col("__before") <= position) & (F.col("__before") + F.col("__n") > position) if position else F.lit(False)

    hits = table.agg(*[F.max(F.when(holds(p), F.struct("__b", "__before"))).alias(f"__hit{e}") for e, p in edges.items()])
    near = attach_row(keys, hits)
    before = F.coalesce(*[F.when(F.col("__b") == F.col(f"__hit{e}.__b"), F.col(f"__hit{e}.__before")) for e in edges])
    near = near.withColumn("__before", before).where("__before IS NOT NULL").select("__key", F.col("__b").alias("__part"), "__before")
    ranked = dense_rank_in_group(near, ["__part"], [F.col("__key")], "__at").withColumn("__at", F.col("__at") + F.col("__before"))
    places = ranked.groupBy("__key").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))

    def edge(position: int | None) -> Column:
        inside = F.lit(position).between(F.col("__first"), F.col("__last")) if position else F.lit(False)
        return F.max(F.when(inside, F.struct(F.col("__key").alias("key"), (F.lit(position or 0) - F.col("__first")).alias("skip"))))

    rows = attach_row(df.withColumn("__key", key), places.agg(*[edge(p).alias(f"__edge{e}") for e, p in edges.items()]))
    this, first, last = F.col("__key"), F.col("__edge1"), F.col("__edge2")
    behind = F.coalesce(this > first["key"], F.lit(not start))  # no key at the start: no rows, or all
    ahead = F.coalesce(this < last["key"], F.lit(True))
    inner = rows.where(behind & ahead).select(*df.columns)
    equal = rows.where((this == first["key"]) | (this == last["key"]))
    equal = equal.withColumn("__i", F.row_number().over(Window.partitionBy("__key").orderBy("__key")) - 1)
    from_first = F.coalesce((this > first["key"]) | ((this == first["key"]) & (F.col("__i") >= first["skip"])), F.lit(not start))
    upto_last = F.coalesce((this < last["key"]) | ((this == last["key"]) & (F.col("__i") < last["skip"])), F.lit(True))
    return inner.unionByName(equal.where(from_first & upto_last).select(*df.columns))


def in_blocks(
    df: DataFrame, seq: str = "seq", before: int = 0, after: int = 0, size: int = BLOCK
) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block, so that a window over
    (group, ``__block``) sees ``before`` earlier and ``after`` later rows. ``__home`` marks the
    one copy of each row to keep."""
    if max(before, after) > size:
        raise ValueError("halo larger than the block")
    pos = F.col(seq)
    home = F.floor(pos / size)
    targets = [home]
    if before:
        targets.append(F.floor((pos + before) / size))
    if after:
        targets.append(F.floor((pos - after) / size))
    spread = df.withColumn("__block", F.explode(F.array_distinct(F.array(*targets))))
    return spread.where("__block >= 0").withColumn("__home", F.col("__block") == home)
