"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles (64-bit hashes); equal sets are one node. Two sets link
when ``100 * |a & b| >= percent * |a | b|``.

**Upper levels of the tree** are laid out by the shuffle. Sets that link differ in at most d shingles, so
with the hash range cut into m segments they agree in at least m - d of them. A set has a key for each
segment that is not empty, for its own size class and for the next one if it may link there. If more than d
of a set's segments are filled, every set it links with shares a key, and the smallest key of both is among
the d + 1 smallest of each, so only these are kept; if not, the set also has keys of a finer cut, so a pair
always shares one where the first of the two stops. Pairs of sets without a common key
can't have the overlap that a link needs, whatever they hold. Sets with a common key are then compared by their
bitmaps, once for each group of sets that keys have in common, and only those that can have the overlap stay
joined. Sets that are joined, directly or through others, form a cluster. Keys with many sets are combined
within each map task first, so a key that a third of all sets share reaches the shuffle a bounded number of
times per task.

What goes through the shuffle is small: nearly all keys belong to one set, so keys and sets travel in sorted
packs of about ten bytes a key (``packed``). Groups of sets that look alike share most of their sets; they meet
at the smallest set of each, and a set's bitmap goes there once for all of them.

**Lower levels** are trees in tasks. A cluster is dealt to blocks of bounded size. Leaves hold sets that are
alike; a node holds the OR of the bitmaps below it, the range of set sizes and the largest number of shingles
that a bitmap hides by collision. Two nodes are visited together only if the largest overlap that any pair
below them can have (common bits plus hidden shingles, or the smaller size) reaches the smallest overlap
that a link needs, and if their sets are not all known to be in one component. At the leaves the sets
themselves are compared. Every block gets its cluster's leader, and sets linked with it are in one component
across blocks; only sets that are not are then taken to the cluster's other blocks.

Defined results: a null or empty text has no shingles and links with nothing; a text with fewer words than a
shingle is one shingle; null ids take no part in links and components; rows with one id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.operators.graph import connected_components
from annolytics.session import materialize

from .url_filter import bloom, with_maybe_listed
from .words import BLANKS, batches_of_groups, grouped, hashed_words, map_batches, mix, shingles, small_batches, text_bytes

_U = np.uint64
CLASS_RATIO = 1.5
SMALL = 400  # shingles in the largest set of a class whose bitmaps are narrow
NARROW_BITS, WIDE_BITS = 1024, 8192
FEW = 32  # sets of a key that one map task passes on one by one
MANY = 1024  # sets of a key that are compared with each other; more stay joined without
ODD, SURE = 1, 2  # marks in the last bits of a key: narrow bitmaps; sets are joined without comparison
COMBINED_KEYS = 1 << 19  # keys that a map task combines at a time
CODE_BITS = 46  # of a key in a pack, with its marks
NODE_BYTES = 6  # of a digest ``d1``
BUCKET_SHINGLES = 1 << 18  # shingles of sets whose keys share a bucket; keys are fewer
HOME_ROWS = 1 << 15  # sets of groups, each as often as groups have it, that meet at one place
BLOCK_SHINGLES = 1 << 21  # shingles in a block: 16 MB
LEAF = 16
FINEST = 1 << 31
BITMAP_BITS = 2048


def largest_difference(a: int, b: int, percent: int) -> int:
    """Most shingles that are in only one of two linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def least_overlap(a, b, percent: int):
    """Fewest common shingles of two linked sets of these sizes."""
    return -((-(a + b) * percent) // (100 + percent))


@lru_cache(maxsize=None)
def size_class(k: int, percent: int) -> tuple[int, int, int, int]:
    """(smallest size, largest size, most differences, segments) of class ``k``; class 0 links equal sets only."""
    if k == 0:
        top = 1
        while largest_difference(top + 1, top + 1, percent) == 0:
            top += 1
        return 1, top, 0, 1
    low = size_class(k - 1, percent)[1] + 1
    top = max(low, int(low * CLASS_RATIO))
    most = largest_difference(top, top, percent)
    least_size, m = max(1, low * percent // 100), most + 1
    while m < 2 * (most + 1):
        empty = m * math.exp(-least_size / m)
        if m - empty - 3 * math.sqrt(empty) >= most + 1:
            break
        m += 1 + m // 64
    return low, top, most, m


@lru_cache(maxsize=65536)
def classes_of(size: int, percent: int) -> tuple[int, ...]:
    k = 0
    while size_class(k, percent)[1] < size:
        k += 1
    out = [k]
    while size * 100 >= percent * size_class(out[-1] + 1, percent)[0]:
        out.append(out[-1] + 1)
    return tuple(out)


def segment_keys(ordered: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set given as sorted hashes, with their marks."""
    out, spread = [], mix(ordered + _U(7))
    for k in classes_of(len(ordered), percent):
        _, top, most, m = size_class(k, percent)
        most = min(most, largest_difference(len(ordered), min(top, len(ordered) * 100 // percent), percent))
        while m > 1:
            segment = ((ordered >> _U(32)) * _U(m)) >> _U(32)
            starts = np.flatnonzero(np.diff(segment, prepend=segment[:1] + _U(1)))
            place = mix(segment[starts] + _U((k << 40) + (m << 1)))
            keys = mix(np.add.reduceat(spread, starts) ^ place)
            keys = (keys & ~_U(3)) | _U(ODD if top <= SMALL else 0)
            if len(starts) > most:
                out.append(np.partition(keys, most)[: most + 1])
                break
            out.append(keys)
            if m >= FINEST:  # so fine that no two shingles share a segment
                break
            m = min(4 * m, FINEST)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def each_set(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, hashes, bounds in hashed_words(texts, BLANKS):
        for i in range(len(bounds) - 1):
            yield np.unique(shingles(hashes[bounds[i] : bounds[i + 1]], words))


def digest(ordered: np.ndarray) -> tuple[int, int]:
    """112 bits of a set, as a number of 48 bits and a signed one of 64."""
    n = _U(len(ordered))
    d1, d2 = (mix((mix(ordered + _U(c))).sum(dtype=np.uint64) + n) for c in (11, 13))
    return int(d1 >> _U(64 - 8 * NODE_BYTES)), int(d2.astype(np.int64))


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, size ``n`` and digest ``d1``, ``d2`` of each row's set."""

    def rows(batch: pa.RecordBatch):
        sets = [(len(s), *digest(s)) for s in each_set(text_bytes(batch, "text"), words)]
        n, d1, d2 = zip(*sets) if sets else ((), (), ())
        yield {"doc_id": batch.column("doc_id"), "n": n, "d1": d1, "d2": d2}

    return map_batches(docs, rows, "doc_id long, n long, d1 long, d2 long")


def bitmap_rows(docs: DataFrame, words: int) -> DataFrame:
    """Digest ``d1``, ``d2``, size ``n`` and both bitmaps of the sets of each batch of rows, equal sets once."""

    def rows(batch: pa.RecordBatch):
        distinct = {digest(s): s for s in each_set(text_bytes(batch, "text"), words) if len(s)}
        sets, (d1, d2) = list(distinct.values()), zip(*distinct) if distinct else ((), ())
        yield {
            "d1": d1, "d2": d2, "n": [len(s) for s in sets],
            "narrow": [bitmaps([s], NARROW_BITS)[0].tobytes() if len(s) <= SMALL else None for s in sets],
            "wide": [bitmaps([s], WIDE_BITS)[0].tobytes() if len(s) > SMALL // 2 else None for s in sets],
        }

    return map_batches(docs, rows, "d1 long, d2 long, n long, narrow binary, wide binary")


def bitmaps(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of bits per set, as 64-bit words."""
    marks = np.zeros((len(sets), size), dtype=bool)
    for i, s in enumerate(sets):
        marks[i, (s >> _U(20)) & _U(size - 1)] = True
    return np.packbits(marks, axis=1).view(np.uint64)


def hidden_by(n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How many shingles of sets of sizes ``n`` their bitmaps hide by collision."""
    return n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def can_link(n: np.ndarray, bits: np.ndarray, hidden: np.ndarray, a, b, percent: int) -> np.ndarray:
    """Whether sets ``a`` and ``b`` (row numbers that broadcast) can have the overlap of a link: their common bits
    and the shingles that collide inside the set where fewer do are enough."""
    common = np.bitwise_count(bits[a] & bits[b]).sum(axis=-1, dtype=np.int64) + np.minimum(hidden[a], hidden[b])
    return (common >= least_overlap(n[a], n[b], percent)) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))


def _combined(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys and nodes. Of a key with more than ``FEW`` nodes only the first node stays; each
    further node then gets a sure key of its own with that node."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
    keys, nodes = keys[fresh], nodes[fresh]
    new = np.append(True, keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rest = (np.diff(at, append=len(keys)) > FEW)[group] & ~new
    pairs = np.unique(np.stack([nodes[at][group][rest], nodes[rest]]), axis=1)
    link = mix(mix(pairs[0]) + pairs[1]) | _U(SURE)
    return np.concatenate([keys[~rest], link, link]), np.concatenate([nodes[~rest], pairs[0], pairs[1]])


def packed(keys: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each ``bucket`` of the key range: ``pairs`` has, by key, the distance from the key before (from
    the bucket's start for the first) in ``width`` bytes and the node in ``NODE_BYTES``. Of a key, its first bits and
    its marks are kept; keys that only differ in the rest join sets that are then told apart by their bitmaps."""
    code = (keys >> _U(64 - CODE_BITS + 2) << _U(2)) | (keys & _U(3))
    order = np.argsort(code, kind="stable")
    code, nodes = code[order], nodes[order]
    bucket = (code * _U(buckets)) >> _U(CODE_BITS)
    new = np.append(True, bucket[1:] != bucket[:-1])
    gap = code - np.where(new, (bucket << _U(CODE_BITS)) // _U(buckets), np.append(_U(0), code[:-1]))
    width = max(1, (int(gap.max()).bit_length() + 7) // 8)
    pairs = np.empty((len(code), width + NODE_BYTES), dtype=np.uint8)
    pairs[:, :width] = gap.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    pairs[:, width:] = nodes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NODE_BYTES]
    at = np.flatnonzero(new)
    ends = (np.append(at, len(code)) * (width + NODE_BYTES)).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), pa.array(np.full(len(at), width, dtype=np.int32)), blobs], names=["bucket", "width", "pairs"])


def unpacked(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (first bits and marks) and nodes of rows made by ``packed``."""
    bucket, widths = batch.column("bucket").to_numpy().view(np.uint64), batch.column("width").to_numpy()
    keys, nodes = [], []
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        blobs = batch.column("pairs").take(pa.array(rows)).to_pylist()
        pairs = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, width + NODE_BYTES)
        whole = np.zeros((2, len(pairs), 8), dtype=np.uint8)
        whole[0, :, :width], whole[1, :, :NODE_BYTES] = pairs[:, :width], pairs[:, width:]
        gap, node = whole.view("<u8")[..., 0]
        size = np.array([len(b) for b in blobs]) // (width + NODE_BYTES)
        first = np.cumsum(size) - size
        start = (bucket[rows] << _U(CODE_BITS)) // _U(buckets)
        sums = np.cumsum(gap, dtype=np.uint64)
        keys.append(sums + np.repeat(start + gap[first] - sums[first], size)), nodes.append(node)
    return np.concatenate(keys), np.concatenate(nodes)


def key_groups(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Groups of sets with a common key: ``group`` (hash of its sets), ``mark`` and ``nodes`` (their ``d1``). A
    group comes once for each key that has just these sets."""

    def emit(batches):
        keys, nodes, held = [], [], 0

        def flush():
            return packed(*_combined(np.concatenate(keys), np.concatenate(nodes)), buckets)

        for batch in batches:
            for s in each_set(text_bytes(batch, "text"), words):
                if len(s):
                    k = segment_keys(s, percent)
                    keys.append(k), nodes.append(np.full(len(k), digest(s)[0], dtype=np.uint64))
                    held += len(k)
                if held >= COMBINED_KEYS:
                    yield flush()
                    keys, nodes, held = [], [], 0
        if held:
            yield flush()

    def meet(batches):
        for batch in batches_of_groups(batches, "bucket", 1):
            k, v = unpacked(batch, buckets)
            order = np.lexsort((v, k))
            k, v = k[order], v[order].view(np.int64)
            fresh = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))
            k, v = k[fresh], v[fresh]
            at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(at, append=len(k))
            mark = (k[at] & _U(3)).astype(np.int64)
            mark[size > MANY] = SURE
            keep = size > 1
            inside = np.repeat(keep & (mark < SURE), size)
            names = np.add.reduceat(mix(v.view(np.uint64) + _U(3)), at)
            n = size[keep & (mark < SURE)]
            whole = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(v[inside]))
            # sure groups go as pairs with their first set
            others = np.repeat(keep & (mark >= SURE), size)
            others[at] = False
            head = np.repeat(v[at], size)
            pairs = np.stack([head[others], v[others]], axis=1)
            two = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(pairs) + 1, 2).astype(np.int32)), pa.array(pairs.ravel()))
            pair_names = mix(pairs.view(np.uint64) + _U(3)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([names[keep & (mark < SURE)], pair_names]).view(np.int64)), pa.array(np.concatenate([mark[keep & (mark < SURE)], np.full(len(pairs), SURE)]).astype(np.int32)), pa.concat_arrays([whole, two])],
                names=["group", "mark", "nodes"],
            )

    keyed = small_batches(docs.select("text")).mapInArrow(emit, "bucket long, width int, pairs binary")
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "group long, mark int, nodes array<long>")


def joined_sets(percent: int):
    """Edges between sets of a group that can link, as far as they join sets; from rows sorted by ``home``, where
    those of its sets (``node``, ``n``, ``bits``) precede those of its groups (``nodes``)."""

    def forest(n: np.ndarray, bits: np.ndarray, hidden: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.arange(len(n))
        while len(left) > 1:
            open_, left = [left[0]], left[1:]
            while open_ and len(left):
                x = open_.pop()
                near = can_link(n, bits, hidden, np.array([x]), left, percent)
                yield from ((int(x), int(y)) for y in left[near])
                open_.extend(left[near])
                left = left[~near]

    def places(home: np.ndarray, node: np.ndarray, wanted_home: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each wanted set among rows of sets, and how many there are: one, or more of equal digests ``d1``."""
        order = np.lexsort((node, home))
        homes, at = np.unique(home[order], return_index=True)
        ends, low, high = np.append(at, len(home)), np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=np.int64)
        cuts = np.searchsorted(wanted_home, homes), np.searchsorted(wanted_home, homes, "right")
        for a, b, x, y in zip(ends[:-1], ends[1:], *cuts):
            there = node[order[a:b]]
            low[x:y], high[x:y] = a + np.searchsorted(there, wanted[x:y]), a + np.searchsorted(there, wanted[x:y], "right")
        found = high - low
        return order[np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())], found

    def run(batches):
        for batch in batches_of_groups(batches, "home", 1 << 13):
            home, lists = batch.column("home").to_numpy(), batch.column("nodes")
            are_groups = lists.is_valid().to_numpy(zero_copy_only=False)
            sets, lists = batch.filter(pa.array(~are_groups)), lists.filter(pa.array(are_groups))
            size = lists.value_lengths().to_numpy()
            members = np.repeat(home[are_groups], size)
            node, n = sets.column("node").to_numpy(), sets.column("n").to_numpy()
            bits = np.frombuffer(b"".join(sets.column("bits").to_pylist()), dtype=np.uint64).reshape(len(n), -1)
            hidden = hidden_by(n, bits)
            row, found = places(home[~are_groups], node, members, lists.flatten().to_numpy())
            group = np.repeat(np.repeat(np.arange(len(size)), size), found)
            size = np.bincount(group, minlength=len(size))
            at = np.cumsum(size) - size
            src, dst = [], []
            few = np.flatnonzero(np.repeat(size <= 4, size))
            for lag in (1, 2, 3):  # groups of up to four, all at once
                a = few[few + lag < len(group)]
                a = a[group[a] == group[a + lag]]
                a = a[can_link(n, bits, hidden, row[a], row[a + lag], percent)] if len(a) else a
                src.append(node[row[a]]), dst.append(node[row[a + lag]])
            known = Components(len(n))
            for i in np.flatnonzero(size > 4):
                g = row[at[i] : at[i] + size[i]]
                if len({known.find(x) for x in g.tolist()}) == 1:
                    continue
                for x, y in forest(n[g], bits[g], hidden[g]):
                    known.join(int(g[x]), int(g[y]))
                    src.append(node[g[[x]]]), dst.append(node[g[[y]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return run


def at_homes(groups: DataFrame, rows: int = HOME_ROWS) -> DataFrame:
    """``groups`` with ``home``, the place where they meet: one for those with the same smallest set, or several
    where their sets are more than ``rows``."""
    named = groups.withColumn("least", F.element_at("nodes", 1))
    parts = named.groupBy("mark", "least").agg(F.ceil(F.sum(F.size("nodes")) / rows).alias("parts")).where("parts > 1")
    dealt = named.join(parts, ["mark", "least"], "left")
    return dealt.select("group", "mark", "nodes", F.xxhash64("least", F.pmod("group", F.coalesce("parts", F.lit(1)))).alias("home"))


def sets_at_homes(groups: DataFrame) -> DataFrame:
    """Which sets are to come to which home: ``mark``, ``home`` and ``node``, each once."""
    return groups.select("mark", "home", F.explode("nodes").alias("node")).distinct()


def common_keys(docs: DataFrame, words: int, percent: int, shingles: int = 0) -> DataFrame:
    """Edges ``src``, ``dst`` between the digests ``d1`` of sets that have a common key and may link; ``n`` groups.
    ``shingles``: of all sets, for the number of buckets."""
    buckets = min(1 << (64 - CODE_BITS), max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles // BUCKET_SHINGLES))
    groups = materialize(key_groups(docs, words, percent, buckets).groupBy("group", "mark").agg(F.first("nodes").alias("nodes")))
    sure = groups.where(F.col("mark") >= SURE).select(F.element_at("nodes", 1).alias("src"), F.element_at("nodes", 2).alias("dst"))
    dealt = materialize(at_homes(groups.where(F.col("mark") < SURE)))
    asked = materialize(sets_at_homes(dealt))
    wanted = asked.select("node").distinct()
    sets = bitmap_rows(docs, words).repartition("d1").groupBy("d1", "d2").agg(F.min("n").alias("n"), F.min("narrow").alias("narrow"), F.min("wide").alias("wide"))
    sets = materialize(sets.join(wanted, F.col("d1") == F.col("node"), "left_semi"))
    edges = sure
    for mark, bits in ((ODD, "narrow"), (0, "wide")):
        come = asked.where(F.col("mark") == mark).join(sets.select("d1", "n", F.col(bits).alias("bits")), F.col("node") == F.col("d1"))
        rows = come.select("home", "node", "n", "bits", F.lit(None).cast("array<long>").alias("nodes"))
        meet = dealt.where(F.col("mark") == mark).select("home", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("bits"), "nodes")
        together = rows.unionByName(meet).repartition("home").sortWithinPartitions("home")
        edges = edges.unionByName(together.mapInArrow(joined_sets(percent), "src long, dst long"))
    return edges.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


class Node:
    """Part of a signature tree over sets ``first`` to ``last`` of a block."""

    __slots__ = ("first", "last", "children", "bits", "low", "high", "hidden")

    def __init__(self, first, last, children, bits, low, high, hidden):
        self.first, self.last, self.children = first, last, children
        self.bits, self.low, self.high, self.hidden = bits, low, high, hidden


class SignatureTree:
    """Tree over sets in the given order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.bits = bitmaps(sets, BITMAP_BITS)
        marks = np.unpackbits(self.bits.view(np.uint8), axis=1).astype(np.float32)
        self.hidden = self.sizes - marks.sum(axis=1).astype(np.int64)
        #: how many sets of the block have the shingles of each, on average: central sets come first
        self.central = (marks @ marks.sum(axis=0)) / np.maximum(1, marks.sum(axis=1))
        level = [self._node(i, min(i + LEAF, len(sets)), ()) for i in range(0, len(sets), LEAF)]
        while len(level) > 1:
            level = [self._node(g[0].first, g[-1].last, tuple(g)) for g in (level[i : i + 4] for i in range(0, len(level), 4))]
        self.root = level[0] if level else None

    def _node(self, first: int, last: int, children: tuple) -> Node:
        if children:
            bits = np.bitwise_or.reduce([c.bits for c in children])
            return Node(first, last, children, bits, min(c.low for c in children), max(c.high for c in children), max(c.hidden for c in children))
        at = slice(first, last)
        return Node(first, last, (), np.bitwise_or.reduce(self.bits[at], axis=0), int(self.sizes[at].min()), int(self.sizes[at].max()), int(self.hidden[at].max()))


class Components:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether the largest overlap that sets below two nodes can have is enough for a link."""
    if 100 * min(x.high, y.high) < percent * max(x.low, y.low):
        return False
    common = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.hidden, y.hidden)
    return min(common, x.high, y.high) >= least_overlap(x.low, y.low, percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    n = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (n - common)


def tree_links(x: SignatureTree, y: SignatureTree, known: Components, shift: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets of two trees that join components. Set ``i`` of ``y`` has number ``i + shift``;
    with ``x`` itself as ``y`` (``shift`` 0) each pair is met once."""
    if x.root is None or y.root is None:
        return
    same = x is y
    stack = [(x.root, y.root)]
    while stack:
        p, q = stack.pop()
        if not may_link(p, q, percent):
            continue
        if p.children or q.children:
            if p is q and same:
                stack.extend((c, d) for i, c in enumerate(p.children) for d in p.children[i:])
            elif p.children and (not q.children or p.last - p.first >= q.last - q.first):
                stack.extend((c, q) for c in p.children)
            else:
                stack.extend((p, c) for c in q.children)
            continue
        roots = {known.find(i) for i in range(p.first, p.last)} | {known.find(j + shift) for j in range(q.first, q.last)}
        if len(roots) == 1:
            continue
        a, b = slice(p.first, p.last), slice(q.first, q.last)
        common = np.bitwise_count(x.bits[a][:, None, :] & y.bits[b][None, :, :]).sum(axis=2) + np.minimum(x.hidden[a][:, None], y.hidden[b][None, :])
        enough = common >= least_overlap(x.sizes[a][:, None], y.sizes[b][None, :], percent)
        for i, j in zip(*np.nonzero(enough)):
            i, j = int(i) + p.first, int(j) + q.first
            if same and i >= j or known.find(i) == known.find(j + shift):
                continue
            if linked(x.sets[i], y.sets[j], percent):
                known.join(i, j + shift)
                yield i, j


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in table.column("set").to_pylist()]


def block_links(percent: int):
    """Links in each block: rows with ``kind`` 0 are links ``src``, ``dst``; rows with ``kind`` 1 are sets
    ``src`` that are not in the component of the cluster's leader."""

    def run(batches):
        for (cluster, _), rows in grouped(batches, ["cluster", "block"]):
            ids, leads = rows.column("rep").to_pylist(), rows.column("lead").to_pylist()
            keep = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            all_sets = _sets(rows)
            # sets with the same smallest hashes are neighbours in the tree
            keep.sort(key=lambda i: all_sets[i][:3].tolist())
            sets, names = [all_sets[i] for i in keep], [ids[i] for i in keep]
            leader = next((at for at, i in enumerate(keep) if leads[i]), 0)
            tree, known = SignatureTree(sets), Components(len(sets))
            out = []
            for first in dict.fromkeys([leader, int(tree.central.argmax())]):
                for i in range(len(sets)):
                    if known.find(i) != known.find(first) and linked(sets[first], sets[i], percent):
                        known.join(first, i)
                        out.append((0, names[first], names[i]))
            out.extend((0, names[i], names[j]) for i, j in tree_links(tree, tree, known, 0, percent))
            root = known.find(leader)
            out.extend((1, names[i], cluster) for i in range(len(sets)) if known.find(i) != root)
            if out:
                kind, src, dst = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["kind", "src", "dst"])

    return run


def cross_links(percent: int):
    """Links between the open sets of one block (``side`` 0) and all sets of another (``side`` 1)."""

    def run(batches):
        for _, rows in grouped(batches, ["cluster", "block", "other"]):
            side = np.array(rows.column("side").to_pylist())
            sets, ids, lead = _sets(rows), rows.column("rep").to_pylist(), rows.column("closed").to_pylist()
            parts = [sorted(np.flatnonzero(side == s).tolist(), key=lambda i: sets[i][:3].tolist()) for s in (0, 1)]
            x, y = (SignatureTree([sets[i] for i in p]) for p in parts)
            order = parts[0] + parts[1]
            known = Components(len(order))
            closed = [n for n, i in enumerate(order) if lead[i]]
            for n in closed[1:]:
                known.join(closed[0], n)
            found = [(ids[parts[0][i]], ids[parts[1][j]]) for i, j in tree_links(x, y, known, len(parts[0]), percent)]
            if found:
                src, dst = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def member_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``members`` (``rep``, ``d1``, ``d2`` and more) with the sorted shingles of their texts as ``set``."""
    extra = [c for c in members.columns if c not in ("d1", "d2")]
    table = materialize(bloom(members.select(F.col("rep").cast("string").alias("key")).distinct()))
    possible = with_maybe_listed(docs, F.col("doc_id").cast("string"), table).where("__maybe").drop("__maybe")
    joined = possible.join(members, F.col("doc_id") == F.col("rep")).drop("doc_id")

    def rows(batch: pa.RecordBatch):
        d1, d2 = batch.column("d1").to_pylist(), batch.column("d2").to_pylist()
        sets = list(each_set(text_bytes(batch, "text"), words))
        at = [i for i, s in enumerate(sets) if digest(s) == (d1[i], d2[i])]
        rest = batch.take(pa.array(at, pa.int64()))
        yield {c: rest.column(c) for c in extra} | {"set": [sets[i].tobytes() for i in at]}

    kinds = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in extra)
    return map_batches(joined, rows, f"{kinds}, set binary")


def links(docs: DataFrame, keys: DataFrame, words: int, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links ``src``, ``dst`` between class representatives that give the components of all links."""
    edges = materialize(common_keys(docs, words, percent, keys.agg(F.sum("n")).first()[0] or 0))
    clusters = connected_components(edges).select(F.col("node").alias("d1"), F.col("component").alias("cluster"))
    shared = edges.select(F.col("src").alias("d1"), "n").unionByName(edges.select(F.col("dst").alias("d1"), "n")).groupBy("d1").agg(F.sum("n").alias("shared"))
    classes = keys.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    members = materialize(classes.join(clusters, "d1").join(shared, "d1"))
    heads = members.groupBy("cluster").agg(F.max_by("rep", F.struct("shared", -F.col("rep"))).alias("leader"), F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    heads = materialize(heads)
    placed = materialize(members.join(heads, "cluster").withColumn("lead", F.col("rep") == F.col("leader")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = member_sets(docs, placed.select("rep", "d1", "d2", "cluster", "lead", "blocks"), words).select("cluster", F.explode(every).alias("block"), "rep", "lead", "set")
    in_blocks = dealt.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "rep")
    found = materialize(in_blocks.mapInArrow(block_links(percent), "kind int, src long, dst long"))

    opened = found.where("kind = 1").select(F.col("src").alias("rep")).distinct()
    wide = heads.where("blocks > 1")
    open_sets = members.join(wide, "cluster").join(opened, "rep").select("rep", "d1", "d2", "cluster", "blocks", own.alias("block"))
    asks = open_sets.select("cluster", F.col("block").alias("other")).distinct()
    seek = F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("block"))
    left = open_sets.select("rep", "d1", "d2", "cluster", F.explode(seek).alias("block"), F.col("block").alias("other"), F.lit(0).alias("side"), F.lit(False).alias("closed"))
    flagged = members.join(wide, "cluster").join(opened.withColumn("open", F.lit(True)), "rep", "left").select("rep", "d1", "d2", "cluster", own.alias("block"), F.col("open").isNull().alias("closed"))
    right = flagged.join(asks, "cluster").where("block != other").select("rep", "d1", "d2", "cluster", "block", "other", F.lit(1).alias("side"), "closed")
    far = member_sets(docs, materialize(left.unionByName(right)), words).repartition("cluster", "block", "other").sortWithinPartitions("cluster", "block", "other", "side", "rep")
    return found.where("kind = 0").select("src", "dst").unionByName(far.mapInArrow(cross_links(percent), "src long, dst long"))


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that links
    reach, itself included)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keys = materialize(set_rows(rows, words))
    parts = connected_components(links(rows, keys, words, percent, block))
    classes = keys.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    full = keys.where("n > 0").join(named, ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = keys.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)
