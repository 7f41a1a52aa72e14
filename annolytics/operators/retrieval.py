"""Exact and partitioned vector search, reranking and context assembly.

Vectors and queries are packed into blocks of bounded size on the executors, and each task scores one block
against another, keeping the best k rows of a query by (score, id); only those are ranked in the end. Blocks
come from the largest norm down, and a query leaves out the blocks whose vectors can't reach its k-th best score
so far. A flat index meets every query block. With an IVF index a query is sent to the blocks of its nearest
cells only; a cell with very many vectors is many blocks, so it is not one task's work.

Other columns of the index are read last, and only where the hits are: a bitmap of the hits' ids, a subquery of
at most 1 MB, keeps all other rows out of the join's shuffle, and a stored index opens only the folders of ids
that hold a hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import l2_normalize, preview
from .examples import threshold as apply_threshold

BLOCK_BYTES = 4 << 20  # of vectors in a block
ORDER_BYTES = 64 << 20  # of vectors that a task puts in order at a time
HELD_BYTES = 256 << 20  # of queries with their best rows that a task keeps
FILTER_BITS = 1 << 23  # of the hits' ids
BITMAP_BITS = 1 << 15  # in one bitmap of ``bitmap_construct_agg``
ID_BUCKET = "id_bucket"
METRICS = ("cosine", "ip", "l2")
DEFAULT_PROBES = 10


@dataclass
class VectorIndex:
    """Vectors (``id_col``, ``vec_col``, any other columns) and how to compare them. With ``centroids`` the
    frame has a ``cell`` column and search looks into the ``nprobe`` nearest cells only. A stored index has its
    other columns apart, in ``rows``, by ``buckets`` of ids."""

    vectors: DataFrame
    dimension: int
    metric: str = "cosine"
    id_col: str = "vec_id"
    vec_col: str = "embedding"
    centroids: np.ndarray | None = None
    nprobe: int = DEFAULT_PROBES
    rows: DataFrame | None = None
    buckets: int = 0

    @property
    def kind(self) -> str:
        return "flat" if self.centroids is None else "ivf_flat"


def build_index(df: DataFrame, dimension: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    v = l2_normalize(vec_col) if metric == "cosine" else F.col(vec_col).cast("array<double>")
    return VectorIndex(_checked(df, vec_col, dimension).withColumn(vec_col, v), dimension, metric, id_col, vec_col)


def _checked(df: DataFrame, vec_col: str, dimension: int) -> DataFrame:
    """Rows whose vector has another length fail the job when they are read."""
    size = F.coalesce(F.size(vec_col), F.lit(-1))
    message = F.concat(F.lit("vector dimension is "), size.cast("string"), F.lit(f", expected {dimension}"))
    right = F.when(size == dimension, F.col(vec_col)).otherwise(F.raise_error(message).cast(df.schema[vec_col].dataType))
    return df.withColumn(vec_col, right)


def add_vectors(index: VectorIndex, df: DataFrame) -> VectorIndex:
    """Index with more vectors; those of an IVF index go to the cell of their nearest centroid."""
    extra = build_index(df, index.dimension, index.metric, index.id_col, index.vec_col).vectors
    if index.centroids is not None:
        extra = _with_cell(extra, index.vec_col, index.centroids, index.metric)
    if index.rows is None:
        return replace(index, vectors=index.vectors.unionByName(extra))
    rows = index.rows.unionByName(with_bucket(other_columns(extra, index), index))
    return replace(index, vectors=index.vectors.unionByName(extra.select(index.vectors.columns)), rows=rows)


def other_columns(df: DataFrame, index: VectorIndex) -> DataFrame:
    """Ids with the columns that a search does not need."""
    return df.drop(index.vec_col, "cell")


def with_bucket(rows: DataFrame, index: VectorIndex) -> DataFrame:
    return rows.withColumn(ID_BUCKET, F.pmod(F.xxhash64(index.id_col), F.lit(index.buckets)).cast("int"))


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    flat = batch.column(name).flatten()
    return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)


def _near_cells(m: np.ndarray, centroids: np.ndarray, metric: str, n: int) -> np.ndarray:
    """The ``n`` cells nearest to each row, by inner product for ``ip``, else by distance; ties to the smaller."""
    away = -(m @ centroids.T) if metric == "ip" else (centroids * centroids).sum(axis=1) - 2 * m @ centroids.T
    return np.argsort(away, axis=1, kind="stable")[:, :n].astype("int32")


def _with_cell(df: DataFrame, vec_col: str, centroids: np.ndarray, metric: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("cell", pa.array(_near_cells(_matrix(b, vec_col, centroids.shape[1]), centroids, metric, 1)[:, 0]))

    return df.mapInArrow(run, schema)


def build_ivf(index: VectorIndex, nlist: int, seed: int = 42, iterations: int = 10, nprobe: int = DEFAULT_PROBES) -> VectorIndex:
    """Train ``nlist`` centroids on all vectors and give each vector its cell; searches look into ``nprobe`` cells."""
    features = index.vectors.select(array_to_vector(index.vec_col).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=iterations, initSteps=2).fit(features)
    centroids = np.array([np.asarray(c) for c in model.clusterCenters()])
    return replace(index, vectors=_with_cell(index.vectors, index.vec_col, centroids, index.metric), centroids=centroids, nprobe=nprobe)


def _scores(metric: str, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(queries × vectors) scores; higher is better."""
    if metric in ("cosine", "ip"):
        return q @ m.T
    return np.stack([1.0 / (1.0 + ((m - one) ** 2).sum(axis=1)) for one in q])


@dataclass
class Ball:
    """What bounds the scores of a block of vectors: a ball around them, and their least and largest norm."""

    centre: np.ndarray
    radius: float
    least: float
    most: float

    @classmethod
    def around(cls, m: np.ndarray) -> Ball:
        norms, centre = np.linalg.norm(m, axis=1), m.mean(axis=0)
        return cls(centre, float(np.linalg.norm(m - centre, axis=1).max()), float(norms.min()), float(norms.max()))

    def pack(self) -> bytes:
        return np.append(self.centre, [self.radius, self.least, self.most]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Ball:
        values = np.frombuffer(raw)
        return cls(values[:-3], *values[-3:].tolist())

    def highest(self, metric: str, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """A score that no vector of the block exceeds, for each query; wide enough for rounding."""
        loose = 1e-9 * (1 + norms) * (1 + self.most)
        if metric in ("cosine", "ip"):
            return np.minimum(q @ self.centre + norms * self.radius, norms * self.most) + loose
        apart = np.maximum(np.linalg.norm(q - self.centre, axis=1) - self.radius, np.maximum(norms - self.most, self.least - norms))
        return 1.0 / (1.0 + np.maximum(apart - loose, 0.0) ** 2) + 1e-12


def first_k(s: np.ndarray, k: int) -> np.ndarray:
    """Which ``k`` entries of each row are the largest, ties to the earlier column."""
    if s.shape[1] <= k:
        return np.ones(s.shape, dtype=bool)
    floor = np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
    more, ties = s > floor, s == floor
    return more | ties & (np.cumsum(ties, axis=1) <= k - more.sum(axis=1, keepdims=True))


class BestRows:
    """The best ``k`` vectors of each query of a block, as blocks of vectors come by."""

    def __init__(self, metric: str, q: np.ndarray, q_ids: pa.Array, k: int):
        self.metric, self.q, self.q_ids, self.k = metric, q, q_ids, k
        self.norms = np.linalg.norm(q, axis=1)
        self.top = np.full((len(q), k), -np.inf)  # best scores, the least of them first
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = self.skipped = 0

    @property
    def nbytes(self) -> int:
        return self.q.nbytes + 3 * self.top.nbytes

    def add(self, m: np.ndarray, ids: pa.Array, ball: Ball) -> None:
        """Take a block of vectors in the order of their ids."""
        wanted = np.flatnonzero(ball.highest(self.metric, self.q, self.norms) >= self.top[:, 0])
        self.skipped += len(self.q) - len(wanted)
        for at in range(0, len(wanted), 256):
            part = wanted[at:at + 256]
            s = _scores(self.metric, m, self.q[part])
            row, col = np.nonzero(first_k(s, self.k) & (s >= self.top[part, :1]))
            self.found.append((part[row], s[row, col], ids.take(pa.array(col))))
            self.held += len(row)
            both = np.concatenate([self.top[part], s], axis=1)
            self.top[part] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:], axis=1)
        if self.held > 4 * self.top.size + 65536:
            self._cut()

    def _cut(self) -> None:
        row, score = (np.concatenate([f[i] for f in self.found]) for i in (0, 1))
        ids = pa.concat_arrays([f[2] for f in self.found])
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, -score, row))
        first = np.searchsorted(row[order], row[order], side="left")
        order = order[np.arange(len(order)) - first < self.k]
        self.found, self.held = [(row[order], score[order], ids.take(pa.array(order)))], len(order)

    def batch(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.found:
            self._cut()
            row, score, ids = self.found[0]
            yield pa.RecordBatch.from_arrays([self.q_ids.take(pa.array(row)), ids, pa.array(score)], names=names)


def _in_order(m: np.ndarray, ids: pa.Array, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows from the largest norm down, and the place of each row's id. Of neighbours with one vector only the
    ``k`` smallest ids stay: the others can't be among the best."""
    place = np.empty(len(ids), dtype=np.int64)
    place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    # equal norms are parted by the first components, so that equal vectors are neighbours
    rows = rows[np.lexsort((place[rows], *m[rows][:, :3].T, -np.linalg.norm(m[rows], axis=1)))]
    new = np.append(True, (m[rows[1:]] != m[rows[:-1]]).any(axis=1))
    nth = np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return rows[nth < k], place


def _packed(df: DataFrame, id_col: str, vec_col: str, dim: int, name: str, block_bytes: int, k: int | None = None) -> DataFrame:
    """Blocks of vectors with the same ``cell`` (0 without cells): their ids, their matrix and, with ``k``, what
    bounds them, else a name for the block."""
    most = max(1, block_bytes // (8 * dim))
    celled = "cell" in df.columns
    extra = T.StructField(f"{name}_ball", T.BinaryType()) if k else T.StructField(f"{name}_name", T.StringType())
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField(f"{name}_ids", T.ArrayType(df.schema[id_col].dataType)),
        T.StructField(f"{name}_matrix", T.BinaryType()), extra,
    ])

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        b = table.combine_chunks().to_batches()[0]
        m, ids = _matrix(b, vec_col, dim), b.column(id_col)
        cell = b.column("cell").to_numpy(zero_copy_only=False) if celled else np.zeros(b.num_rows, dtype="int32")
        order = np.argsort(cell, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            place = None
            if k:
                rows, place = _in_order(m, ids, rows, k)
            for at in range(0, len(rows), most):
                part = rows[at:at + most]
                if k:
                    part = part[np.argsort(place[part])]
                own = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.take(pa.array(part)))
                more = pa.array([Ball.around(m[part]).pack()], pa.binary()) if k else pa.array([uuid.uuid4().hex])
                yield pa.RecordBatch.from_arrays([pa.array([cell[part[0]]], pa.int32()), own, pa.array([m[part].tobytes()], pa.binary()), more], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            if b.num_rows:
                kept.append(b)
                n += b.num_rows
            if n * dim * 8 >= ORDER_BYTES:
                yield from blocks(pa.Table.from_batches(kept))
                kept, n = [], 0
        if kept:
            yield from blocks(pa.Table.from_batches(kept))

    return df.mapInArrow(run, schema)


def search(
    index: VectorIndex, queries: DataFrame, k: int, qid: str = "query_id", qvec: str = "query_vec",
    block_bytes: int = BLOCK_BYTES, nprobe: int | None = None,
) -> DataFrame:
    """Best k per query as (qid, id, score, rank). cosine/ip: inner product; l2: 1/(1+squared distance).

    Ties go to the smaller id; fewer than k rows when the index is smaller; none when it is empty.
    ``nprobe`` replaces the index's number of cells.
    """
    vec = l2_normalize(qvec) if index.metric == "cosine" else F.col(qvec).cast("array<double>")
    asked = _checked(queries.select(qid, qvec), qvec, index.dimension).select(F.col(qid).alias("__q"), vec.alias("__v"))
    metric, dim, centroids, id_col = index.metric, index.dimension, index.centroids, index.id_col
    columns = [id_col, index.vec_col]
    if centroids is None:
        stored, keys = index.vectors.select(*columns), []
    else:
        n = min(nprobe or index.nprobe, len(centroids))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.append_column("cells", pa.array(list(_near_cells(_matrix(b, "__v", dim), centroids, metric, n)), pa.list_(pa.int32())))

        schema = T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
        asked = asked.mapInArrow(probe, schema).select("__q", "__v", F.explode("cells").alias("cell"))
        # on a stored index this becomes a filter on the folders of cells
        probed = asked.where("cell >= 0").select("cell").distinct()
        stored = index.vectors.select(*columns, "cell").join(probed, "cell", "left_semi").sortWithinPartitions("cell")
        asked, keys = asked.repartition("cell"), ["cell"]
    left = _packed(stored, index.id_col, index.vec_col, dim, "v", block_bytes, k)
    right = _packed(asked, "__q", "__v", dim, "q", block_bytes)
    # blocks, not rows: a flat index has to meet every query
    pairs = left.join(right, "cell") if keys else left.drop("cell").crossJoin(right.drop("cell"))
    out = T.StructType([T.StructField(qid, asked.schema["__q"].dataType), T.StructField(index.id_col, index.vectors.schema[index.id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [qid, id_col, "score"]
        held: dict[str, BestRows] = {}
        for b in batches:
            for i in range(b.num_rows):
                name = b.column("q_name")[i].as_py()
                if name not in held:
                    if sum(best.nbytes for best in held.values()) > HELD_BYTES:
                        for best in held.values():
                            yield from best.batch(names)
                        held.clear()
                    q = np.frombuffer(b.column("q_matrix")[i].as_py()).reshape(-1, dim)
                    held[name] = BestRows(metric, q, b.column("q_ids")[i].values, k)
                m = np.frombuffer(b.column("v_matrix")[i].as_py()).reshape(-1, dim)
                held[name].add(m, b.column("v_ids")[i].values, Ball.unpack(b.column("v_ball")[i].as_py()))
        for best in held.values():
            yield from best.batch(names)

    w = Window.partitionBy(qid).orderBy(F.desc("score"), index.id_col)
    return pairs.mapInArrow(run, out).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that occur in the text: the default pair score."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(query), words(text))), F.size(words(query))), F.lit(0.0))


def rerank(
    candidates: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = None, top_k: int | None = None,
    qid: str = "query_id", query: str = "query", text: str = "text", tie: str = "rank",
) -> DataFrame:
    """Order candidates by a pair score (a built-in expression or a pandas UDF over (query, text)).

    ``score`` becomes the pair score, ``original_score`` keeps the old one; ``top_k`` overrides ``k``.
    """
    pair = (scorer or term_overlap)(F.col(query), F.col(text)).cast("double")
    w = Window.partitionBy(qid).orderBy(F.desc("rerank_score"), tie)
    scored = candidates.withColumns({"rerank_score": pair, "original_score": F.col("score")})
    return (
        scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= (top_k or k))
        .withColumns({"score": F.col("rerank_score"), "rank": F.col("__r")}).drop("__r")
    )


def hit_rows(index: VectorIndex, hits: DataFrame) -> DataFrame:
    """``hits`` with the index's other columns. Rows that are no hit leave before the join: their id is not in a
    bitmap of the hits' hashed ids. Folders of a stored index without a hit are not opened."""
    rows = index.rows if index.rows is not None else other_columns(index.vectors, index)
    if rows.columns == [index.id_col]:
        return hits.join(rows, index.id_col)
    place = F.pmod(F.xxhash64(index.id_col), F.lit(FILTER_BITS))
    part, bit = F.shiftright(place, 15).cast("int"), place.bitwiseAND(BITMAP_BITS - 1)
    maps = hits.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    by_part = maps.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("m"))
    bitmaps = by_part.select(F.transform(F.sequence(F.lit(0), F.lit(FILTER_BITS // BITMAP_BITS - 1)), lambda i: F.col("m")[i])).scalar()
    byte = F.conv(F.hex(F.substring(F.get(bitmaps, part), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    wanted = rows.where(F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False)))
    if index.buckets:
        # a filter on the folder column alone, so that it is decided before files are listed for reading
        buckets = with_bucket(hits.select(index.id_col), index).agg(F.collect_set(ID_BUCKET)).scalar()
        wanted = wanted.where(F.array_contains(buckets, F.col(ID_BUCKET))).drop(ID_BUCKET)
    return hits.join(wanted, index.id_col)


def retrieve(
    index: VectorIndex, queries: DataFrame, k: int, threshold: float | None = None, rerank_with: bool | Callable = False,
    rerank_top_k: int | None = None, text: str = "text", qid: str = "query_id", query: str = "query", qvec: str = "query_vec",
    candidates: int | None = None,
) -> DataFrame:
    """Search, threshold on the vector score, then optionally rerank ``candidates`` rows (3k by default, never
    fewer than the result is to have)."""
    fetch = max(k, rerank_top_k or 0, candidates or 3 * k) if rerank_with else k
    hits = apply_threshold(search(index, queries, fetch, qid, qvec), threshold)
    full = hit_rows(index, hits)
    if not rerank_with:
        return full
    pairs = full.join(queries.select(qid, query), qid)
    scorer = rerank_with if callable(rerank_with) else None
    return rerank(pairs, k, scorer, rerank_top_k, qid, query, text)


def build_context(hits: DataFrame, qid: str = "query_id", text: str = "text", filename: str = "filename", page: str = "page") -> DataFrame:
    """Per query: numbered blocks with source and page, and the source list with 200-character previews."""
    have = set(hits.columns)
    name = F.coalesce(F.col(filename).cast("string"), F.lit("unknown")) if filename in have else F.lit("unknown")
    where = F.coalesce(F.col(page).cast("string"), F.lit("N/A")) if page in have else F.lit("N/A")
    rows = hits.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct(  # k rows per query
        "rank", name.alias("filename"), where.alias("page"), F.col("score"), F.col(text).alias("text")
    ))).alias("r"))
    block = lambda x, i: F.concat(
        F.lit("[文档"), (i + 1).cast("string"), F.lit("] 来源: "), x["filename"], F.lit(", 页码: "), x["page"], F.lit("\n"), x["text"]
    )
    source = lambda x: F.struct(
        x["filename"].alias("filename"), x["page"].alias("page"), x["score"].alias("score"), preview(x["text"], 200).alias("text")
    )
    return rows.select(qid, F.array_join(F.transform("r", block), "\n\n").alias("context"), F.transform("r", source).alias("sources"))


def index_stats(index: VectorIndex, strategy: str = "unknown") -> DataFrame:
    return index.vectors.agg(F.count(F.lit(1)).alias("total_vectors")).select(
        F.lit(index.dimension).alias("dimension"), F.lit(index.metric).alias("metric"), F.lit(index.kind).alias("index_type"),
        F.lit(strategy).alias("strategy"), "total_vectors",
    )
