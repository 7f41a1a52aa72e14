"""Stupid-backoff scores of documents under a bigram model of the whole corpus.

S(w | v) is c(v w) / c(v) where the pair occurs at least ``min_count`` times, else ``ALPHA`` * c(w) / N; a
document's first word has c(w) / N. A document's score is the sum of ln S over its words, each rounded to
millionths, so that sums do not depend on their order.

It is computed as joins on hash partitions. Documents are exploded to their distinct pairs with counts, dealt
by the hash of the pair's first word; there the pairs and their first words are counted and each pair is
scored. Pairs that are too rare are dealt again, by their second word, and meet the word counts there. What
both steps find is summed per document. On the way rows travel in packed columns, one for each bucket. The size
of the table bounds the number of buckets, so more tasks over the same table don't send more rows each.

Frequent keys never meet in one task. Words with more than 1 / ``HOT`` of all words are at most ``HOT`` words;
pairs with more than 1 / ``HOT_PAIRS`` are as few, and both their words are at least as frequent. Their counts are broadcast: hot pairs are scored where the document is read, rare pairs with a
hot second word are scored without the second step, and pairs with a hot first word are dealt by the whole
pair.

Defined results: a null or empty text has no words, sum 0 and a null score; rows with one id are one document
and their texts follow each other as texts of their own; rows with a null id take no part. Words are runs of
letters, digits and characters beyond ASCII; case of A-Z does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.session import materialize

from .words import ALNUM, grouped, hashed_words, map_batches, mix, text_bytes

HOT = 1 << 16
HOT_PAIRS = 1 << 12
ALPHA = 0.4
AT_ONCE = 1 << 20  # pairs that a task combines at a time
BUCKETS_PER_PARTITION = 8  # at most; fewer where a bucket would get less than this of the table:
BUCKET_BYTES = 1 << 18
BUCKET_DOCS = 1 << 10
_U = np.uint64
_END = np.uint64(0)  # stands for "no word follows"


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Compressed columns of 8-byte numbers. In signed columns bytes of one rank stand together, as their high
    bytes are mostly equal; unsigned ones are hashes, of which whole ones repeat."""
    import zstandard

    parts = [c.tobytes() if c.dtype == np.uint64 else np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack_columns(blobs: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    import zstandard

    parts = []
    for blob in blobs:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(len(kinds), -1)
        parts.append([c.view(k) if k is np.uint64 else np.ascontiguousarray(c.reshape(8, -1).T).view(k).ravel() for c, k in zip(raw, kinds)])
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]


def dealt(bucket: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, packed columns) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if b > a:
            yield int(bucket[a]), kind, pack_columns([c[a:b] for c in columns])


def _batch(rows) -> pa.RecordBatch:
    bucket, kind, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


SCHEMA = "bucket int, kind int, data binary"
PAIRS, SUMS, ASKS, COUNTS = range(4)


class Lookup:
    """Counts of few keys, by search in their sorted hashes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 if unknown."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys with sums of their values."""
    order = np.lexsort(keys[::-1])
    keys, values = [k[order] for k in keys], [v[order] for v in values]
    if not len(keys[0]):
        return keys, values
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v, at) for v in values]


def micro(ratio: np.ndarray) -> np.ndarray:
    return np.rint(1e6 * np.log(ratio)).astype(np.int64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) + w)


def _text_words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    ids = batch.column("doc_id").to_pylist()
    for first, hashes, bounds in hashed_words(text_bytes(batch, "text"), ALNUM):
        for i in range(len(bounds) - 1):
            yield ids[first + i], hashes[bounds[i] : bounds[i + 1]]


def _counted(docs: DataFrame, parts) -> DataFrame:
    """Sums over all documents of the keys that ``parts`` gives for a text: ``key``, ``n``."""

    def emit(batches):
        held, size = [], 0
        for batch in batches:
            for _, words in _text_words(batch):
                k = parts(words)
                held.append(k)
                size += len(k)
            if size >= AT_ONCE or held and batch.num_rows == 0:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def flush(held):
        k, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.mapInArrow(emit, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _collected(df: DataFrame) -> Lookup:
    rows = df.select("key", "n").collect()
    return Lookup(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), np.array([r[1] for r in rows], dtype=np.int64))


def _buckets(rows: DataFrame) -> tuple[int, int]:
    """Into how many buckets pairs and words are dealt, and sums of documents."""
    most = BUCKETS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    return min(most, 1 + size // BUCKET_BYTES), min(most, 1 + n // BUCKET_DOCS)


def _sum_rows(sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    if sums:
        (doc,), (total, n) = summed([np.concatenate([s[0] for s in sums])], [np.concatenate([s[i] for s in sums]) for i in (1, 2)])
        yield from dealt((mix(doc.view(np.uint64)) % _U(buckets)).astype(np.int64), [doc, total, n], SUMS)


def _gather(held: list, sums: list, buckets: int, at_end: bool = False) -> list[tuple[int, int, bytes]]:
    """Keep a bucket's sums with those of the task's other buckets; all of them as rows once they are many."""
    held.extend(x for x in sums if len(x[0]))
    if not held or not at_end and sum(len(x[0]) for x in held) < AT_ONCE:
        return []
    rows = list(_sum_rows(held, buckets))
    held.clear()
    return rows


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_count: int = 2) -> DataFrame:
    """``doc_id``, ``n_words``, ``logprob_micro`` (sum of ln S in millionths) and ``score`` (mean ln S)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    spark = rows.sparkSession
    buckets, sum_buckets = _buckets(rows)

    def count_rows(batch: pa.RecordBatch):
        k = batch.column("key").to_numpy().view(np.uint64)
        dealt_rows = list(dealt((mix(k) % _U(buckets)).astype(np.int64), [k, batch.column("n").to_numpy()], COUNTS))
        yield dict(zip(("bucket", "kind", "data"), zip(*dealt_rows))) if dealt_rows else {"bucket": [], "kind": [], "data": []}

    def word_counts(batch: pa.RecordBatch, least: int):
        """Counts above ``least``; the smaller ones as one sum with a null key."""
        key, n = unpack_columns(batch.column("data").to_pylist(), [np.uint64, np.int64])
        more = n > least
        yield {"key": [*key[more].view(np.int64).tolist(), None], "n": [*n[more].tolist(), int(n[~more].sum())]}

    counted = materialize(map_batches(_counted(rows, lambda w: w), count_rows, SCHEMA))
    total = map_batches(counted, lambda b: word_counts(b, 1 << 62), "key long, n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = total // HOT
    hot_words = spark.sparkContext.broadcast(_collected(map_batches(counted, lambda b: word_counts(b, least), "key long, n long").where("key IS NOT NULL")))
    rarest = total // HOT_PAIRS
    both_hot = _counted(rows, lambda w: pair_key(w[:-1], w[1:])[np.minimum(hot_words.value(w[:-1]), hot_words.value(w[1:])) > rarest])
    hot_pairs = spark.sparkContext.broadcast(_collected(both_hot.where((F.col("n") > rarest) & (F.col("n") >= min_count))))

    def explode(batches):
        def flush():
            doc, v, w, first = (np.concatenate(c) for c in zip(*held))
            out, sums = [], []
            count, pair = hot_words.value(w), hot_pairs.value(pair_key(v, w))
            known = first & (count > 0)
            sums.append((doc[known], micro(count[known] / total), np.ones(known.sum(), np.int64)))
            known = ~first & (pair > 0)
            sums.append((doc[known], micro(pair[known] / hot_words.value(v[known])), np.ones(known.sum(), np.int64)))
            ask = first & (count == 0)
            (w1, d1), (m1,) = summed([w[ask], doc[ask]], [np.ones(ask.sum(), np.int64)])
            out.extend(dealt((mix(w1) % _U(buckets)).astype(np.int64), [w1, d1, m1, np.zeros(len(w1), np.int64)], ASKS))
            rest = ~first & (pair == 0)
            (v2, w2, d2), (m2,) = summed([v[rest], w[rest], doc[rest]], [np.ones(rest.sum(), np.int64)])
            key = np.where(hot_words.value(v2) > 0, pair_key(v2, w2), mix(v2))
            out.extend(dealt((key % _U(buckets)).astype(np.int64), [v2, w2, d2, m2], PAIRS))
            out.extend(_sum_rows(sums, sum_buckets))
            return _batch(out)

        held, size = [], 0
        for batch in batches:
            for name, w in _text_words(batch):
                if len(w):
                    doc = np.full(len(w) + 1, name, dtype=np.int64)
                    # each word after the one before it, and the last one with no word after it
                    held.append((doc, np.append(_END, w), np.append(w, _END), np.arange(len(w) + 1) == 0))
                    size += len(w)
                if size >= AT_ONCE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def pairs_step(batches):
        held = []
        for batch in _by_bucket(batches):
            out, sums = list(batch[1]), []
            if batch[0].get(PAIRS):
                v, w, doc, m = unpack_columns(batch[0][PAIRS], [np.uint64, np.uint64, np.int64, np.int64])
                order = np.lexsort((w, v))
                v, w, doc, m = v[order], w[order], doc[order], m[order]
                new_v = np.append(True, v[1:] != v[:-1])
                new_pair = new_v | np.append(True, w[1:] != w[:-1])
                of_pair = np.add.reduceat(m, np.flatnonzero(new_pair))[np.cumsum(new_pair) - 1]
                of_word = np.add.reduceat(m, np.flatnonzero(new_v))[np.cumsum(new_v) - 1]
                hot = hot_words.value(v)
                of_word = np.where(hot > 0, hot, of_word)
                follows = w != _END
                seen = follows & (of_pair >= min_count)
                sums.append((doc[seen], m[seen] * micro(of_pair[seen] / of_word[seen]), m[seen]))
                rare = follows & ~seen
                count = hot_words.value(w)
                known = rare & (count > 0)
                sums.append((doc[known], m[known] * micro(ALPHA * count[known] / total), m[known]))
                ask = rare & (count == 0)
                (w1, d1), (m1,) = summed([w[ask], doc[ask]], [m[ask]])
                out.extend(dealt((mix(w1) % _U(buckets)).astype(np.int64), [w1, d1, m1, np.ones(len(w1), np.int64)], ASKS))
            out.extend(_gather(held, sums, sum_buckets))
            yield _batch(out)
        yield _batch(_gather(held, [], sum_buckets, at_end=True))

    def words_step(batches):
        held = []
        for batch in _by_bucket(batches):
            out, sums = [r for r in batch[1] if r[1] == SUMS], []
            if batch[0].get(ASKS):
                table = Lookup(*unpack_columns(batch[0].get(COUNTS, []), [np.uint64, np.int64]))
                w, doc, m, backed = unpack_columns(batch[0][ASKS], [np.uint64, np.int64, np.int64, np.int64])
                sums.append((doc, m * micro(np.where(backed > 0, ALPHA * table(w), table(w)) / total), m))
            out.extend(_gather(held, sums, sum_buckets))
            yield _batch(out)
        yield _batch(_gather(held, [], sum_buckets, at_end=True))

    def _by_bucket(batches):
        for _, rows in grouped(batches, ["bucket"]):
            by_kind: dict[int, list[bytes]] = {}
            kept = []
            for bucket, kind, data in zip(*(rows.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
                by_kind.setdefault(kind, []).append(data)
                if kind != PAIRS:
                    kept.append((bucket, kind, data))
            yield by_kind, kept

    def add_up(batches):
        for by_kind, _ in _by_bucket(batches):
            if by_kind.get(SUMS):
                (doc,), (total_micro, n) = summed(*(lambda c: ([c[0]], c[1:]))(unpack_columns(by_kind[SUMS], [np.int64] * 3)))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(total_micro), pa.array(n)], names=["doc_id", "logprob_micro", "n_words"])

    def together(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket")

    paired = together(rows.mapInArrow(explode, SCHEMA)).mapInArrow(pairs_step, SCHEMA)
    scored = together(paired.unionByName(counted)).mapInArrow(words_step, SCHEMA)
    sums = together(scored.where(F.col("kind") == SUMS)).mapInArrow(add_up, "doc_id long, logprob_micro long, n_words long")
    mean = F.col("logprob_micro") / F.lit(1e6) / F.col("n_words")
    silent = rows.select("doc_id", F.lit(0).cast("long").alias("logprob_micro"), F.lit(0).cast("long").alias("n_words"))
    every = sums.unionByName(silent).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("logprob_micro").alias("logprob_micro"))
    return every.select("doc_id", "n_words", "logprob_micro", F.when(F.col("n_words") > 0, mean).alias("score"))
