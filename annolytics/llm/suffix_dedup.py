"""Passages that repeat across documents, by sparse suffix arrays.

Of all suffixes of a text only those are kept that start at a minimiser: the place of the smallest hash of
``ANCHOR`` words among all places in ``size`` words. Equal passages of ``size`` words have the same
minimiser, so they have a kept suffix at the same distance from their start.

1. Kept suffixes are ordered by their first ``ANCHOR`` words. One without an equal neighbour from another
   document is in no repeated passage and leaves here; most do.
2. The others are extended to the left and right: a suffix stands for the passages of ``size`` words that have
   it as minimiser, a run of neighbouring starts. Suffixes with equal first words come together, their
   passages are sorted, and equal neighbours from different documents are repeats. Runs of repeated starts
   give spans, so a longer repeat comes out whole.

A suffix start that more than ``HOT_ROWS`` documents share is split: each of its passages goes by itself, by
hash, after each map task has kept one document of each passage and settled the others, which are repeats
already. The first occurrence of a passage is the one in the document with the smallest id.

Defined results: a text of fewer than ``size`` words has no passage; a passage that repeats only within one
document (also in rows with the same id) is no repeat; rows with a null id take no part and have no spans.
Words are runs of letters, digits and characters beyond ASCII; case of A-Z does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.session import materialize

from .url_filter import bloom, with_maybe_listed
from .words import ALNUM, add_columns, hashed_words, map_batches, mix, runs, shingles, text_bytes

_U = np.uint64
ANCHOR = 10
HOT_ROWS = 1000
AT_ONCE = 1 << 19  # passages that a task sorts at a time


class Suffixes:
    """Kept suffixes of one text: hash of the first words, and the starts they are minimiser of. Neighbouring
    suffixes with equal first words, as in a text that repeats a word, are kept as one."""

    __slots__ = ("keys", "first", "count")

    def __init__(self, words: np.ndarray, size: int):
        anchors = shingles(words, ANCHOR)
        least = np.lib.stride_tricks.sliding_window_view(anchors, size - ANCHOR + 1).min(axis=1)
        self.first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        self.count = np.diff(self.first, append=len(least))
        self.keys = least[self.first].view(np.int64)


def each_text(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    for _, hashes, bounds in hashed_words(texts, ALNUM):
        for i in range(len(bounds) - 1):
            yield hashes[bounds[i] : bounds[i + 1]]


def suffix_keys(docs: DataFrame, size: int) -> DataFrame:
    """Distinct ``key`` of the kept suffixes of each row, with its ``doc_id``."""

    def rows(batch: pa.RecordBatch):
        keys = [np.unique(Suffixes(w, size).keys) if len(w) >= size else np.zeros(0, np.int64) for w in each_text(text_bytes(batch, "text"))]
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        yield {"key": np.concatenate(keys) if keys else [], "doc_id": np.repeat(ids, [len(k) for k in keys])}

    return map_batches(docs, rows, "key long, doc_id long")


def _owners(key: np.ndarray, passage: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal passages together by rising document; for each in this order whether its passage
    is in several documents, and whether its document is the passage's first."""
    order = np.lexsort((doc, passage, key))
    k, p, d = key[order], passage[order], doc[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(k)) - 1
    return order, (d[last] != d[heads])[group] if len(k) else new, d == d[heads][group] if len(k) else new


def passages(docs: DataFrame, size: int) -> DataFrame:
    """Rows for the shuffle by ``key``: ``doc_id``, ``start``, hashes of the ``passages`` from there on, and
    ``state``: 0 open, 1 open but known to repeat, 2 settled as a later repeat (``n`` starts)."""

    def emit(batches):
        hot: list[tuple] = []
        held = 0
        for batch in batches:
            out = [[] for _ in range(6)]
            ids, known, hots = batch.column("doc_id").to_pylist(), batch.column("keys").to_pylist(), batch.column("hot").to_pylist()
            for i, words in enumerate(each_text(text_bytes(batch, "text"))):
                if len(words) < size:
                    continue
                s, every = Suffixes(words, size), runs(words, size).view(np.int64)
                popular = set(hots[i])
                for j in np.flatnonzero(np.isin(s.keys, np.array(known[i], dtype=np.int64))):
                    a, n, key = int(s.first[j]), int(s.count[j]), int(s.keys[j])
                    if key in popular:
                        hot.append((np.full(n, key), every[a : a + n], np.full(n, ids[i]), np.arange(a, a + n)))
                        held += n
                    else:
                        for c, v in zip(out, (key, ids[i], a, every[a : a + n], n, 0)):
                            c.append(v)
            yield _passage_batch(*out)
            if held >= AT_ONCE:
                yield _split(hot)
                hot, held = [], 0
        if hot:
            yield _split(hot)

    return docs.mapInArrow(emit, "key long, doc_id long, start int, passages array<long>, n int, state int")


def _passage_batch(key, doc, start, hashes, n, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(hashes, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(state, pa.int32())],
        names=["key", "doc_id", "start", "passages", "n", "state"],
    )


def _split(hot: list[tuple]) -> pa.RecordBatch:
    """Passages of hot suffixes one by one: open for the first document here, settled for all others."""
    key, passage, doc, start = (np.concatenate(c) for c in zip(*hot))
    order, shared, first = _owners(key, passage, doc)
    key, passage, doc, start = key[order], passage[order], doc[order], start[order]
    d, a, b = ranges(doc[~first], start[~first])
    key, passage, doc, start, shared = key[first], passage[first], doc[first], start[first], shared[first]
    own = mix(mix(key.view(np.uint64)) + passage.view(np.uint64)).view(np.int64)
    # equal passages at neighbouring starts, as in a text that repeats a word, stay in one row
    new = np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(own))
    offsets = np.concatenate([at, np.full(len(d) + 1, len(own))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(passage))
    spread = mix(d.view(np.uint64) + mix(a.astype(np.uint64))).view(np.int64)
    return _passage_batch(
        np.concatenate([own[at], spread]), np.concatenate([doc[at], d]), np.concatenate([start[at], a]), lists,
        np.concatenate([n, b - a]), np.concatenate([shared[at].astype(np.int32), np.full(len(d), 2)]),
    )


def ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts per document: document, first start, end."""
    order = np.lexsort((start, doc))
    d, s = doc[order], start[order].astype(np.int64)
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(d))[: len(at)] - 1
    return d[at], s[at], s[end] + 1


def compare(batches) -> Iterator[pa.RecordBatch]:
    """Repeated starts from rows sorted by key: ``doc_id``, ``start``, ``end``, ``later``."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        state, count = rows.column("state").to_numpy(), rows.column("n").to_numpy()
        key, doc, start = (rows.column(c).to_numpy() for c in ("key", "doc_id", "start"))
        opened = state < 2
        n = count[opened]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k, d, s = np.repeat(key[opened], n), np.repeat(doc[opened], n), np.repeat(start[opened], n) + place
        lists = rows.column("passages").combine_chunks()
        p = (pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy()
        order, shared, first = _owners(k, p, d)
        shared |= np.repeat(state[opened] == 1, n)[order]
        d, s = d[order], s[order]
        parts = [(*ranges(d[m], s[m]), later) for m, later in ((shared & first, False), (shared & ~first, True))]
        parts.append((doc[~opened], start[~opened].astype(np.int64), start[~opened] + count[~opened].astype(np.int64), True))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([x[0] for x in parts])), pa.array(np.concatenate([x[1] for x in parts])), pa.array(np.concatenate([x[2] for x in parts])), pa.array(np.concatenate([np.full(len(x[0]), x[3]) for x in parts]))],
            names=["doc_id", "start", "end", "later"],
        )

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        if size >= AT_ONCE:
            # a group ends where the key changes; what stands before that can be settled
            tail = held[-1].column("key")[held[-1].num_rows - 1].as_py()
            cut = int(np.searchsorted(key != tail, True)) if key[-1] != tail else None
            if cut is not None:
                held.append(batch.slice(0, cut))
                yield settle(pa.Table.from_batches(held))
                batch = batch.slice(cut)
                held, size = [], 0
        held.append(batch)
        size += int(batch.column("n").to_numpy().sum())
    if held:
        yield settle(pa.Table.from_batches(held))


def repeated_starts(docs: DataFrame, size: int = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Runs of starts of repeated passages: ``doc_id``, ``start``, ``end``, ``later`` (not the first occurrence)."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    keys = suffix_keys(rows, size)
    counts = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = counts.where("low < high").select("key", (F.col("n") > hot_rows).alias("hot"))
    found = keys.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))
    found = materialize(found)
    table = materialize(bloom(found.select(F.col("doc_id").cast("string").alias("key"))))
    texts = with_maybe_listed(rows, F.col("doc_id").cast("string"), table).where("__maybe").drop("__maybe").join(found, "doc_id")
    sent = passages(texts.select("doc_id", "text", "keys", "hot"), size)
    together = sent.repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(compare, "doc_id long, start long, end long, later boolean")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each document with repeats: ``doc_id``, ``spans`` (word ranges that occur in another document, end
    exclusive) and ``later`` (those of them that occur in a document with a smaller id)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    starts = materialize(repeated_starts(rows, size, hot_rows))
    per_doc = starts.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "later"))).alias("starts"))

    def spans(batch: pa.RecordBatch) -> dict:
        out = {"spans": [], "later": []}
        for found in batch.column("starts").to_pylist():
            for name, want in (("spans", (False, True)), ("later", (True,))):
                done: list[dict] = []
                for r in found:
                    if r["later"] in want:
                        if done and r["start"] <= done[-1]["end"]:
                            done[-1]["end"] = max(done[-1]["end"], r["end"] - 1 + size)
                        else:
                            done.append({"start": r["start"], "end": r["end"] - 1 + size})
                out[name].append(done)
        return out

    kind = "array<struct<start:long,end:long>>"
    return add_columns(per_doc, spans, f"spans {kind}, later {kind}").drop("starts")


def cut_spans(docs: DataFrame, spans: str, text: str = "text") -> DataFrame:
    """``docs`` without the words in ``spans``; each cut goes up to the next kept word. Null spans cut nothing."""

    def cut(batch: pa.RecordBatch) -> dict:
        out = []
        for raw, where in zip(text_bytes(batch, text), batch.column(spans).to_pylist()):
            if not raw or not where:
                out.append(raw)
                continue
            inside = np.frombuffer(raw.translate(ALNUM), dtype=np.uint8) != 32
            begin = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
            begin = np.append(begin, len(raw))
            kept, at = [], 0
            for s in where:
                kept.append(raw[at : begin[s["start"]]])
                at = int(begin[s["end"]])
            kept.append(raw[at:])
            out.append(b"".join(kept))
        return {text: [None if t is None else t.decode("utf-8", "replace") for t in out]}

    columns = docs.columns
    return add_columns(docs, cut, f"{text} string").select(*columns)
