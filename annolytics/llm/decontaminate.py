"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``size`` consecutive words of a benchmark item; an item of fewer words is one
window. Patterns of one length share three tables. The block table gives for each pair of words how far
the search may move on: the distance from the pair's last place in any pattern to the pattern's end. Only
where that is 0 do the last words of the position select a bucket, the first word a part of it, and the
patterns there are compared word by word.

The benchmark reaches executors in blocks of bounded size, one pass over the documents for each block; a
block is broadcast, and hits of a pass are merged with those of earlier passes, so no document is shuffled.

Defined results: a null or empty text has no words, no spans and no items; an item without words has no
window; repeated items count once for each id; an item without an id has spans, but is not among the items;
rows in are rows out, whatever their ids; an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.session import materialize

from .words import ALNUM, add_columns, map_batches, split_words, text_bytes

BLOCK_BYTES = 8 << 20  # of window texts in one pass
SUFFIX_WORDS = 3


class WindowTables:
    """Shift and bucket tables of all patterns with the same number of words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block, self.suffix = length, min(2, length), min(SUFFIX_WORDS, length)
        self.farthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                pair = words[end - self.block : end]
                self.shift[pair] = min(self.shift.get(pair, self.farthest), length - end)
            self.buckets[words[length - self.suffix :]][words[0]].append((list(words), items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, words: list[bytes]) -> Iterable[tuple[int, list[str]]]:
        """Start and items of each occurrence, by rising start."""
        length, block, suffix, farthest = self.length, self.block, self.suffix, self.farthest
        move, buckets = self.shift.get, self.buckets
        at, n = length, len(words)
        while at <= n:
            far = move((words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],), farthest)
            if far:
                at += far
                continue
            bucket = buckets.get(tuple(words[at - suffix : at]))
            if bucket:
                for pattern, items in bucket.get(words[at - length], ()):
                    if words[at - length : at] == pattern:
                        yield at - length, items
            at += 1


def build_tables(windows: Iterable[tuple[bytes, str]]) -> list[WindowTables]:
    """Tables from (window with its words joined by blanks, item) pairs, one for each window length."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
    for window, item in windows:
        words = tuple(bytes(window).split(b" "))
        by_length[len(words)][words].append(item)
    return [WindowTables(n, p) for n, p in sorted(by_length.items())]


def find_hits(words: list[bytes], tables: list[WindowTables], spans: list, items: Iterable[str]) -> tuple[list, list]:
    """Disjoint word spans and items after a search, with those known before."""
    found, known = [(s["start"], s["end"]) for s in spans], set(items)
    for t in tables:
        reach = -1
        for start, names in t.search(words):
            known.update(x for x in names if x is not None)
            if found and start <= reach:
                found[-1] = (found[-1][0], start + t.length)
            else:
                found.append((start, start + t.length))
            reach = start + t.length
    merged: list[list[int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [{"start": a, "end": b} for a, b in merged], sorted(known)


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """Distinct (window, item) pairs of a benchmark table."""

    def cut(batch: pa.RecordBatch):
        for name, raw in zip(batch.column("item").to_pylist(), text_bytes(batch, "text")):
            words = split_words(raw, ALNUM)
            got = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
            yield {"window": list(got), "item": [name] * len(got)}

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, cut, "window binary, item string").distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` plus ``n_words``, ``spans`` (disjoint word ranges of windows, end exclusive) and ``items``
    (ids as text, sorted). Columns of these names in ``docs`` are replaced."""
    spark = docs.sparkSession
    windows = materialize(item_windows(items, item_id, item_text, size))
    total = windows.agg(F.coalesce(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs
    for block in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block).collect()
        tables = spark.sparkContext.broadcast(build_tables((r["window"], r["item"]) for r in rows))

        def scan(batch: pa.RecordBatch, tables=tables, again=block > 0):
            before = batch.column("spans").to_pylist() if again else None
            names = batch.column("items").to_pylist() if again else None
            n, spans, items = [], [], []
            for i, raw in enumerate(text_bytes(batch, text)):
                words = split_words(raw, ALNUM)
                s, k = find_hits(words, tables.value, before[i] if again else [], names[i] if again else [])
                n.append(len(words)), spans.append(s), items.append(k)
            return {"n_words": n, "spans": spans, "items": items}

        out = add_columns(out, scan, "n_words long, spans array<struct<start:int,end:int>>, items array<string>")
        if block < blocks - 1:
            out = materialize(out)
    return out


def hit_words() -> Column:
    """Number of words in ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
