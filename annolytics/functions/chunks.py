"""Chunking of one text into an array of chunk structs; a text is one row, so no shuffle is needed."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col

# Default separators.
SENTENCE_SEPARATORS = ["。", "！", "？", ". ", "! ", "? ", "\n\n"]
RECURSIVE_SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ", ""]


def _is_blank(c: Column) -> Column:
    """Whether there is white space only; the search ends at the first other character."""
    return ~c.rlike(r"(?U)\S")


def fixed_chunks(text: str | Column, size: int = 512, overlap: int = 50) -> Column:
    """array<struct(chunk_id, start_char, end_char, text)>; blank chunks take no id; ``end_char`` may pass the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")
    t, step = col(text), size - overlap
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(step)))
    pieces = F.filter(
        F.transform(starts, lambda s: F.struct(
            s.alias("start_char"), (s + size).alias("end_char"), F.substring(t, s + 1, F.lit(size)).alias("text"))),
        lambda p: ~_is_blank(p["text"]),
    )
    return F.transform(pieces, lambda p, i: F.struct(
        i.alias("chunk_id"), p["start_char"].alias("start_char"), p["end_char"].alias("end_char"), p["text"].alias("text")
    ))


def _apart(separators: Sequence[str]) -> bool:
    """Whether no two separators can overlap in a text, so that they may be marked one after the other."""
    return not any(
        a in b or any(a.endswith(b[:n]) for n in range(1, len(b))) for a in separators for b in separators if a != b
    )


def split_sentences(text: str | Column, separators: Sequence[str] = SENTENCE_SEPARATORS) -> Column:
    """Sentences with their separators, blank ones dropped; together they are the text without blanks.

    A mark is put behind every separator and the text split there. A control character that is already
    in the text is escaped first, so it can never be taken for the mark.
    """
    either = "|".join(re.escape(s) for s in separators)
    esc, mark = "\u0001\u0002", "\u0001\u0003"
    t = col(text)
    odd = t.contains("\u0001")
    safe = F.when(odd, F.replace(t, F.lit("\u0001"), F.lit(esc))).otherwise(t)
    marked = safe
    if _apart(separators):  # plain replacement, without a pattern, takes half the time
        for s in separators:
            marked = F.replace(marked, F.lit(s), F.lit(s + mark))
    else:
        marked = F.regexp_replace(safe, f"({either})", f"$1{mark}")
    parts = F.split(marked, mark)
    restored = F.when(odd, F.transform(parts, lambda p: F.replace(p, F.lit(esc), F.lit("\u0001")))).otherwise(parts)
    return F.filter(restored, lambda s: ~_is_blank(s))


def pack_sentences(sentences: str | Column, lengths: str | Column, size: int = 512, overlap: int = 1) -> Column:
    """Greedy packing: array<struct(chunk_id, sentence_count, text)>. Pass both arrays as plain columns.

    The fold keeps only chunk start positions; texts are cut out afterwards. ``overlap`` counts
    sentences carried into the next chunk, dropped when the closed chunk has no more than that many.
    """
    s, lengths = col(sentences), col(lengths)
    start = F.struct(
        F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"),
        F.lit(0).alias("used"), F.lit(0).alias("at"),
    )

    def step(acc: Column, n: Column) -> Column:
        at, first = acc["at"], acc["first"]
        full = (acc["used"] + n > size) & (at > first)
        if overlap > 0:
            carry = at - first > overlap
            kept = F.when(carry, at - overlap).otherwise(at)
            kept_len = F.when(
                carry, F.aggregate(F.slice(lengths, at - overlap + 1, F.lit(overlap)), F.lit(0), lambda a, v: a + v)
            ).otherwise(0)
        else:
            kept, kept_len = at, F.lit(0)
        closed = F.array_append(acc["done"], F.struct(first.alias("first"), (at - 1).alias("last")))
        return F.struct(
            F.when(full, closed).otherwise(acc["done"]).alias("done"),
            F.when(full, kept).otherwise(first).alias("first"),
            (F.when(full, kept_len).otherwise(acc["used"]) + n).alias("used"), (at + 1).alias("at"),
        )

    def finish(acc: Column) -> Column:
        tail = F.struct(acc["first"].alias("first"), (acc["at"] - 1).alias("last"))
        return F.when(acc["at"] > acc["first"], F.array_append(acc["done"], tail)).otherwise(acc["done"])

    ranges = F.aggregate(lengths, start, step, finish)
    return F.transform(ranges, lambda r, i: F.struct(
        i.alias("chunk_id"), (r["last"] - r["first"] + 1).alias("sentence_count"),
        F.array_join(F.slice(s, r["first"] + 1, r["last"] - r["first"] + 1), "").alias("text"),
    ))


def _level_spans(text: str, start: int, end: int, sep: str, size: int) -> list[tuple[int, int, bool]]:
    """Cut ``text[start:end]`` at ``sep`` and join neighbours while they fit: (start, end, too long)."""
    spans: list[tuple[int, int, bool]] = []
    begin = upto = start
    at = start
    while at <= end:
        stop = text.find(sep, at, end) if sep else -1
        stop = end if stop < 0 else stop
        if stop - begin > size:  # the part from ``at`` does not fit behind what is open
            if upto > begin:
                spans.append((begin, min(upto, end), False))
            begin = at
            if stop - at > size:
                spans.append((at, stop, True))
                begin = stop + len(sep)
        upto = at = stop + max(1, len(sep))
        if not sep:
            upto = end
    if upto > begin:
        spans.append((begin, min(upto, end), False))
    return spans


def recursive_pieces(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Pieces of a text by ever finer separators.

    First only spans of the text are settled: each level joins neighbouring parts up to ``size`` and hands
    parts that are too long to the next level, over a work list. Then pieces are cut out from the finest level
    up; at each level characters of its separator are stripped from a piece's end, blank pieces go, and each
    piece gets the end of the one before it in front, so pieces may exceed ``size``.
    """
    levels = [*separators] or [""]
    nodes: list[tuple[str, list[tuple[int, int, int | None]]]] = []  # separator, (start, end, node of a finer level)
    work: list[tuple[int, int, int]] = [(0, len(text), 0)]
    while len(nodes) < len(work):
        start, end, level = work[len(nodes)]
        sep, deeper = levels[level], level + 1 < len(levels)
        parts: list[tuple[int, int, int | None]] = []
        for a, b, too_long in _level_spans(text, start, end, sep, size):
            if too_long and deeper:
                work.append((a, b, level + 1))
            parts.append((a, b, len(work) - 1 if too_long and deeper else None))
        nodes.append((sep, parts))
    made: dict[int, list[str]] = {}
    for number in range(len(nodes) - 1, -1, -1):
        sep, parts = nodes[number]
        pieces: list[str] = []
        for a, b, finer in parts:
            pieces.extend([text[a:b].rstrip(sep)] if finer is None else made.pop(finer))
        if overlap > 0:
            pieces = [before[-overlap:] + piece for before, piece in zip(["", *pieces], pieces)]
        made[number] = [p for p in pieces if p.strip()]
    return made[0]


def recursive_chunks(text: str | Column, size: int = 512, overlap: int = 50, separators: Sequence[str] = RECURSIVE_SEPARATORS) -> Column:
    """array<string>; recursion is not expressible in SQL, so this is one Arrow stage."""
    seps = list(separators)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else recursive_pieces(t, size, overlap, seps))

    return split(col(text))
