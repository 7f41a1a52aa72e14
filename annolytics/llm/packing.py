"""Best-fit packing of token pieces with exact complements.

Only the number of pieces of each length decides the plan, so the plan is made from one count per length
(at most ``capacity`` of them) and is as small for 10 as for 10 billion pieces. From the longest length down,
the gap left beside a piece is filled exactly: by one length, by a pair or by a triple that sums to the gap,
taken as often as all of its lengths are available. What finds no complement is placed best-fit, longest
first, into the smallest gap that holds it. Each step of the plan says: so many sequences, these lengths.

Pieces then get a rank among those of their length, without bringing a length into one task: rows are dealt
to (length, hash bucket) groups, ranked there, and moved up by the counts of earlier buckets. A piece's rank
falls into one range of the plan, which gives its sequence and its offset.

Defined results: a null or empty text is one piece of the end token alone; only documents longer than the
capacity are cut; rows with equal values are packed one by one, like all others; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolytics.session import materialize

from .recent import Recent
from .words import add_columns, map_batches, text_bytes

CACHED_WORDS = 200_000  # recent words, in each of two generations; about 40 MB for each in a Python worker
LONGEST_CACHED = 64
SLICE_BYTES = 2 << 20  # texts are encoded together in slices of about this size
ENCODED_BYTES = 128 << 10  # of words that the library encodes at once, as it holds a hundred bytes and more for each token
#: Punctuation from a word's last letter to its end is always a token run of its own; no apostrophes, as these may
#: start one. The first mark comes first in the pattern, so that the search runs from mark to mark.
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*(?=\s|$)")
#: Small Latin letters, a-z and U+00DF to U+00FF without the division sign: no normal form changes or joins them.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _dictionary(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Parts between blanks of all texts as a dictionary, and their bounds; empty parts may be among them."""
    split = pc.ascii_split_whitespace(texts)
    return split.offsets.to_numpy(), split.values.dictionary_encode()


def _lines(parts: pa.Array) -> bytes:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts.cast(pa.string())), "\n")[0].as_buffer().to_pybytes()


def _joined(ids: pa.LargeBinaryArray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """``ids[bounds[i]:bounds[i + 1]]`` joined to one value for each ``i``, over the same bytes; ``ids`` are not sliced."""
    ends = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy(), dtype=np.int64))[bounds]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), ids.buffers()[2] or pa.py_buffer(b"")])


def _portions(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The words in lists of about ``size`` bytes."""
    start = held = 0
    for i, word in enumerate(words):
        held += len(word)
        if held >= size or i == len(words) - 1:
            yield words[start : i + 1]
            start, held = i + 1, 0


class WordTokenizer:
    """Token ids of texts, encoded word by word.

    For a tokenizer that lowers case, splits at white space and drops it, the ids of a text are those of its
    words in order, so a word is encoded once as long as it stays among the recent ones.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.recent: Recent[bytes, bytes] = Recent(CACHED_WORDS)
        self.long: list[bytes] = []  # words too long to stay among the recent ones
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends: np.ndarray | None = None  # whether an id ends a part of the text, if the vocabulary tells
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word."""
        known: dict[bytes, bytes] = {}
        for portion in _portions(words, ENCODED_BYTES):
            known.update(self._encode_letters([w for w in portion if _LETTERS.fullmatch(w)]))
            if others := [w for w in portion if w not in known]:
                known.update(self._encode_any(others))
        self.long = [w for w in words if len(w) > LONGEST_CACHED]
        return known

    def _encode_letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that stay whole, cut where a part of the text ends; nothing if these ends don't tell.
        Ids without their places in the text cost about a third."""
        if self.ends is None or not words:
            return {}
        got = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        bounds = np.flatnonzero(self.ends[got]) + 1
        if len(bounds) != len(words) or bounds[-1] != len(got):
            return {}
        ids, upto = got.tobytes(), (4 * bounds).tolist()
        return dict(zip(words, map(ids.__getitem__, map(slice, [0, *upto], upto))))

    def _encode_any(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each word, encoded together as one text and cut by their places in it."""
        text = [w.decode() for w in words]
        ends = np.cumsum([len(w) + 1 for w in text])
        got = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
        owner = np.searchsorted(ends, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids)), side="right")
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        ids = np.asarray(got.ids, dtype="<u4").tobytes()
        for i, word in enumerate(words):
            yield word, ids[4 * bounds[i] : 4 * bounds[i + 1]]

    def _encode_slice(self, texts: list[bytes], whole: bool) -> Iterator[bytes]:
        """Each distinct part between blanks is looked at once, and each distinct word of them: the parts as they
        are, or words and tails. Ids are copied from words to parts, and from parts to all their places."""
        split, parts = _dictionary(pa.array(texts, pa.large_string()))
        if not whole and len(parts.dictionary):
            spaced = _TAIL.sub(rb" \g<0>", _lines(parts.dictionary)).split(b"\n")
            lists, words = _dictionary(pa.array(spaced, pa.large_string()))
        else:
            lists, words = _dictionary(parts.dictionary)
        distinct = _lines(words.dictionary).split(b"\n")
        known = self.recent.with_all(set(filter(None, distinct)), self._encode)
        ids = pa.array([known[w] if w else b"" for w in distinct], pa.large_binary())
        self.recent.drop(self.long)
        self.long = []
        of_parts = _joined(ids.take(words.indices), lists)
        return iter(_joined(of_parts.take(parts.indices), split).to_pylist())

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < SLICE_BYTES):
                size += len(texts[upto] or b"")
                upto += 1
            part = [t or b"" for t in texts[at:upto]]
            # a text that may hold a special token in its exact case stays as it is
            whole = [b"<|" in t for t in part]
            as_is = self._encode_slice([t for t, w in zip(part, whole) if w], True)
            lowered = self._encode_slice([t.lower() for t, w in zip(part, whole) if not w], False)
            yield from (next(as_is if w else lowered) for w in whole)
            at = upto


def tokenize_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and,
    if asked for, ``ids``."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batch: pa.RecordBatch):
        global _TOKENIZER
        if _TOKENIZER is None or _TOKENIZER[0] != path:
            _TOKENIZER = (path, WordTokenizer(path))
        rows = defaultdict(list)
        for name, raw in zip(batch.column("doc_id").to_pylist(), _TOKENIZER[1].encode(text_bytes(batch, "text"))):
            raw += end
            for k, at in enumerate(range(0, len(raw), step)):
                part = raw[at : at + step]
                rows["doc_id"].append(name), rows["piece"].append(k), rows["start"].append(at // 4)
                rows["length"].append(len(part) // 4), rows["ids_crc32"].append(zlib.crc32(part))
                if ids:
                    rows["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
        yield {c: rows[c] for c in columns}

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


_TOKENIZER: tuple[str, WordTokenizer] | None = None


def _times(parts: tuple[int, ...], left: np.ndarray) -> int:
    """How often these lengths are available together."""
    return min(int(left[p]) // parts.count(p) for p in set(parts))


def _complements(gap: int, longest: int, left: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Available lengths, none above ``longest``, that sum to ``gap``: single, pairs, triples; long parts first."""
    if gap <= longest and left[gap] > 0:
        yield (gap,)

    def pairs(total: int, most: int) -> np.ndarray:
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        return a[(left[a] > 0) & (left[total - a] > 0)] if len(a) else a

    for a in pairs(gap, longest):
        yield int(a), gap - int(a)
    top = min(longest, gap - 2)
    for a in range(top, (gap + 2) // 3 - 1, -1):
        if left[a] > 0:
            for b in pairs(gap - a, a):
                yield a, int(b), gap - a - int(b)


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences), using every counted piece once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        if 4 * length < capacity or not left[length]:
            continue
        for parts in _complements(capacity - length, length, left):
            n = _times((length, *parts), left)
            if n:
                plan.append(((length, *parts), n))
                np.subtract.at(left, [length, *parts], n)
            if not left[length]:
                break

    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, parts: tuple[int, ...], n: int) -> None:
        if not open_bins[gap]:
            gaps.insert(bisect_left(gaps, gap), gap)
        open_bins[gap].append((parts, n))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                most = capacity // length
                if n // most:
                    put(capacity - most * length, (length,) * most, n // most)
                if n % most:
                    put(capacity - n % most * length, (length,) * (n % most), 1)
                break
            gap = gaps[at]
            parts, bins = open_bins[gap].pop()
            if not open_bins[gap]:
                del gaps[at]
            used = min(n, bins)
            n -= used
            if bins > used:
                put(gap, parts, bins - used)
            put(gap - length, (*parts, length), used)
    for rest in open_bins.values():
        plan.extend(rest)
    return plan


def rank_ranges(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each range of the plan."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for parts, n in plan:
        offset = 0
        for p in parts:
            slots[p].append((used[p], sequence, offset))
            used[p] += n
            offset += p
        sequence += n
    return {p: tuple(np.asarray(c, dtype=np.int64) for c in zip(*rows)) for p, rows in slots.items()}


def ranked(pieces: DataFrame, size: str, buckets: int) -> DataFrame:
    """``pieces`` plus ``__rank``, from 0 within each length."""
    names = pieces.columns
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(size, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(size).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(size, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(size, "__bucket").orderBy(*[c for c in names if c != size])
    return keyed.withColumn("__at", F.row_number().over(inside)).join(first, [size, "__bucket"]).select(*names, (F.col("__first") + F.col("__at") - 1).alias("__rank"))


def pack(pieces: DataFrame, size: str = "length", capacity: int = 2048) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``; lengths from 1 to ``capacity``. All columns must be
    sortable; columns of the new names are replaced."""
    pieces = materialize(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy(size).count().collect()}
    ranges = rank_ranges(packing_plan(counts, capacity))
    buckets = max(8, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def place(batch: pa.RecordBatch) -> dict:
        length = batch.column(size).to_numpy(zero_copy_only=False)
        rank = batch.column("__rank").to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            first, base, at = ranges[int(length[rows[0]])]
            k = np.searchsorted(first, rank[rows], side="right") - 1
            sequence[rows], offset[rows] = base[k] + rank[rows] - first[k], at[k]
        return {"sequence_id": sequence, "offset": offset}

    return add_columns(ranked(pieces, size, buckets), place, "sequence_id long, offset long").drop("__rank")
