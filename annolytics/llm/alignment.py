"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked in a corpus.

Both sides cut the bytes of a blank and the text: a byte-level BPE (A, ``tokenizers`` file) and a SentencePiece
BPE (B), which puts the blank there itself. Per Arrow batch, in lots of bounded text, the starts of all tokens
are keyed by document and byte, in one number. ``pandas.merge_asof`` finds for each start of A the token of B
that covers it, and for each start of B the covering token of A; the union of both directions is the set of
overlapping pairs, as of two overlapping tokens one starts inside the other. Where both sides start together
both have ended before, so these places cut the tokens into groups.

How many links of the corpus hold a pair of ids is a count per pair. Its most frequent pairs, at most
``HOT_PAIRS``, are broadcast to the documents' pairs, the rest is joined by a shuffle, where no pair is frequent
any more.

Defined results: a null or empty text, or one whose bytes the tokens of a side do not give back (B reads U+2581
as a blank), has no tokens, groups or links and an empty ``groups``. Rows are aligned one by one; repeated rows
and null ids are rows like others, and each adds to the counts. All pairs that tie for an id's highest count are
best. An empty table gives no rows. Only the id and the text of ``docs`` are read, so names cannot clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.session import scratch_path

from .recent import Recent
from .words import map_batches

LOT_CHARS = 1 << 20
CHUNKS = 300_000  # recent distinct chunks, in each of two generations
LONGEST_KEPT = 48
HOT_PAIRS = 1 << 19
ID_BITS = 20
BLANK = "▁"
#: A blank between these characters is the front of a token on both sides.
_CUT = re.compile(" (?<=[!-~¡-ɏ] )(?=[!-~¡-ɏ])")  # the blank first, so that the search runs from blank to blank
#: A chunk that can stand between others in one text: a cut is at both of its ends.
_BETWEEN = re.compile("[!-~¡-ɏ](?:.*[!-~¡-ɏ])?", re.DOTALL)
SIDE_B = 1 << 31  # marks an id of B among those of a chunk
UNLIKE_ID = np.uint32(0xFFFFFFFF)
UNLIKE = UNLIKE_ID.tobytes()  # stands for a chunk whose bytes a side does not give back


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves,
    the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers, with the bytes of each id, in a Python worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_of()
        spelled = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in spelled]
        pieces = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i in pieces for p in [self.b.id_to_piece(i)]]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        #: decimal digits of each id in the bytes of a number from the lowest on, the highest byte free; and how many
        shown = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.numerals = np.array([int.from_bytes(d, "little") for d in shown], np.int64), np.array([len(d) for d in shown])
        #: a piece over the front of a word would make a chunk's pieces depend on its neighbours
        self.by_chunk = not any(BLANK in self.b.id_to_piece(i).lstrip(BLANK) for i in pieces)
        self.recent: Recent[str, bytes] = Recent(CHUNKS)

    def _encode_a(self, chunks: list[str]) -> list[list[int]]:
        """Ids of A of each chunk. Those that can stand in one text are encoded together and cut by their bytes."""
        out: list[list[int]] = [[]] * len(chunks)
        joint, alone = [], []
        for i, c in enumerate(chunks):
            (joint if self.by_chunk and _BETWEEN.fullmatch(c) else alone).append(i)
        if joint:
            ids = self.a.encode_batch_fast([f" {' '.join([chunks[i] for i in joint])}"], add_special_tokens=False)[0].ids
            ends = np.cumsum(self.a_size[ids])
            upto = np.cumsum([len(chunks[i].encode()) + 1 for i in joint])
            bounds = np.searchsorted(ends, upto)
            if bounds[-1] < len(ends) and (ends[bounds] == upto).all():
                for i, j, k in zip(joint, [0, *(bounds[:-1] + 1).tolist()], (bounds + 1).tolist()):
                    out[i] = ids[j:k]
            else:
                alone += joint
        for i, e in zip(alone, self.a.encode_batch_fast([f" {chunks[i]}" for i in alone], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _encode(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of both sides per chunk, those of B marked, or ``UNLIKE`` if their bytes are not those of the chunk."""
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            raw = [f" {c}".encode() for c in part]
            sides, like = [], np.ones(len(part), dtype=bool)
            for ids, spelled, size, mark in ((self._encode_a(part), self.a_bytes, self.a_size, 0), (self.b.encode(part, num_threads=1), self.b_bytes, self.b_size, SIDE_B)):
                n = np.fromiter(map(len, ids), np.int64, len(part))
                flat = np.fromiter(chain.from_iterable(ids), np.int64, n.sum())
                ends = np.append(0, np.cumsum(size[flat]))[np.cumsum(n)]
                together = b"".join(map(spelled.__getitem__, flat.tolist()))
                if together != b"".join(raw) or (ends != np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))).any():
                    like &= [b"".join(map(spelled.__getitem__, i)) == r for i, r in zip(ids, raw)]
                sides.append((np.repeat(np.arange(len(part)), n), flat | mark))
            chunk, ids = (np.concatenate(c) for c in zip(*sides))
            bounds = (4 * np.append(0, np.cumsum(np.bincount(chunk, minlength=len(part))))).tolist()
            both = ids[np.argsort(chunk, kind="stable")].astype(np.uint32).tobytes()
            for c, i, j, same in zip(part, bounds, bounds[1:], like.tolist()):
                yield c, both[i:j] if same else UNLIKE

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of both sides of each text, those of B marked; none if the text cannot be aligned."""
        split = [(_CUT.split(t) if self.by_chunk else [t]) if t else [] for t in texts]
        distinct = set(chain.from_iterable(split))
        known = self.recent.with_all(distinct, self._encode)
        for chunks in split:
            ids = np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.uint32)
            yield ids if UNLIKE_ID not in ids else ids[:0]
        self.recent.drop(c for c in distinct if len(c) > LONGEST_KEPT)


class Lot:
    """Tokens of several documents, their links and groups."""

    def __init__(self, sides: Sides, texts: list[str | None]):
        texts_ids = list(sides.encode(texts))
        ids = np.concatenate([*texts_ids, np.empty(0, np.uint32)]).astype(np.int64)
        of_b = ids >= SIDE_B
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in texts_ids])
        self.n_a, self.n_b = (np.bincount(doc[side], minlength=len(texts)) for side in (~of_b, of_b))
        self.a, self.b = ids[~of_b], ids[of_b] - SIDE_B
        starts = [np.cumsum(size[side]) - size[side] for size, side in ((sides.a_size, self.a), (sides.b_size, self.b))]
        first, second = (pd.DataFrame({"at": s, "start": s, "token": np.arange(len(s))}) for s in starts)
        covering_b = pd.merge_asof(first[["at"]], second, on="at")
        covering_a = pd.merge_asof(second[["at"]], first, on="at")
        self.opens_a = (covering_b["start"] == covering_b["at"]).to_numpy()  # both sides start here
        self.opens_b = (covering_a["start"] == covering_a["at"]).to_numpy()
        inner = ~self.opens_b  # the other links of this direction are there already
        self.links_a = np.concatenate([np.arange(len(self.a)), covering_a["token"].to_numpy()[inner]]).astype(np.int64)
        self.links_b = np.concatenate([covering_b["token"].to_numpy(), np.flatnonzero(inner)]).astype(np.int64)
        self.numerals = sides.numerals
        self.doc_of_a = np.repeat(np.arange(len(texts)), self.n_a)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document, document by document: distinct pairs of ids in order, how often each is linked; and the
        number of distinct pairs of each document."""
        doc = self.doc_of_a[self.links_a]
        code = np.sort((doc << 2 * ID_BITS) | (self.a[self.links_a] << ID_BITS) | self.b[self.links_b])
        new = np.flatnonzero(np.diff(code, prepend=-1))
        distinct = code[new]
        return distinct & ((1 << 2 * ID_BITS) - 1), np.diff(new, append=len(code)), np.bincount(distinct >> 2 * ID_BITS, minlength=len(self.n_a))

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per document."""
        n = len(self.a) + len(self.b)
        if not n:
            return [""] * len(self.n_a)
        first_a, first_b = np.flatnonzero(self.opens_a), np.flatnonzero(self.opens_b)
        next_a = np.append(first_a[1:], len(self.a))
        ids, ends = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.int64)
        at_a = np.arange(len(self.a)) + first_b[np.cumsum(self.opens_a) - 1]
        at_b = np.arange(len(self.b)) + next_a[np.cumsum(self.opens_b) - 1]
        ids[at_a], ids[at_b] = self.a, self.b
        ends[at_a[next_a - 1]] = ord("|")
        ends[at_b[np.append(first_b[1:], len(self.b)) - 1]] = ord(";")
        spelled, digits = self.numerals
        letters = (spelled[ids] | ends << 56).astype("<i8").tobytes().translate(None, b"\0").decode()
        size = np.append(0, np.cumsum(digits[ids] + 1))
        bound = size[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        return [letters[i : max(i, j - 1)] for i, j in zip(bound, bound[1:])]


_SIDES: tuple[tuple[str, str], Sides] | None = None


def _sides(paths: tuple[str, str]) -> Sides:
    global _SIDES
    if _SIDES is None or _SIDES[0] != paths:
        _SIDES = paths, Sides(*paths)
    return _SIDES[1]


def _lots(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers and texts, together about ``LOT_CHARS`` characters; a text is never parted."""
    held: list[str | None] = []
    first, size = 0, 0
    for i, value in enumerate(texts):
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= LOT_CHARS:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` and, as arrays, its
    distinct ``pairs`` of ids (``pair_code``) with the number of ``times`` each one is linked."""

    def run(batch: pa.RecordBatch):
        for first, texts in _lots(batch.column("text")):
            lot = Lot(_sides((a_path, b_path)), texts)
            codes, times, sizes = lot.pairs()
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield {
                "doc_id": batch.column("doc_id").slice(first, len(texts)),
                "n_a": lot.n_a,
                "n_b": lot.n_b,
                "n_groups": np.bincount(lot.doc_of_a[lot.opens_a], minlength=len(texts)),
                "n_links": np.bincount(lot.doc_of_a[lot.links_a], minlength=len(texts)),
                "groups": lot.groups(),
                "pairs": pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes, pa.int64())),
                "times": pa.ListArray.from_arrays(pa.array(bounds), pa.array(times, pa.int64())),
            }

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_code(a: str, b: str):
    """The number that stands for a pair of ids."""
    return F.shiftleft(F.col(a).cast("long"), ID_BITS).bitwiseOR(F.col(b).cast("long"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its rows are needed more than once and cost tokenizing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def count_links(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` without its arrays, plus ``n_best``, the links whose pair has the highest count of all pairs of
    the same id of B, and ``count_sum``, the counts of all links together."""
    rows = _written(aligned.withColumn("__row", F.monotonically_increasing_id()), "alignment")
    links = rows.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("__row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("n"))
    id_b = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    counted = _written(counts.withColumn("id_b", id_b), "link-counts")
    highest = counted.groupBy("id_b").agg(F.max("n").alias("most"))  # at most one row per id
    counted = _written(counted.join(highest, "id_b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "link-counts-best")

    level = F.floor(F.log2("n")).cast("int").alias("level")
    least, room = 64, hot_pairs
    for r in sorted(counted.groupBy(level).count().collect(), reverse=True):  # a row per power of two
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    hot = counted.where(F.floor(F.log2("n")) >= least)  # at most hot_pairs rows
    found = links.join(F.broadcast(hot), "pair", "left")
    parts = found.where("n IS NOT NULL")
    if room < 0:
        rare = found.where("n IS NULL").select("__row", "pair", "times")
        parts = parts.unionByName(rare.join(counted.where(F.floor(F.log2("n")) < least), "pair"))
    sums = parts.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    kept = [c for c in rows.columns if c not in ("__row", "pairs", "times")]
    return rows.drop("pairs", "times").join(sums, "__row", "left").select(*kept, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
