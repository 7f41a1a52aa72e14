"""Token counts by a finite-state transducer compiled from a SentencePiece BPE vocabulary.

A list of pieces is what the merges make of a text exactly if every two neighbours are what they make of these
two alone. So the last piece of a prefix follows from the last pieces of shorter prefixes, and only those
matter from whose end a longer piece may still start. Such places, with the piece before each one and the
number of pieces up to there against the number so far, are a state. A transition reads one character and
carries the change of the number of pieces: the transducer is deterministic, and its states are compiled when
a text first reaches them. It forgets what lies before a place that no piece of the vocabulary crosses, which
keeps states few; when there are more than ``STATES``, compilation starts anew, with the same counts.

Texts are cut into chunks, each a run of blanks with the word behind it. No piece goes over the front of such
a chunk, so its state map is constant: whatever the entry, one exit and one count. The prefix scan over the
maps of a batch therefore is a prefix sum of counts, and each distinct chunk is mapped once while it stays
among the recent ones. A chunk of more than ``PIECE`` characters is cut anywhere; the maps of its pieces are
found for the entry state that the characters before them suggest, and composed two by two. Where a map is
asked for an entry it has not, it is run from there, so counts never rest on the guess.

Defined results: a null or empty text has no bytes and no tokens. Repeated rows are counted one by one, ties
cannot occur, an empty table gives no rows. Columns with the names of new ones are replaced. A vocabulary with
a piece over the front of a word, with pieces given by users or unused ones, or without byte pieces, and one
whose counts differ from the library's on a few probes, is refused with ``ValueError``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recent import Recent
from .words import add_columns

BLANK = "▁"
STATES = 150_000  # with their transitions about 130 MB
NEVER = float("-inf")
CHUNKS = 300_000  # recent distinct chunks, in each of two generations
LONGEST_KEPT = 48
PIECE = 512
SLICE_CHARS = 1 << 20
_CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*")
_PROBES = ["a", " a", "a  b", "   ", "one two\n\tthree", "don't 12,345.67", "été ÿ 漢字 \U0001f600 \u0000", "aaaaaaaaaaaaaaaaaaaaaaaaa", "<s> </s> <unk> <0x41>", f"x{BLANK}y {BLANK}"]

#: (characters since the place, piece before it or None, pieces up to it against those so far)
Place = tuple[str, str | None, int]
StateMap = dict[int, tuple[int, int]]


class Transducer:
    """States and transitions of one vocabulary, compiled on demand."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(library.get_piece_size())
        if not any(map(library.is_byte, kinds)) or any(map(library.is_unused, kinds)):
            raise ValueError("only BPE vocabularies with byte pieces and without unused pieces can be compiled")
        special = [i for i in kinds if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in set(kinds) - set(special)}
        self.piece = {p: p for p in self.score}  # one object for each piece
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("a piece of the vocabulary goes over the front of a word")
        self.starts = {s: s for p in self.score for s in (p[:k] for k in range(1, len(p)))}
        self.inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.longest = max(map(len, self.score))
        self.recent: Recent[str, int] = Recent(CHUNKS)
        self._forget()
        if [self.count(t) for t in _PROBES] != [len(library.encode(t)) for t in _PROBES]:
            raise ValueError("the library's counts are not those of plain merges by score")

    def _forget(self) -> None:
        self.states: list[tuple[Place, ...]] = [(("", None, 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.stable: dict[tuple[str | None, str], bool] = {}

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text: of all neighbours, those with the best score merge first, the left ones of equals."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], NEVER)
        return parts

    def _follows(self, before: str | None, piece: str) -> bool:
        key = before, piece
        found = self.stable.get(key)
        if found is None:
            found = self.stable[key] = self._merged((before or "") + piece) == ([piece] if before is None else [before, piece])
        return found

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from ``state`` on ``char``: next state, change of the number of pieces."""
        grown = [(since + char, before, n) for since, before, n in self.states[state]]
        last, n = next((s, n) for s, before, n in grown if (s in self.score or len(s) == 1) and self._follows(before, s))
        n += 1 if last in self.score else len(last.encode())  # a character that is no piece is written in bytes
        open_ = [(self.starts[s], before if before and before[-1] + s[0] in self.inside else None, k - n) for s, before, k in grown if s in self.starts]
        reached = (*open_, ("", self.piece.get(last, last), 0))
        number = self.numbers.setdefault(reached, len(self.states))
        if number == len(self.states):
            self.states.append(reached)
        move = self.moves[state, char] = number, n
        return move

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State after ``text`` and the number of pieces it adds."""
        moves, total = self.moves, 0
        for char in text:
            state, n = moves.get((state, char)) or self._compile(state, char)
            total += n
        return state, total

    def chunk(self, chunk: str) -> int:
        """Count of a chunk with blanks in front; its map has no other entry than a word's front."""
        pieces = [chunk[i : i + PIECE] for i in range(0, len(chunk), PIECE)]
        maps = [(piece, self._guess(chunk, i * PIECE, piece)) for i, piece in enumerate(pieces)]
        while len(maps) > 1:
            maps = [self._compose(*maps[i : i + 2]) for i in range(0, len(maps), 2)]
        return maps[0][1][0][1]

    def _guess(self, chunk: str, at: int, piece: str) -> StateMap:
        entry, _ = self.run(0, chunk[max(0, at - 2 * self.longest) : at])
        return {entry: self.run(entry, piece)}

    def _compose(self, first: tuple[str, StateMap], second: tuple[str, StateMap] | None = None) -> tuple[str, StateMap]:
        if second is None:
            return first
        out: StateMap = {}
        for entry, (middle, n) in first[1].items():
            if middle not in second[1]:
                second[1][middle] = self.run(middle, second[0])
            end, m = second[1][middle]
            out[entry] = end, n + m
        return first[0] + second[0], out

    def _count_all(self, chunks: list[str]) -> Iterator[tuple[str, int]]:
        for chunk in chunks:
            if len(self.states) > STATES:
                self._forget()
            yield chunk, self.run(0, chunk)[1] if len(chunk) <= PIECE else self.chunk(chunk)

    def chunk_counts(self, text: str) -> Iterator[np.ndarray]:
        """Counts of the chunks of a text in order, in lots of about ``SLICE_CHARS`` characters."""
        text = (BLANK + text.replace(" ", BLANK)) if text else ""
        at = 0
        while at < len(text):
            end = text.find(BLANK, min(at + SLICE_CHARS, len(text)))
            while end > 0 and text[end - 1] == BLANK:
                end = text.find(BLANK, end + 1)
            end = len(text) if end < 0 else end
            chunks = _CHUNK.findall(text, at, end)
            known = self.recent.with_all(set(chunks), self._count_all)
            yield np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
            self.recent.drop(c for c in chunks if len(c) > LONGEST_KEPT)
            at = end

    def count(self, text: str | None) -> int:
        return int(sum(part.sum() for part in self.chunk_counts(text or "")))


_COMPILED: tuple[str, Transducer] | None = None


def transducer(path: str) -> Transducer:
    """The transducer of a Python worker, kept over batches."""
    global _COMPILED
    if _COMPILED is None or _COMPILED[0] != path:
        _COMPILED = path, Transducer(path)
    return _COMPILED[1]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` plus ``n_bytes``, ``n_tokens`` and ``over_limit``, by the vocabulary at ``path``, which every
    executor must have there."""

    def count(batch: pa.RecordBatch) -> dict:
        table, parts, sizes = transducer(path), [], []
        for value in batch.column(text):
            lots = [part.sum() for part in table.chunk_counts(value.as_py() or "")]
            parts.extend(lots), sizes.append(len(lots))
        scanned = np.concatenate([[0], np.cumsum(np.asarray(parts, dtype=np.int64))])  # over all lots of the batch
        return {"n_tokens": np.diff(scanned[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])}

    counted = add_columns(docs, count, "n_tokens long")
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return counted.select(*kept, n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
