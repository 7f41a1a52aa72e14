"""Spelling variants: words of a vocabulary that one inserted, deleted or replaced character tells apart.

Two such words agree before the first place where they differ and again behind it. So for a window of places
that holds the first difference, both have the same beginning before the window and the same end behind it.
Windows part the places of a word into a front and a back half; words with equal rest are a group, dealt by
that rest. A group of more than ``GROUP_ROWS`` words is parted further: its window is halved, which makes the
rest longer, until the groups are small. A window of one place leaves two characters free at most, so a group
is bounded by the alphabet in the end, and no frequent beginning stays with one task.

Within a group the words are a sorted list. Each word scans it by dynamic programming: of the edit matrix
between the word and a listed one only the band of one place to both sides is kept, one row per character of
the listed word. A next word reuses the rows of the prefix that it shares with the one before, and where a
row has no value of one or less, the scan skips all words that share the prefix up to there. The scans of all
words of a block go on side by side in arrays.

Words have distinct places of first difference, so a pair is found in exactly one window and counts add up.

Defined results: null and empty texts have no words. A word of any length is compared whole. Of near words with
equal counts the first by code points is the form. Repeated rows count again; rows with a null id count, too.
An empty table or vocabulary gives no rows. Only the columns named by parameters are read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.session import materialize

from .words import map_batches

GROUP_ROWS = 5000
BLOCK_ROWS = 1 << 16
_FAR = 2  # of a matrix only 0, 1 and more matter
LETTERS = "[A-Za-zÀ-ÿ]"


def word_runs(docs: DataFrame, min_length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and each maximal run of letters of at least ``min_length``, A-Z in lower case."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(f"({LETTERS}{{{min_length},}})"))).alias("word"))


def vocabulary(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """``word`` and ``n``, how often it occurs."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _tail() -> Column:
    return F.greatest(F.col("size") - F.col("high"), F.lit(0))


def _rest() -> Column:
    """What two near words of a window have in common: the beginning before it and the end behind it."""
    return F.concat(F.substring("word", F.lit(1), F.col("low")), F.right("word", _tail()))


def _windows(vocab: DataFrame) -> DataFrame:
    """Each word in the pairs of words of its own length or one more, and of one less: ``size`` is the length of
    the shorter word, the first difference is in [low, high)."""
    windows = []
    for size in (F.length("word"), F.length("word") - 1):
        half = F.floor(size / 2).cast("int")
        windows += [F.struct(size.alias("size"), F.lit(0).alias("low"), half.alias("high")), F.struct(size.alias("size"), half.alias("low"), (size + 1).alias("high"))]
    rows = vocab.select("word", "n", F.explode(F.array(*windows)).alias("w")).select("word", "n", "w.*")
    return rows.where("size > 0 AND low < high")


def _small_groups(vocab: DataFrame, group_rows: int) -> DataFrame:
    """``_windows``, with those of large groups halved."""
    key = ["size", "low", "high", "rest"]
    rows, done = _windows(vocab), []
    while True:
        keyed = rows.withColumn("rest", _rest())
        large = materialize(keyed.groupBy(*key).count().where((F.col("count") > group_rows) & (F.col("high") - F.col("low") > 1)).select(*key, F.lit(True).alias("large")))
        if large.isEmpty():
            done.append(rows)
            break
        marked = keyed.join(F.broadcast(large), key, "left")  # each row of it stands for more than group_rows words
        done.append(marked.where("large IS NULL").select(*rows.columns))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
        rows = materialize(marked.where("large").select("word", "n", "size", F.explode(halves).alias("w")).select("word", "n", "size", "w.*"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _shared(chars: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string with the one before; 0 for the first."""
    out = np.zeros(len(first), dtype=np.int64)
    at = np.arange(1, len(first))
    most = np.minimum(length[1:], length[:-1])
    depth = 0
    while len(at := at[most[at - 1] > depth]):
        at = at[chars[first[at] + depth] == chars[first[at - 1] + depth]]
        depth += 1
        out[at] = depth
    return out


def _next_smaller(shared: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the end."""
    n = len(shared)
    value = np.append(shared, np.iinfo(np.int64).min)
    after = np.arange(1, n + 1)
    open_ = np.arange(n)
    while len(open_ := open_[value[after[open_]] >= shared[open_]]):
        after[open_] = after[after[open_]]
    return after


class SortedLists:
    """Sorted lists of strings in one block, and the scans of their words."""

    def __init__(self, texts: list[str], size: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.texts, self.size, self.low = texts, size, low
        self.tail = np.maximum(size - high, 0)
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.length) - self.length
        self.rest = low + self.tail
        self.shared = _shared(self.chars, self.first, self.length)
        same = (np.diff(size) == 0) & (np.diff(low) == 0) & (np.diff(high) == 0) & (self.shared[1:] >= self.rest[1:])
        self.starts = np.flatnonzero(np.concatenate([[True], ~same]))
        self.room = high - low  # places of the window

    def word(self, row: int) -> str:
        text, low, rest = self.texts[row], int(self.low[row]), int(self.rest[row])
        return text[:low] + text[rest:] + text[low:rest]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of rows (word, listed word) with one edit; the word is the shorter one or as long."""
        n = len(self.texts)
        bounds = np.append(self.starts, n)
        group = np.repeat(np.arange(len(self.starts)), np.diff(bounds))
        end, inner = bounds[group + 1], self.length - self.rest  # inner: characters behind the rest
        shared = self.shared - self.rest
        shared[self.starts] = -1
        after = _next_smaller(shared)
        word = np.flatnonzero((self.length == self.size) & (end - bounds[group] > 1))
        inside = self.first + self.rest  # where the characters behind the rest begin
        # one row of the band for each character of a listed word, at most one more than the word has
        base = np.cumsum(inner[word] + 2) - inner[word] - 2
        rows = np.full((int((inner[word] + 2).sum()), 3), _FAR, dtype=np.int8)
        rows[base, 1], rows[base, 2] = 0, 1
        listed, depth, found = bounds[group[word]], np.zeros(len(word), dtype=np.int64), []
        while len(word):
            whole = depth == inner[listed]
            at = np.flatnonzero(whole)
            if len(at):
                band = 1 + inner[word[at]] - depth[at]  # the column where the word ends
                hit = at[(rows[base[at] + depth[at], band] == 1)]
                found.append((word[hit], listed[hit]))
            dead = whole.copy()
            at = np.flatnonzero(~whole)
            w, l, t = word[at], listed[at], depth[at]
            new = self._row(rows[base[at] + t], self.chars[inside[l] + t], inside[w], inner[w], t)
            alive = new.min(axis=1) < _FAR
            rows[base[at[alive]] + t[alive] + 1] = new[alive]
            depth[at[alive]] += 1
            dead[at[~alive]] = True
            # the next word that shares no dead prefix; behind a whole word it is just the next one
            jump = np.flatnonzero(dead)
            to = listed[jump] + 1
            skip = np.arange(len(jump))
            while len(skip := skip[(to[skip] < end[word[jump[skip]]]) & ~whole[jump[skip]] & (shared[np.minimum(to[skip], n - 1)] > depth[jump[skip]])]):
                to[skip] = after[to[skip]]
            listed[jump] = to
            going = to < end[word[jump]]
            depth[jump[going]] = shared[to[going]]
            keep = np.ones(len(word), dtype=bool)
            keep[jump[~going]] = False
            word, listed, depth, base = word[keep], listed[keep], depth[keep], base[keep]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        a, b = (np.concatenate(x) for x in zip(*found))
        return self._in_window(a, b)

    def _row(self, old: np.ndarray, char: np.ndarray, inside: np.ndarray, inner: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Next row of the band: columns ``depth``, ``depth + 1`` and ``depth + 2`` of the word."""
        new = np.empty_like(old)
        for k in range(3):
            column = depth + k  # characters of the word
            can = (column >= 1) & (column <= inner)
            here = self.chars[inside + np.where(can, column - 1, 0) * (inner > 0)] if len(self.chars) else char
            best = np.where(can, old[:, k] + (here != char), _FAR)
            if k < 2:
                best = np.minimum(best, old[:, k + 1] + 1)
            if k:
                best = np.minimum(best, new[:, k - 1] + 1)
            new[:, k] = np.where(column <= inner, np.minimum(best, _FAR), _FAR)
        return new

    def _in_window(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose first difference lies in the window: at its end another window has them."""
        first, second = self.first[a] + self.rest[a], self.first[b] + self.rest[b]
        room = np.minimum(self.room[a], np.minimum(self.length[a] - self.rest[a], self.length[b] - self.rest[b]))
        depth, open_ = 0, np.arange(len(a))
        common = np.zeros(len(a), dtype=np.int64)
        while len(open_ := open_[room[open_] > depth]):
            open_ = open_[self.chars[first[open_] + depth] == self.chars[second[open_] + depth]]
            depth += 1
            common[open_] = depth
        inside = common < self.room[a]
        return a[inside], b[inside]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[SortedLists, np.ndarray]]:
    """Blocks of about ``rows`` rows and more with the counts of their words; a group is never parted."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[SortedLists, np.ndarray]:
        table = pa.Table.from_batches(held)
        return SortedLists(table["text"].to_pylist(), *(table[c].to_numpy() for c in ("size", "low", "high"))), table["n"].to_numpy()

    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= rows:
            last = np.logical_and.reduce([pc.equal(batch[c], batch[c][-1]).to_numpy(zero_copy_only=False) for c in ("size", "low", "high", "rest")])
            cut = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0  # where the last group begins
            if cut:
                held.append(batch.slice(0, cut))
                yield block()
                held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield block()


def near_words(vocab: DataFrame, factor: int = 10, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per word of ``vocab`` (``word``, ``n``) that has near ones: ``n_near`` of them, and of those with at least
    ``factor`` times its count the one with the largest: ``form``, ``form_n``."""
    rows = _small_groups(vocab, group_rows)
    rest = _rest()
    middle = F.substring("word", F.col("low") + 1, F.length("word") - F.col("low") - _tail())
    lists = rows.select("size", "low", "high", rest.alias("rest"), F.concat(rest, middle).alias("text"), "n")
    dealt = lists.repartition("size", "low", "high", "rest").sortWithinPartitions("size", "low", "high", "text")

    def scan(batches):
        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
        for block, n in _blocks(batches, block_rows):
            a, b = block.near()
            longer = block.length[b] > block.size[b]
            a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
            near = np.bincount(a, minlength=len(n))
            some = np.flatnonzero(near)
            strong = n[b] >= factor * n[a]
            counts = [(block.word(i), int(near[i]), None, None) for i in some.tolist()]
            forms = [(block.word(i), 0, block.word(j), int(n[j])) for i, j in zip(a[strong].tolist(), b[strong].tolist())]
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*counts, *forms), schema)], schema=schema)

    found = dealt.mapInArrow(scan, "word string, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, its last form; each round doubles the steps. A form has a larger count, so there are
    no circles, and no more rounds than the logarithm of a logarithm of the largest count."""
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(vocab: DataFrame, factor: int = 10, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``vocab`` (``word``, ``n``; distinct words) plus ``form``, ``root``, ``n_near`` and ``form_n``; ``factor`` is
    above 1, so that forms lead to ever larger counts."""
    if factor <= 1:
        raise ValueError("with a factor of one or less, forms can lead back to a word")
    vocab = materialize(vocab.select("word", "n"))
    near = materialize(near_words(vocab, factor, group_rows))
    roots = _roots(near.where("form IS NOT NULL"))
    return vocab.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )
