"""Documents → chunks. Every strategy keeps the given columns and adds one row per chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunks as C
from ..functions.text import py_strip
from .embedding import hashed_words
from .ordering import once

CHUNK_COLUMNS = ("chunk_id", "text", "start_char", "end_char", "sentence_count", "avg_similarity", "chunking_strategy")
KINDS = {"chunk_id": "int", "text": "string", "start_char": "int", "end_char": "int", "sentence_count": "int",
         "avg_similarity": "double", "chunking_strategy": "string"}


def _rows(df: DataFrame, keep: Sequence[str], chunks: Column, strategy: str) -> DataFrame:
    exploded = df.select(*keep, F.explode(chunks).alias("c"))
    have = exploded.schema["c"].dataType.fieldNames()
    return exploded.select(*keep, *[
        (F.lit(strategy) if c == "chunking_strategy" else F.col(f"c.{c}") if c in have else F.lit(None)).cast(KINDS[c]).alias(c)
        for c in CHUNK_COLUMNS
    ])


def chunk_fixed(df: DataFrame, keep: Sequence[str], size: int = 512, overlap: int = 50, text: str = "text") -> DataFrame:
    return _rows(df, keep, C.fixed_chunks(text, size, overlap), "fixed_size")


def chunk_sentences(
    df: DataFrame, keep: Sequence[str], size: int = 512, overlap: int = 1,
    separators: Sequence[str] = C.SENTENCE_SEPARATORS, text: str = "text",
) -> DataFrame:
    split = once(df, __s=C.split_sentences(text, separators))
    sized = once(split, __l=F.transform("__s", lambda x: F.length(x)))
    return _rows(sized, keep, C.pack_sentences("__s", "__l", size, overlap), "sentence")


def chunk_recursive(
    df: DataFrame, keep: Sequence[str], size: int = 512, overlap: int = 50,
    separators: Sequence[str] = C.RECURSIVE_SEPARATORS, text: str = "text",
) -> DataFrame:
    pieces = F.transform(
        C.recursive_chunks(text, size, overlap, separators), lambda p, i: F.struct(i.alias("chunk_id"), p.alias("text"))
    )
    return _rows(df, keep, pieces, "recursive")


def in_slices(lengths: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with at most ``most`` characters in all, or one text that is longer."""
    first = used = 0
    for i, n in enumerate(lengths):
        if i > first and used + n > most:
            yield first, i
            first, used = i, 0
        used += n
    if first < len(lengths):
        yield first, len(lengths)


class SemanticFold:
    """Cuts a stream of sentences: where neighbours are dissimilar or the chunk would grow too long, once it is
    long enough. It keeps the open chunk and the last sentence's vector, so a document may be of any length."""

    def __init__(self, threshold: float, min_size: int, max_size: int):
        self.threshold, self.min_size, self.max_size = threshold, min_size, max_size
        self.last: np.ndarray | None = None
        self._open()

    def _open(self) -> None:
        self.chunk, self.parts, self.used, self.total, self.joints = 0, [], 0, 0.0, 0

    def similarities(self, vectors: np.ndarray) -> list[float]:
        """Cosine of each sentence and the one before it, NaN where there is none or a vector is zero."""
        rows = vectors if self.last is None else np.vstack([self.last, vectors])
        self.last = rows[-1:]
        norms = np.linalg.norm(rows, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            found = np.einsum("ij,ij->i", rows[:-1], rows[1:]) / (norms[:-1] * norms[1:])
        return [float("nan")] * (len(vectors) - len(found)) + found.tolist()

    def take(self, place: int, count: int, sentence: str, similarity: float) -> Iterator[tuple[int | None, str, float | None]]:
        """(chunk number, text, mean similarity) of the chunks that end with or before this sentence."""
        if place == 0:
            self._open()
        else:
            self.total += similarity
            self.joints += 1
            if (similarity < self.threshold or self.used + len(sentence) > self.max_size) and self.used >= self.min_size:
                mean = self.total / self.joints  # the cut takes part
                yield self.chunk, "".join(self.parts), None if np.isnan(mean) else mean
                self.chunk, self.parts, self.used, self.total, self.joints = self.chunk + 1, [], 0, 0.0, 0
        self.parts.append(sentence)
        self.used += len(sentence)
        if place == count - 1:
            yield None if count == 1 else self.chunk, "".join(self.parts), None


def chunk_semantic(
    df: DataFrame, keep: Sequence[str], threshold: float = 0.5, min_size: int = 100, max_size: int = 1000,
    embed: Callable[[list[str]], np.ndarray] | None = None, text: str = "text", embed_chars: int = 1 << 20,
) -> DataFrame:
    """Cut between dissimilar neighbouring sentences. ``embed`` maps a list of sentences to a matrix; it gets at
    most ``embed_chars`` characters at a time, or one longer sentence.

    Sentences are rows that pass once, in order, without a shuffle. Mean similarity is given for all chunks but
    the last; a text of one sentence is one chunk without id; a null text or one without sentences has no chunk.
    """
    fn = embed or hashed_words(64)
    split = once(df.select(*keep, F.col(text).alias("__t")), __s=C.split_sentences("__t"))
    whole = F.when(F.size("__s") == 1, F.array("__t")).otherwise(F.col("__s"))
    sentences = split.select(*keep, F.size("__s").alias("__n"), F.posexplode(whole).alias("__i", "__x"))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("chunk_id", T.IntegerType()),
                           T.StructField("text", T.StringType()), T.StructField("avg_similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = SemanticFold(threshold, min_size, max_size)
        for b in batches:
            texts, places, counts = (b.column(c).to_pylist() for c in ("__x", "__i", "__n"))
            rows, out = [], []
            for first, end in in_slices([len(x) for x in texts], embed_chars):
                near = fold.similarities(np.asarray(fn(texts[first:end]), dtype="float64"))
                for i in range(first, end):
                    for chunk in fold.take(places[i], counts[i], texts[i], near[i - first]):
                        rows.append(i)
                        out.append(chunk)
            if rows:
                kept = [b.column(j).take(pa.array(rows)) for j in range(len(keep))]
                ids, parts, means = zip(*out)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.int32()), pa.array(parts, pa.string()), pa.array(means, pa.float64())], names=schema.names)

    made = sentences.mapInArrow(run, schema)
    rest = {c: F.lit("semantic" if c == "chunking_strategy" else None).cast(KINDS[c]) for c in CHUNK_COLUMNS if c not in made.columns}
    return made.withColumns(rest).select(*keep, *CHUNK_COLUMNS)


def chunk_hybrid(parts: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Union of several strategies' chunks with strategy index and weights that sum to 1."""
    if weights is None:
        shares = [1.0 / len(parts)] * len(parts)
    else:
        if len(weights) != len(parts):
            raise ValueError("number of weights and strategies differ")
        shares = [w / sum(weights) for w in weights]
    out = None
    for i, (part, share) in enumerate(zip(parts, shares)):
        named = part.withColumns({
            "chunking_strategy": F.concat(F.lit("hybrid_"), F.coalesce("chunking_strategy", F.lit("unknown"))),
            "hybrid_strategy_index": F.lit(i), "hybrid_weight": F.lit(share),
        })
        out = named if out is None else out.unionByName(named)
    return out


def needs_ocr(df: DataFrame, text: str = "content", pages: str = "page_count", min_len: int = 50) -> DataFrame:
    """Flag texts that are too short, in all or per page, to come from a document with a text layer."""
    t = F.coalesce(F.col(text), F.lit(""))
    per_page = F.when(F.col(pages) > 0, F.length(t) / F.col(pages)).otherwise(0.0)
    return df.withColumn("needs_ocr", (F.length(py_strip(t)) < min_len) | F.coalesce(per_page < min_len, F.lit(True)))


# Markers in assembled documents.
PAGE_MARK, TABLE_MARK, TABLE_SECTION = "[页码 %d]", "[表格 %d - 页码 %d]", "\n\n=== 提取的表格 ===\n\n"


def assemble_document(
    pages: DataFrame, tables: DataFrame | None = None, doc: str = "doc_id", page: str = "page", text: str = "text"
) -> DataFrame:
    """Pages in order under page marks, joined by a blank line, blank pages dropped; tables follow under their
    own mark. ``tables`` has (doc, page, table_no, rows array<array<string>>). The result is one row per
    document, as large as the document is."""
    filled = F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S")
    marked = F.struct(F.col(page).alias("p"), F.concat(F.format_string(PAGE_MARK, F.col(page)), F.lit("\n"), F.col(text)).alias("t"))
    # blank pages count, but are not collected
    gathered = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("page_count"), F.array_sort(F.collect_list(F.when(filled, marked))).alias("ps"))
    out = gathered.withColumn("content", F.array_join(F.transform("ps", lambda x: x["t"]), "\n\n")).drop("ps")
    if tables is None:
        return out
    line = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    rows = F.col("rows")
    head = line(F.get(rows, F.lit(0)))
    lines = F.concat(
        F.array(F.format_string(TABLE_MARK, F.col("table_no"), F.col(page))),
        F.when(F.size(F.get(rows, F.lit(0))) > 0, F.array(head, F.repeat(F.lit("-"), F.length(head)))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.size(r) > 0), line),
    )
    texts = tables.where(F.size(rows) > 0).select(doc, F.col(page).alias("p"), "table_no", F.array_join(lines, "\n").alias("t"))
    joined = texts.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("p", "table_no", "t"))).alias("ts"), F.count(F.lit(1)).alias("table_count"))
    extra = F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n")
    merged = F.concat_ws("\n\n", F.nullif(F.col("content"), F.lit("")), F.when(extra != "", F.concat(F.lit(TABLE_SECTION), extra)))
    return out.join(joined, doc, "left").select(
        doc, "page_count", F.coalesce("table_count", F.lit(0)).alias("table_count"), merged.alias("content")
    )
