"""Text → vector stage with a pluggable batch function; the default needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import bound_batches

SLICE_ROWS = 1024


def hashed_words(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic bag of words: each lower-cased word adds 1 to the slot given by its md5."""
    words = re.compile(r"\w+")
    known: dict[str, int] = {}  # per Python worker

    def slot(word: str) -> int:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
        return known[word]

    def embed_batch(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            slots = [slot(w) for w in words.findall(text.lower())] if text else []
            if slots:
                out[i] = np.bincount(slots, minlength=dim)
        return out

    return embed_batch


def embed(
    df: DataFrame, text: str = "text", fn: Callable[[list[str]], np.ndarray] | None = None,
    dim: int = 64, batch: int = 32, name: str = "embedding",
) -> DataFrame:
    """Adds ``name``; ``fn`` is called on at most ``batch`` texts at a time and must return ``dim`` columns.

    A Python worker holds a few MB of texts and the vectors of ``SLICE_ROWS`` rows at a time.
    """
    call = fn or hashed_words(dim)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def vectors(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dim))
        for at in range(0, len(texts), batch):
            part = np.asarray(call(texts[at:at + batch]), dtype="float64")
            if part.shape != (len(texts[at:at + batch]), dim):
                raise ValueError(f"embedding function returned shape {part.shape}, expected dimension {dim}")
            out[at:at + batch] = part
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = -(-SLICE_ROWS // batch) * batch  # so that slices don't part what fn gets together
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                made = vectors([t or "" for t in part.column(text).to_pylist()])
                bounds = np.arange(0, made.size + 1, dim, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, name])

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
