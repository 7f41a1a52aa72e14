"""Words of texts and their 64-bit hashes, for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from annolytics.session import bound_batches

BATCH_ROWS = 2000  # of texts in an Arrow batch
SLICE_BYTES = 1 << 20  # texts are hashed together in slices of about this size
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: ASCII letters and digits and everything beyond ASCII make words; the rest separates them.
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in _LOWER)
#: Only ASCII white space separates words.
BLANKS = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in _LOWER)

_U = np.uint64
_BYTES = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (64-bit finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    tables: dict[int, np.ndarray] = {}

    @classmethod
    def _of(cls, base: int, n: int) -> np.ndarray:
        if len(cls.tables.get(base, ())) < n:
            factors = np.full(max(2 * n, 1024), base, dtype=np.uint64)
            factors[0] = 1
            cls.tables[base] = np.multiply.accumulate(factors)
        return cls.tables[base][:n]

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        return cls._of(_BASE, n)

    @classmethod
    def inverse(cls, n: int) -> np.ndarray:
        return cls._of(pow(_BASE, -1, 1 << 64), n)


def split_words(raw: bytes | None, table: bytes) -> list[bytes]:
    return raw.translate(table).split() if raw else []


def _hash_slice(raw: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one byte string."""
    b = np.frombuffer(raw.translate(table), dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = b != 32
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths  # place of each word once separators are left out
    letters = _BYTES[b[b != 32]]
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    letters = letters * _Powers.upto(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(letters, first) + lengths.astype(np.uint64)), starts


def hashed_words(texts: list[bytes | None], table: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, word hashes, bounds): the words of row ``first + i`` are
    ``hashes[bounds[i]:bounds[i + 1]]``. Null texts have no words."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < SLICE_BYTES):
            size += len(texts[upto] or b"") + 1
            upto += 1
        part = [t or b"" for t in texts[at:upto]]
        hashes, starts = _hash_slice(b" ".join(part), table)
        offsets = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in part], out=offsets[1:])
        yield at, hashes, np.searchsorted(starts, offsets)
        at = upto


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; a shorter text is one run as a whole, none if empty."""
    if not len(hashes):
        return hashes
    n = min(size, len(hashes))
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _U(_BASE) + hashes[i : len(hashes) - n + 1 + i])
    return out


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, in time that does not depend on the size; none if there are fewer."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _Powers.upto(n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _Powers.inverse(n)[: n - size + 1])


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after making sure that the session's Arrow batches have at most ``BATCH_ROWS`` rows and a few MB: a
    batch of texts is held by the executor and by its Python worker at once."""
    bound_batches(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: T.StructType | str) -> DataFrame:
    """Rows made from Arrow batches; ``fn`` yields dicts of column lists or arrays."""
    out = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := cols[f.name], (pa.Array, pa.ChunkedArray)) and c.type == f.type else pa.array(c, f.type) for f in arrow], schema=arrow
                )

    return small_batches(df).mapInArrow(run, out)


def grouped(batches, keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal keys from a sorted stream; a group may go over batches."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            key = tuple(c[a].item() for c in cols)
            if key != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def batches_of_groups(batches, key: str, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows and more from a stream sorted by a number ``key``; a group is never parted."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        last = held[-1].column(key)[held[-1].num_rows - 1].as_py() if held else None
        if size >= rows and k[-1] != last:
            cut = int(np.argmax(k != last))
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            batch, held, size = batch.slice(cut), [], 0
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], added: str) -> DataFrame:
    """``df`` with columns computed per Arrow batch; one that has the name of a new column is replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in names]
    out = T.StructType([*[f for f in df.schema if f.name in kept], *new])
    arrow = to_arrow_schema(new)

    def run(batches):
        for batch in batches:
            cols = fn(batch)
            made = [pa.array(cols[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *made], names=[*kept, *arrow.names])

    return small_batches(df).mapInArrow(run, out)
