"""Language identification by compression.

Each language has a raw-content dictionary for zstandard: pieces of its labelled texts, joined. A text is
compressed whole with every dictionary; the language whose dictionary gives the fewest bytes is predicted, as
its words need no letters of their own there. Before that, letters are put in lower case, and everything
else becomes one blank.

The dictionaries are fitted on a bounded sample: at most ``rows_per_language`` labelled rows, taken by the
hash of their key, and of each at most ``piece_chars`` characters from a place that the hash gives. All
dictionaries together have at most ``total_bytes``, and are broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected. The score is
the best language's share when sizes are read as code lengths (``SOFTNESS`` bytes for a factor e). Equal
sizes go to the language with more labelled texts, then to the first by name. A text is rejected when some
other language's size is larger by no more than ``margin`` of it; ``WIDE`` bytes are never narrow, as a long
text is mostly encoded by what it repeats of itself. Without any labelled text every text is
``und``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import ALNUM, add_columns

UNKNOWN = "und"
SOFTNESS = 4.0
WIDE = 16
LEAD_BYTES = 64  # of the dictionary, encoded before the text, so that a short text is not stored uncompressed
_LETTERS = bytes(32 if 48 <= c <= 57 else c for c in ALNUM)


def plain(text: str) -> bytes:
    """Letters in lower case, words parted by one blank."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def fit_dictionaries(
    labelled: DataFrame, key: Column, text: str = "text", lang: str = "lang", rows_per_language: int = 400, piece_chars: int = 1000, total_bytes: int = 32 << 20, each_bytes: int = 256 << 10
) -> dict[str, bytes]:
    """Raw dictionary per language. ``key`` chooses the sampled rows and should be unique."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # far more rows than wanted stay below the bound, and far fewer than a task can hold
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * rows_per_language / n))])
    near = rows.where((F.shiftrightunsigned("h", 11) / float(1 << 53)) < shares[F.col("lang")])
    spare = F.greatest(F.length("text") - piece_chars, F.lit(0)) + 1
    pieces = near.select("lang", "h", F.substring("text", (F.pmod(F.xxhash64("h"), spare) + 1).cast("int"), F.lit(piece_chars)).alias("piece"))
    first = pieces.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).where(F.col("n") <= rows_per_language)
    most = min(each_bytes, total_bytes // len(counts))
    parts: dict[str, list[bytes]] = {}
    for r in first.select("lang", "n", "piece").orderBy("lang", "n").toLocalIterator():
        parts.setdefault(r["lang"], []).append(plain(r["piece"]))
    by_count = sorted(parts, key=lambda k: (-counts[k], k))
    return {k: b" ".join(dict.fromkeys(parts[k]))[:most] for k in by_count}


class Compressors:
    """One compressor per language; made once in a Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int):
        import zstandard as z

        self.names = list(dictionaries)
        self.each = []
        for content in dictionaries.values():
            content = content.ljust(LEAD_BYTES)
            table = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters.from_level(
                level, dict_size=len(content), source_size=4096, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            table.precompute_compress(compression_params=params)
            compress = z.ZstdCompressor(dict_data=table, compression_params=params).compress
            lead = content[-LEAD_BYTES:] + b" "
            self.each.append((compress, lead, len(compress(lead + b" "))))

    def sizes(self, data: bytes) -> np.ndarray:
        """Bytes that the text adds, with each dictionary."""
        data += b" "
        return np.fromiter((len(compress(lead + data)) - alone for compress, lead, alone in self.each), np.int64, len(self.each))


_MADE: dict[str, Compressors] = {}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = 6, margin: float = 0.01) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced."""
    shared, mark = docs.sparkSession.sparkContext.broadcast(dictionaries), uuid.uuid4().hex

    def predict(batch: pa.RecordBatch) -> dict:
        made = _MADE.get(mark)
        if made is None:
            _MADE.clear()
            made = _MADE[mark] = Compressors(shared.value, level)
        langs, scores, rejected = [], [], []
        for t in batch.column(text).to_pylist():
            if not made.names or t is None or not any(map(str.isalpha, t)):
                langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                continue
            size = made.sizes(plain(t))
            best = int(size.argmin())
            others = np.delete(size, best)
            langs.append(made.names[best])
            scores.append(float(1 / np.exp((size[best] - size) / SOFTNESS).sum()))
            rejected.append(bool(len(others)) and bool(others.min() - size[best] <= min(margin * others.min(), WIDE - 1)))
        return {"lang_pred": langs, "score": scores, "rejected": rejected}

    return add_columns(docs, predict, "lang_pred string, score double, rejected boolean")
