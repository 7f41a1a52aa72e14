"""One large JSON array read by many tasks, also when the file is a single line.

The text reader parts a file into byte ranges at any separator of lines; with a comma as separator a range holds
whole pieces between commas. Where a comma parts two elements of the array, and where it stands inside an element
or a string, depends on what comes before. That is found as in a parallel scan of an automaton: each range tells,
for both cases of starting inside and outside a string, whether it ends inside one and by how much the brackets
outside strings change the depth. These few numbers are composed along the ranges, which gives each range its
state at the start. A second pass then cuts elements at the commas of depth one; only the elements that go over
the border of a range are put together afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\.", re.S)


def _change(text: str) -> tuple[int, int, int]:
    """(1 if the number of quotes is odd, change of depth if the text starts outside a string, and inside one)."""
    parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
    depth = [0, 0]
    for i, part in enumerate(parts):
        depth[i % 2] += part.count("[") + part.count("{") - part.count("]") - part.count("}")
    return (len(parts) - 1) % 2, depth[0], depth[1]


def _ranges(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, list[str]]]:
    """Pieces of consecutive rows of the same byte range, with the range and its columns ``more``."""
    for batch in batches:
        keys = list(zip(*[batch[c].to_pylist() for c in ("path", "start", *more)]))
        pieces = batch["value"].to_pylist()
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                yield keys[at], pieces[at:i]
                at = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[int, int, int]] = {}
    for key, pieces in _ranges(batches):
        odd, outside, inside = held.get(key, (0, 0, 0))
        more = _change(",".join(pieces))
        first, second = (more[1], more[2]) if not odd else (more[2], more[1])
        held[key] = odd ^ more[0], outside + first, inside + second
    rows = [(*key, *value) for key, value in held.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "start", "odd", "outside", "inside"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of each range, and parts of those that go over its borders: ``opens`` where an element begins and
    ``closes`` where it ends."""
    names = ["path", "start", "part", "value", "opens", "closes", "first", "last"]
    state: dict = {}

    def ended(out: list, closes: bool) -> None:
        text = ",".join(state["held"])
        first, last = state["from"] == 0, closes and state["depth"] == 0
        out.append((*state["key"], state["part"], text, state["opens"], closes, first, last))
        state.update(held=[], opens=True, part=state["part"] + 1, **{"from": state["depth"]})

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def close(out: list) -> None:  # the end of a range; the state there may be that of the end of the file
        if state and state["held"]:
            between = not state["quoted"] and state["depth"] <= 1
            ended(out, between)

    for (path, start, quoted, depth), pieces in _ranges(batches, "quoted", "depth"):
        out: list = []
        if state.get("key") != (path, start):
            close(out)
            begins = not quoted and depth <= 1
            state = {"key": (path, start), "quoted": quoted, "depth": depth, "held": [], "opens": begins, "part": 0, "from": depth}
        for piece in pieces:
            if state["held"] and not state["quoted"] and state["depth"] == 1:  # the comma before this piece
                ended(out, True)
            odd, outside, inside = _change(piece)
            state["depth"] += inside if state["quoted"] else outside
            state["quoted"] ^= odd
            state["held"].append(piece)
        if out:
            yield batch_of(out)
    out = []
    close(out)
    if out:
        yield batch_of(out)


def read_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``value``, the text of each element of the JSON arrays in the files of ``path``. A file whose
    brackets or strings do not end gives none. An element must fit a row, a file need not."""
    lines = spark.read.option("lineSep", ",").text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    ranges = pieces.mapInArrow(_summaries, "path string, start long, odd long, outside long, inside long")
    # a file's ranges are few rows: one for each maxPartitionBytes
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    quoted = ranges.withColumn("quoted", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    moved = quoted.withColumn("change", F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside")))
    entry = moved.withColumns({
        "depth": F.coalesce(F.sum("change").over(earlier), F.lit(0)), "balance": F.sum("change").over(whole), "quotes": F.sum("odd").over(whole) % 2,
    }).where("balance = 0 AND quotes = 0").select("path", "start", "quoted", "depth")
    placed = pieces.join(F.broadcast(entry), ["path", "start"])
    parts = placed.mapInArrow(_elements, "path string, start long, part long, value string, opens boolean, closes boolean, first boolean, last boolean")
    alone = parts.where("opens AND closes").select("path", "value", "first", "last")
    # at most two parts of a range are left
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("path").orderBy("start", "part"))
    over = parts.where("NOT (opens AND closes)").withColumn("n", number).groupBy("path", "n").agg(
        F.array_sort(F.collect_list(F.struct("start", "part", "value"))).alias("p"), F.max("first").alias("first"), F.max("last").alias("last")
    )
    joined = over.select("path", F.array_join(F.col("p.value"), ",").alias("value"), "first", "last")
    text = F.when(F.col("first"), F.regexp_replace("value", r"^\s*\[", "")).otherwise(F.col("value"))
    text = F.when(F.col("last"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return alone.unionByName(joined).select("path", text.alias("value"))
