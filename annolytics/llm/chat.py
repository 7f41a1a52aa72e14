"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a text of lines; some lines open with a speaker marker, many do not. The hidden state of a
line is (role, whether the line opens a turn). What is observed of a line is the kind of its marker and a few
features of its text. Transition and emission probabilities are counted on labelled conversations, with one
added to every count; the path with the highest probability (Viterbi) gives the roles, and lines are joined to
turns where the path opens one.

A transcript comes in parts (rows with an order), and its path is found in blocks of ``BLOCK`` parts, so that
one transcript may be longer than a task can hold. Of a block one small matrix is kept: the best log
probability from each state before it to each state at its end. Along a transcript these matrices (300 bytes a
block) give the best state at each block's end; each block is then solved between the two states it joins.

Defined results: a null text, and lines of white space alone, are left out; rows that repeat transcript, part
and text count once; parts with the same number are ordered by text; a transcript's first line opens a turn;
labelled parts whose role is none of the three are no examples; equal probabilities go to the first state; a transcript of no lines has no turns.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolytics.session import materialize

from .words import grouped, map_batches

ROLES = ("system", "user", "assistant")
STATES = [(r, o) for r in range(len(ROLES)) for o in (1, 0)]  # role, opens a turn
BLOCK = 256  # parts
#: Speaker markers at the start of a line, by the role they most often stand for. Fixed values.
MARKERS = (
    ("system", "instructions", "context"),
    ("user", "human", "question", "q", "me", "customer"),
    ("assistant", "ai", "bot", "answer", "a", "agent"),
)
_MARKER = re.compile(r"^\s*(?:[#>*\-\[<(|]*\s*)(" + "|".join(sorted((m for group in MARKERS for m in group), key=len, reverse=True)) + r")\s*(?:[\]>)|*]*)\s*[:：>\-]\s*", re.I)
_KIND = {m: i + 1 for i, group in enumerate(MARKERS) for m in group}
MARKER_KINDS = len(MARKERS) + 1  # 0: none
LENGTHS = (40, 160, 640)


def observe(line: str, apart: bool) -> tuple[int, int]:
    """Marker kind and feature number of a line; ``apart``: after a blank line or at the start of a part."""
    found = _MARKER.match(line)
    body = line[found.end() :].strip() if found else line.strip()
    size = sum(len(body) > n for n in LENGTHS)
    return _KIND[found[1].lower()] if found else 0, ((size * 2 + body.endswith("?")) * 2 + body.endswith((".", "!"))) * 2 + apart


N_FEATURES = (len(LENGTHS) + 1) * 8


def strip_marker(line: str) -> str:
    found = _MARKER.match(line)
    return line[found.end() :] if found else line


class Model:
    """Log probabilities, from counts with one added."""

    def __init__(self, start: np.ndarray, move: np.ndarray, marker: np.ndarray, feature: np.ndarray):
        self.start = np.log((start + 1) / (start + 1).sum())
        self.move = np.log((move + 1) / (move + 1).sum(axis=1, keepdims=True))
        self.marker = np.log((marker + 1) / (marker + 1).sum(axis=1, keepdims=True))
        self.feature = np.log((feature + 1) / (feature + 1).sum(axis=1, keepdims=True))
        closed = [i for i, (_, o) in enumerate(STATES) if not o]
        for i, (role, _) in enumerate(STATES):
            for j in closed:  # a line that opens no turn keeps the role
                if STATES[j][0] != role:
                    self.move[i, j] = -np.inf
        self.start[closed] = -np.inf

    def emission(self, marker: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return self.marker[:, marker].T + self.feature[:, feature].T


def fit(lines: DataFrame) -> Model:
    """Model from labelled lines: ``role``, ``opens``, ``before`` (state before, null at the start), ``marker``,
    ``feature``. Only counts reach the driver, one for each combination."""
    n = len(STATES)
    start, move, marker, feature = np.zeros(n), np.zeros((n, n)), np.zeros((n, MARKER_KINDS)), np.zeros((n, N_FEATURES))
    for r in lines.groupBy("state", "before", "marker", "feature").count().collect():
        if r["before"] is None:
            start[r["state"]] += r["count"]
        else:
            move[r["before"], r["state"]] += r["count"]
        marker[r["state"], r["marker"]] += r["count"]
        feature[r["state"], r["feature"]] += r["count"]
    return Model(start, move, marker, feature)


def block_matrix(model: Model, emission: np.ndarray, first: bool) -> np.ndarray:
    """Best log probability from each state before a block to each state at its end."""
    step = np.tile(model.start, (len(STATES), 1)) if first else model.move
    best = step + emission[0]
    for e in emission[1:]:
        best = (best[:, :, None] + model.move[None]).max(axis=1) + e
    return best


def block_path(model: Model, emission: np.ndarray, before: int | None, after: int) -> list[int]:
    """Best states of a block between the state before it (None: the start) and its last state."""
    best = (model.start if before is None else model.move[before]) + emission[0]
    back = []
    for e in emission[1:]:
        ways = best[:, None] + model.move
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + e
    path = [after]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def join_paths(matrices: list[np.ndarray], after: int | None) -> list[int]:
    """Best state at the end of each block; ``after`` is the last, or the best one if None."""
    best, back = matrices[0][0], []
    for m in matrices[1:]:
        ways = best[:, None] + m
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    ends = [int(best.argmax()) if after is None else after]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    return ends[::-1]


def part_lines(text: str | None, borders: bool = True) -> list[tuple[str, int, int]]:
    """Lines of a part with marker kind and feature number; ``borders``: a part's start counts as a blank line."""
    out, blank = [], borders
    for line in (text or "").split("\n"):
        if line.strip():
            out.append((line, *observe(line, blank)))
        blank = not line.strip()
    return out


def fit_on(parts: DataFrame, role: str = "role", borders: bool = True) -> Model:
    """Model from labelled parts (``transcript``, ``part``, ``text`` and the column ``role``), one turn each. The
    state before a part's first line is that of the last line before it: where the part before has one line, it
    opens a turn, else it goes on with one. Without ``borders`` the start of a part is not observed."""
    numbers = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])
    known = parts.select("transcript", "part", F.col("text").cast("string").alias("text"), numbers[F.col(role)].alias("role")).where("role IS NOT NULL").distinct()
    # the part before is found by its number; where that is missing the part counts as a start
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]")))
    ends = F.struct(F.col("role").alias("role"), (lines == 1).cast("int").alias("opens"))
    before = known.where(lines > 0).select("transcript", (F.col("part") + 1).alias("part"), "text", ends.alias("last"))
    before = before.groupBy("transcript", "part").agg(F.max_by("last", "text").alias("last"))
    rows = known.join(before, ["transcript", "part"], "left")

    def states(batch: pa.RecordBatch):
        out = {"state": [], "before": [], "marker": [], "feature": []}
        for text, role_no, last in zip(*(batch.column(c).to_pylist() for c in ("text", "role", "last"))):
            state = None if last is None else STATES.index((last["role"], last["opens"]))
            for i, (_, marker, feature) in enumerate(part_lines(text, borders)):
                now = STATES.index((role_no, int(i == 0)))
                for name, value in zip(out, (now, state, marker, feature)):
                    out[name].append(value)
                state = now
        yield out

    return fit(map_batches(rows, states, "state int, before int, marker int, feature int"))


def _ordered(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition("transcript", "block").sortWithinPartitions("transcript", "block", *more)


def _observed(rows: pa.Table, borders: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    lines = [x for t in rows.column("text").to_pylist() for x in part_lines(t, borders)]
    return [x[0] for x in lines], np.array([x[1] for x in lines], dtype=np.int64), np.array([x[2] for x in lines], dtype=np.int64)


def parse(parts: DataFrame, model: Model, transcript: str = "transcript", part: str = "part", text: str = "text", borders: bool = True) -> DataFrame:
    """Recovered turns: ``transcript``, ``turn`` from 0, ``role``, ``text`` without the marker, ``rendered``."""
    rows = parts.select(F.col(transcript).alias("transcript"), F.col(part).cast("long").alias("part"), F.col(text).cast("string").alias("text"))
    rows = rows.where("transcript IS NOT NULL AND part IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\S")).distinct()
    rows = rows.withColumn("block", F.floor(F.col("part") / BLOCK).cast("long"))
    kind = rows.schema["transcript"].dataType.simpleString()

    def matrices(batches):
        for (name, block), group in grouped(batches, ["transcript", "block"]):
            _, marker, feature = _observed(group, borders)
            if len(marker):
                e = model.emission(marker, feature)
                both = [block_matrix(model, e, first).tobytes() for first in (True, False)]
                yield pa.RecordBatch.from_arrays([group.column("transcript").chunk(0)[:1], pa.array([block], pa.int64()), *(pa.array([b], pa.binary()) for b in both)], names=["transcript", "block", "opening", "inner"])

    def ends(batches):
        for (name,), group in grouped(batches, ["transcript"]):
            n = len(STATES)
            each = [np.frombuffer(b, dtype=np.float64).reshape(n, n) for b in group.column("inner").to_pylist()]
            each[0] = np.frombuffer(group.column("opening")[0].as_py(), dtype=np.float64).reshape(n, n)
            last = join_paths(each, None)
            yield pa.RecordBatch.from_arrays(
                [group.column("transcript").combine_chunks(), group.column("block").combine_chunks(), pa.array([None, *last[:-1]], pa.int32()), pa.array(last, pa.int32())], names=["transcript", "block", "before", "after"]
            )

    def pieces(batches):
        for (name, block), group in grouped(batches, ["transcript", "block"]):
            lines, marker, feature = _observed(group, borders)
            before, after = group.column("before")[0].as_py(), group.column("after")[0].as_py()
            path = block_path(model, model.emission(marker, feature), before, after)
            got: list[tuple[int, int, list[str]]] = []
            opened = 0
            for line, state in zip(lines, path):
                role, opens = STATES[state]
                opened += opens
                if opens or not got:
                    got.append((opened, role, []))
                body = strip_marker(line) if opens else line
                if body.strip():  # a marker may have a line of its own
                    got[-1][2].append(body)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(got), group.column("transcript").type), pa.array([block] * len(got), pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([ROLES[g[1]] for g in got]), pa.array(["\n".join(g[2]) for g in got])],
                names=["transcript", "block", "opened", "role", "piece"],
            )

    blocks = _ordered(rows, "part", "text").mapInArrow(matrices, f"transcript {kind}, block long, opening binary, inner binary")
    solved = blocks.repartition("transcript").sortWithinPartitions("transcript", "block").mapInArrow(ends, f"transcript {kind}, block long, before int, after int")
    solved = materialize(solved)
    found = _ordered(rows.join(solved, ["transcript", "block"]), "part", "text").mapInArrow(pieces, f"transcript {kind}, block long, opened long, role string, piece string")
    found = materialize(found)
    count = found.groupBy("transcript", "block").agg(F.max("opened").alias("n"))
    earlier = Window.partitionBy("transcript").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select("transcript", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    placed = found.join(first, ["transcript", "block"]).select("transcript", (F.col("first") + F.col("opened") - 1).alias("turn"), "block", "role", "piece")
    whole = placed.groupBy("transcript", "turn").agg(F.min_by("role", "block").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"]), "\n").alias("text"))
    return whole.select("transcript", "turn", "role", "text", render("role", "text").alias("rendered"))


def render(role: str, text: str):
    """Canonical form of a turn; its own delimiters inside the text lose their bars."""
    safe = F.replace(F.replace(F.col(text), F.lit("<|im_start|>"), F.lit("<im_start>")), F.lit("<|im_end|>"), F.lit("<im_end>"))
    return F.concat(F.lit("<|im_start|>"), F.col(role), F.lit("\n"), safe, F.lit("<|im_end|>\n"))
