"""Named functions applied to (name, args) rows, with retries; failures become rows, never failed jobs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.rules import TOOL_ALIASES

ATTEMPTS = T.ArrayType(T.StructType([
    T.StructField("attempt", T.IntegerType()), T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType())
]))


def with_retry(fn: Callable[..., object], n: int) -> Callable[..., tuple[object, list[dict]]]:
    """Call up to ``n`` times; returns the value (None if all failed) and every attempt."""

    def call(**args):
        tries: list[dict] = []
        for i in range(1, n + 1):
            try:
                value = fn(**args)
            except Exception as e:  # noqa: BLE001 - a user function may raise anything
                tries.append({"attempt": i, "success": False, "error": f"{type(e).__name__}: {e}"})
                continue
            tries.append({"attempt": i, "success": True, "error": None})
            return value, tries
        return None, tries

    return call


def run_tools(
    calls: DataFrame, registry: Mapping[str, Callable[..., object]], aliases: Mapping[str, str] = TOOL_ALIASES,
    retries: int = 1, name: str = "tool_name", args: str = "args",
) -> DataFrame:
    """Adds status, result (JSON), error, attempts, execution_time. ``args`` is a map<string,string> column.

    A name is used as it is or through the alias map; an unknown one gives an error row.
    """
    functions, names = dict(registry), dict(aliases)
    schema = T.StructType([
        *calls.schema.fields, T.StructField("status", T.StringType()), T.StructField("result", T.StringType()),
        T.StructField("error", T.StringType()), T.StructField("attempts", ATTEMPTS), T.StructField("execution_time", T.DoubleType()),
    ])

    def one(tool: str, given) -> tuple:
        fn = functions.get(tool) or functions.get(names.get(tool, ""))
        if fn is None:
            return "error", None, f"Tool '{tool}' not found.", [], 0.0
        began = time.perf_counter()
        value, tries = with_retry(fn, retries)(**dict(given or {}))
        spent = time.perf_counter() - began
        if not tries or not tries[-1]["success"]:
            return "error", None, tries[-1]["error"] if tries else None, tries, spent
        return "success", json.dumps(value, ensure_ascii=False, default=str), None, tries, spent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(t, a) for t, a in zip(pdf[name], pdf[args])]
            for i, c in enumerate(("status", "result", "error", "attempts", "execution_time")):
                pdf[c] = pd.Series([r[i] for r in rows], index=pdf.index, dtype="float64" if c == "execution_time" else "object")
            yield pdf

    return calls.mapInPandas(run, schema)
