"""Readers and writers for records, documents and measurement tables. All parse on executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_one_json, py_strip
from .json_array import read_array_elements

# The record shape. ``image`` may hold a string or, as JSON text, a list.
RECORD_SCHEMA = (
    "id string, image string, image_path string, img_path string, image_file string, "
    "conversations array<struct<`from`:string,value:string>>, modality string, "
    "question string, q string, ground_truth_answer string, correct_answer string, answer string, gt_answer string, a string"
)
PLURAL_QUESTION = "What conditions are present in this fundus image?"
SINGULAR_QUESTION = "What is shown in this fundus image?"


CAPITALIZED = {"image": "Image", "question": "Question", "answer": "Answer"}


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Non-blank JSON texts in ``value`` with their record ``r`` (``r._bad`` is set when malformed)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    whole = F.when(is_one_json(F.col("value")), F.col("value"))  # null for text behind the record
    return lines.where(py_strip(F.col("value")) != "").withColumn(
        "r", F.from_json(whole, f"{schema}, _bad string", options)
    )


def _records(parsed: DataFrame, *keep: str) -> DataFrame:
    """Well-formed records. Spark names ignore case, so the capitalized spellings are read by path and
    fill the lower-case column they rank right after."""
    good = parsed.where("r is not null and r._bad is null")
    fields = [f for f in parsed.schema["r"].dataType.fieldNames() if f != "_bad"]
    columns = []
    for f in fields:
        value = F.col(f"r.{f}")
        if f in CAPITALIZED:
            name = CAPITALIZED[f]
            other = F.when(F.contains("value", F.lit(f'"{name}"')), F.get_json_object("value", f"$.{name}"))
            value = F.coalesce(F.nullif(value, F.lit("")), other)
        columns.append(value.alias(f))
    return good.select(*keep, *columns)


def read_examples_jsonl(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """One record per line; blank and malformed lines are skipped (see ``count_malformed``)."""
    return _records(_parsed(spark.read.text(path), schema))


def count_malformed(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return _parsed(spark.read.text(path), schema).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("malformed")
    )


def read_examples_json(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, arrays: bool = False) -> DataFrame:
    """A top-level array, an object with data / examples / items, or one bare record per file.

    A file is one task, and one that is not JSON as a whole has no records. With ``arrays`` all files are arrays of
    any size: many tasks read each one, and elements that are not JSON are skipped one by one.
    """
    if arrays:
        return _records(_parsed(read_array_elements(spark, path).select("value"), schema))
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    wrapped = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("data", "examples", "items")])
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), wrapped, F.array("v"))
    rows = v.where("v is not null").select(F.explode(items).alias("i"))
    return _records(_parsed(rows.select(F.to_json("i").alias("value")), schema))


def read_examples_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled images with a Python list literal of categories → (question, image_path, ground_truth_answer).

    A literal that is not a list counts as a one-element list of its text; empty images, unreadable
    literals and empty lists are dropped.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False)
    raw = py_strip(F.col("categories"))
    as_list = F.from_json(raw, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    scalar = raw.rlike(r"""^(?:'[^']*'|"[^"]*"|[-+]?\d+(?:\.\d*)?|True|False|None|\(.*\)|\{.*\})$""")
    cats = F.when(raw.rlike(r"(?s)^\[.*\]$"), as_list).when(scalar, F.array(raw))
    image = py_strip(F.col("image"))
    question = F.when(F.size("c") == 1, SINGULAR_QUESTION).otherwise(PLURAL_QUESTION)
    return (
        rows.select(image.alias("image_path"), cats.alias("c"))
        .where("image_path != '' and c is not null and size(c) > 0")
        .select(question.alias("question"), "image_path", F.array_join("c", ", ").alias("ground_truth_answer"))
    )


def read_dataset_dir(spark: SparkSession, directory: str, pattern: str | None = None, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Every ``*.jsonl`` of a directory, tagged with its ``dataset`` name; ``pattern`` narrows the names."""
    lines = spark.read.option("pathGlobFilter", pattern or "*.jsonl").text(directory).select(
        "value", F.col("_metadata.file_name").alias("f")
    )
    visible = lines.where(F.col("f").endswith(".jsonl") & ~F.col("f").startswith("."))
    name = F.regexp_replace("f", r"\.jsonl$", "")
    return _records(_parsed(visible, schema).withColumn("dataset", name), "dataset")


def read_corpus(spark: SparkSession, directory: str, recursive: bool = True, pattern: str = "*") -> DataFrame:
    """Text files as documents with source, filename, file_size; unreadable files are skipped."""
    files = (
        spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern)
        .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(directory, wholetext=True)
    )
    return files.select(
        F.col("value").alias("content"), F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("file_size"),
        F.length("value").alias("content_length"),
    )


def read_measurements(spark: SparkSession, path: str, schema: str | None = None, key: str = "Name") -> DataFrame:
    """CSV with header. Without a schema every column but the key is read as a double; a byte-order mark is dropped."""
    if schema:
        return spark.read.csv(path, header=True, schema=schema)
    raw = spark.read.csv(path, header=True)
    clean = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return clean.select(*[F.col(c) if c == key else F.col(c).try_cast("double").alias(c) for c in clean.columns])


def write_measurements(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def convert_json_layout(df: DataFrame, out: str, layout: str = "jsonl") -> None:
    """Write records as JSON lines, or as one JSON array per output file, streamed row by row."""
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    if layout == "jsonl":
        lines.write.mode("overwrite").text(out)
        return
    if layout != "array":
        raise ValueError(f"unknown layout {layout!r}")

    def brackets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last line of a partition must not get a comma
        opened = False
        for pdf in batches:
            texts = list(pdf["value"])
            if held is not None:
                texts = [held, *texts]
            if texts:
                held = texts.pop()
            rows = [f"{t}," for t in texts]
            if rows:
                yield pd.DataFrame({"value": rows if opened else ["[", *rows]})
                opened = True
        if held is not None:
            yield pd.DataFrame({"value": ([] if opened else ["["]) + [held, "]"]})

    lines.mapInPandas(brackets, "value string").write.mode("overwrite").text(out)
