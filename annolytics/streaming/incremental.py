"""Incremental validation: new result files are picked up, validated and written exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.validation import validate

RESULT_SCHEMA = (
    "id string, question string, ground_truth_answer string, trajectory string, reasoning_type string, "
    "tool_execution_log array<struct<tool_name:string,result:struct<status:string>,status:string>>"
)


def stream_validate(
    spark: SparkSession, source: str, out: str, checkpoint: str, schema: str = RESULT_SCHEMA, max_files: int | None = None
) -> StreamingQuery:
    """Validate all files not seen yet (``availableNow``), then stop; call again to go on.

    Each micro-batch replaces its own ``batch_id`` folder, so a batch that is run again after a failure
    does not add its rows twice. Rows are independent: no state is kept.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        validate(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        reader.json(source).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def validated(spark: SparkSession, out: str) -> DataFrame:
    """All validated rows, with the ``batch_id`` they were written under."""
    return spark.read.parquet(out)
