"""Incremental ingestion of response files: late duplicates dropped within a watermark, one commit per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

RESPONSES = "model string, question_id string, condition string, raw_response string, ts timestamp"


def read_responses(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def deduplicated(responses: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first record of each (model, question, condition) within the lateness; state is bounded by it."""
    return responses.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["model", "question_id", "condition"])


def into_table(responses: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = responses.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
