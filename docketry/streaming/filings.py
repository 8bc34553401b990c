"""Extraction over a stream of filings.  An addition: extraction has no state, so the batch transform runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docketry.operators.extraction import extract


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_citations(filings: DataFrame, path: str, checkpoint: str, **options: bool) -> StreamingQuery:
    """Citations of new filings, appended as Parquet; a restart goes on from ``checkpoint``."""
    return extract(filings, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
