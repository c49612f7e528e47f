"""The row-local steps on a stream of segments.

Normalisation and model scores look at one row at a time, so they run on a streaming DataFrame
as they are; nothing here keeps state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.text import normalize
from lectern.sources.captions import TRANSCRIPTS


def read_segments(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Transcript files as they arrive in a folder."""
    return spark.readStream.schema(TRANSCRIPTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def normalize_stream(segments: DataFrame, out: str, checkpoint: str, stop_words: Sequence[str] | None = None):
    """Append the normalised segments to a Parquet folder; every file is taken exactly once."""
    return (
        normalize(segments, stop_words)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
