"""Caption files and video metadata as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSCRIPTS = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("lang", T.StringType()),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("channel_id", T.StringType()),
        T.StructField("channel_name", T.StringType()),
        T.StructField("publish_date", T.DateType()),
        T.StructField("view_count", T.LongType()),
    ]
)
_WHITE = r"^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$"


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, content): one row per caption file, named ``<video id>.<anything>``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("video_id"), F.col("value").alias("content"))


def parse_captions(files: DataFrame, strip_header: bool = True) -> DataFrame:
    """(video_id, segment, text): the text blocks between the timing lines of each file.

    A file is one row, so this needs no shuffle: timing lines become line breaks, which no line
    can hold itself, the other lines are joined by spaces, and the result is split at the breaks.
    ``strip_header`` leaves out the header lines ``Kind:`` and ``Language:`` before the first
    timing line; without it they are part of the first text.
    """
    lines = F.transform(F.split("content", "\n"), lambda x: F.regexp_replace(x, _WHITE, ""))
    named = files.withColumn("_lines", lines)
    first = F.array_position(F.transform("_lines", lambda x: x.contains("-->")), True)
    named = named.withColumn("_first", first)
    wanted = F.filter(
        "_lines",
        lambda x, i: (x != "")
        & ~x.contains("WEBVTT")
        & (~((F.col("_first") > i + 1) & x.rlike("^(Kind|Language):")) if strip_header else F.lit(True)),
    )
    marked = F.array_join(F.transform(wanted, lambda x: F.when(x.contains("-->"), "\n").otherwise(x)), " ")
    blocks = F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return named.select("video_id", F.posexplode(blocks).alias("segment", "text"))


def build_transcripts(segments: DataFrame, lang: str = "en") -> DataFrame:
    """Transcript rows: the number of the segment stands for its start, each lasts one unit."""
    return segments.select(
        "video_id",
        "text",
        F.col("segment").cast("double").alias("start"),
        F.lit(1.0).alias("duration"),
        F.lit(lang).alias("lang"),
    )


def empty_transcripts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRANSCRIPTS)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows from JSON lines as video sites give them."""
    raw = "id string, title string, channel_id string, channel string, upload_date string, view_count bigint"
    return build_metadata(spark.read.schema(raw).json(path))


def build_metadata(raw: DataFrame) -> DataFrame:
    """The six metadata fields; a date that is not a day in the form yyyyMMdd becomes null."""
    return raw.select(
        F.col("id").alias("video_id"),
        "title",
        "channel_id",
        F.col("channel").alias("channel_name"),
        parse_day(F.col("upload_date")).alias("publish_date"),
        "view_count",
    )


def parse_day(day):
    return F.when(day.rlike("^[0-9]{8}$"), F.try_to_date(day, "yyyyMMdd"))
