"""From link lists, caption files and metadata to the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.captions import build_transcripts, parse_captions, read_captions, read_metadata
from lectern.sources.tables import write_tables
from lectern.sources.video_ids import read_video_ids


def ingest(
    spark: SparkSession,
    links: str,
    captions: str,
    metadata: str,
    base: str,
    limit: int | None = None,
    strip_header: bool = True,
) -> dict[str, DataFrame]:
    """Write ``raw/transcripts`` and ``raw/metadata`` for the listed videos.

    ``links`` is a list of links or ids, ``captions`` a folder of caption files named by video id,
    ``metadata`` JSON lines. A listed video without captions or metadata is simply not there.
    """
    wanted = read_video_ids(spark, links, limit).select("video_id")
    files = read_captions(spark, captions).join(wanted, "video_id", "left_semi")
    tables = {
        "transcripts": build_transcripts(parse_captions(files, strip_header)),
        "metadata": read_metadata(spark, metadata).join(wanted, "video_id", "left_semi"),
    }
    write_tables(tables, base, "raw")
    return tables
