"""Video ids from lists of links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The host names links are recognised by, and the query parameter with the id.
WATCH_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com")
SHORT_HOSTS = ("youtu.be",)
MARKERS = ("youtube.com", "youtu.be")
ID_PARAMETER = "v"

_WHITE = r"^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$"


def extract_video_ids(
    lines: DataFrame,
    url_col: str = "url",
    watch_hosts: Sequence[str] | str = WATCH_HOSTS,
    short_hosts: Sequence[str] | str = SHORT_HOSTS,
    markers: Sequence[str] = MARKERS,
    parameter: str = ID_PARAMETER,
    path_pattern: str | None = None,
) -> DataFrame:
    """Add ``video_id`` to every line that names a video; other lines are dropped.

    A line with none of the ``markers`` is itself an id. In a link of a watch host the id is the
    query parameter, in one of a short host the path. Hosts are a list of names or one regular
    expression for the whole name. ``path_pattern`` is an optional regular
    expression whose first group finds an id in the path of a watch host, such as
    ``^/(?:shorts|live)/([^/]+)``.
    """
    url = F.col("_line")
    host = F.lower(
        F.regexp_extract(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), r"([^@:]*)(?::[0-9]*)?$", 1)
    )
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    given = F.regexp_extract(query, rf"(?:^|&){parameter}=([^&]+)", 1)
    from_query = F.when(given != "", F.coalesce(F.try_url_decode(given), given))
    if path_pattern:
        in_path = F.regexp_extract(path, path_pattern, 1)
        from_query = F.coalesce(from_query, F.when(in_path != "", in_path))
    is_link = F.lit(False)
    for mark in markers:
        is_link = is_link | url.contains(mark)
    video_id = (
        F.when(~is_link, url)
        .when(_host_in(host, watch_hosts), from_query)
        .when(_host_in(host, short_hosts), F.regexp_replace(F.regexp_replace(path, "^.", ""), r";[^/]*$", ""))
    )
    return (
        lines.withColumn("_line", F.regexp_replace(url_col, _WHITE, ""))
        .where("_line <> ''")
        .withColumn("video_id", video_id)
        .drop("_line")
        .where("video_id is not null")
    )


def _host_in(host: Column, hosts: Sequence[str] | str) -> Column:
    return host.rlike(f"^(?:{hosts})$") if isinstance(hosts, str) else host.isin(list(hosts))


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(url, line_key): the lines of text files; ``line_key`` sorts them as they are in the files.

    The key is the file, the place of the read block in it and the row in the block, so that
    several tasks can read one file.
    """
    return spark.read.text(path).select(
        F.col("value").alias("url"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_key"),
    )


def read_video_ids(
    spark: SparkSession, path: str, limit: int | None = None, dedupe: bool = True, **kw
) -> DataFrame:
    """(video_id, line_key) from a list of links or ids, in file order.

    Repeated ids are kept once, at their first line, unless ``dedupe`` is off: a repeated id would
    double its text and its chunks. ``limit`` keeps the first ids; 0 keeps none.
    """
    found = extract_video_ids(read_url_lines(spark, path), **kw).select("video_id", "line_key")
    if dedupe:
        found = found.groupBy("video_id").agg(F.min("line_key").alias("line_key"))
    return found if limit is None else found.orderBy("line_key").limit(limit)


def read_url_csv(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded table of links; it needs a header with the column ``url``."""
    table = spark.read.option("header", True).csv(path)
    if "url" not in table.columns:
        raise ValueError("the file must have a column named url")
    return table
