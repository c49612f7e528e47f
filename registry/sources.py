"""Registered queries: sources, sinks and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.process import process
from lectern.session import scratch_table
from lectern.operators import sentiment as sn
from lectern.sources import captions as cp
from lectern.sources import tables as tb
from lectern.sources.video_ids import extract_video_ids
from registry import base as b
from registry.base import sql

Q: dict = {}
SQL: dict = {}


def query(name, oracle=None):
    def add(fn):
        Q[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn

    return add


@query(
    "url_ids",
    r"""SELECT page_id, video_id FROM (
          SELECT page_id,
                 CASE WHEN NOT contains(url, '.example.') THEN url
                      WHEN host LIKE '%.example.com' OR host LIKE '%.example.net' THEN nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '')
                      WHEN host LIKE '%.example.org' THEN substr(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 2) END AS video_id
          FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages)) WHERE video_id IS NOT NULL""",
)
def _(spark, d):
    """The hosts of the pages table in place of video hosts, ``page`` in place of the id parameter."""
    found = extract_video_ids(
        b.table(spark, d, "pages"),
        watch_hosts=r".*\.example\.(?:com|net)",
        short_hosts=r".*\.example\.org",
        markers=[".example."],
        parameter="page",
    )
    return found.select("page_id", "video_id")


CAPTIONS_SQL = """lines AS (
      SELECT doc_id, trim(line) AS line, pos FROM (
        SELECT doc_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS pos
        FROM (SELECT doc_id, 'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || chr(10) || '00:00.000 --> 00:01.000' || chr(10)
                     || replace(text, chr(10), chr(10) || chr(10) || '00:01.000 --> 00:02.000' || chr(10) || 'and' || chr(10)) AS content FROM documents))),
    numbered AS (SELECT doc_id, line, pos, sum(CASE WHEN contains(line, '-->') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM lines),
    blocks AS (SELECT doc_id, block, string_agg(line, ' ' ORDER BY pos) AS text FROM numbered
               WHERE line <> '' AND NOT contains(line, '-->') AND NOT contains(line, 'WEBVTT') AND NOT (block = 0 AND line LIKE 'Kind:%')
               GROUP BY doc_id, block),
    segs AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS segment FROM blocks)"""


def caption_files(spark, d):
    """Caption files made of the documents: every line a caption of one or two lines."""
    timing = "\n\n00:01.000 --> 00:02.000\nand\n"
    content = F.concat(
        F.lit("WEBVTT\nKind: captions\n\n00:00.000 --> 00:01.000\n"), F.replace("text", F.lit("\n"), F.lit(timing))
    )
    return b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("video_id"), content.alias("content"))


@query("caption_segments", f"WITH {CAPTIONS_SQL} SELECT video_id, CAST(segment AS INTEGER) AS segment, text FROM segs")
def _(spark, d):
    return cp.parse_captions(caption_files(spark, d))


@query(
    "transcripts_table",
    f"""WITH {CAPTIONS_SQL} SELECT video_id, text, CAST(segment AS DOUBLE) AS start, CAST(1 AS DOUBLE) AS duration, 'en' AS lang FROM segs""",
)
def _(spark, d):
    return cp.build_transcripts(cp.parse_captions(caption_files(spark, d)))


# Every seventh date is damaged: a month 13, as dirty sources have it.
@query(
    "metadata_dates",
    """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, o_orderpriority AS title,
              CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS publish_date, o_custkey AS view_count
       FROM orders""",
)
def _(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    raw = b.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.lit(None).cast("string").alias("channel_id"),
        F.lit(None).cast("string").alias("channel"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.substring(day, 1, 4), F.lit("13"), F.substring(day, 7, 2)))
        .otherwise(day)
        .alias("upload_date"),
        F.col("o_custkey").alias("view_count"),
    )
    return cp.build_metadata(raw).select("video_id", "title", "publish_date", "view_count")


@query("table_roundtrip", "SELECT doc_id, text, lang, source FROM documents")
def _(spark, d):
    base = scratch_table(spark, "tables")
    docs = b.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    tb.write_tables({"documents": docs}, base, "raw")
    return tb.read_tables(spark, base, "raw")["documents"]


@query(
    "sql_view",
    sql(
        "chunks metadata",
        """SELECT channel_name, count(*) AS n_chunks, CAST(sum(length(normalized_text)) AS BIGINT) AS n_chars
           FROM chunks JOIN metadata USING (video_id) GROUP BY channel_name""",
    ),
)
def _(spark, d):
    base = scratch_table(spark, "views")
    tb.write_tables({"metadata": b.metadata(spark, d), "transcripts": b.segments(spark, d)}, base, "raw")
    tb.write_tables({"chunks": b.chunks(spark, d)}, base, "processed")
    tb.register_views(spark, base)
    return tb.query(
        spark,
        """SELECT channel_name, count(*) AS n_chunks, sum(length(normalized_text)) AS n_chars
           FROM processed_chunks JOIN raw_metadata USING (video_id) GROUP BY channel_name""",
    )


@query("sql_params", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND n_chars >= 500")
def _(spark, d):
    b.table(spark, d, "documents").createOrReplaceTempView("documents")
    return tb.query(
        spark, "SELECT doc_id, source FROM documents WHERE lang = :lang AND n_chars >= :least", lang="en", least=500
    )


@query("process")
def _(spark, d):
    """The whole run from raw tables to processed chunks."""
    base = scratch_table(spark, "run")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("video_id").cast("int") % 365)
    meta = b.metadata(spark, d).select("video_id", "title", "channel_name", day.alias("publish_date"))
    tb.write_tables({"transcripts": b.segments(spark, d), "metadata": meta}, base, "raw")
    # Both models learn from the same texts, which are cleaned once.
    labelled = b.stored(b.labelled_norm(spark, d))
    polarity = sn.learn_polarity(labelled)
    emotions = (*sn.learn_emotions(labelled, b.EMOTIONS), list(b.EMOTIONS))
    process(spark, base, polarity, emotions)
    return tb.read_tables(spark, base, "processed")["chunks"].drop("normalized_text")
