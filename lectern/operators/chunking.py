"""Joining transcript segments and cutting the joined text into overlapping chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import BLOCK_ROWS, block_of, previous_value, running_total

# Segments per text block: large enough that ordinary videos are a single block.
TEXT_BLOCK = 256


def join_segments(
    df: DataFrame,
    keys: Sequence[str] = ("video_id",),
    text_col: str = "normalized_text",
    order_col: str = "start",
    block_span: int = TEXT_BLOCK,
) -> DataFrame:
    """Texts of each group in order, joined by one space, as consecutive pieces.

    One row per piece: the piece, its character offset in the joined text and the length of the
    whole text. The pieces of a group, put one after the other, are the joined text; a group
    never has to fit into one row. Segments without text are skipped.
    """
    dealt = _deal(df, keys, text_col, order_col, block_span)
    return _pieces(dealt, _places(dealt, keys), keys)


def _deal(df: DataFrame, keys: Sequence[str], text_col: str, order_col: str, block_span: int) -> DataFrame:
    """The one shuffle of the texts: segments of a block meet in one partition.

    Everything later reads these same columns, so that Spark reuses the exchange. Segments without text
    come along: a filter on the text would be worked out below its clean-up, which would then run twice.
    """
    return (
        df.select(
            *keys,
            F.coalesce(block_of(F.col(order_col), block_span), F.lit(-1)).alias("block_id"),
            F.col(order_col).alias("_start"),
            F.col(text_col).alias("_text"),
        )
        .repartition(*keys, "block_id")
    )


def _places(dealt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where each block lies in the joined text of its group: one small row per block."""
    ordered = Window.partitionBy(*keys).orderBy("block_id")
    whole = Window.partitionBy(*keys)
    sizes = dealt.groupBy(*keys, "block_id").agg(
        F.sum(F.length("_text") + 1).alias("_len"),
        F.min(F.when(F.col("_text").isNotNull(), F.col("_start"))).alias("_first"),
    )
    return sizes.where("_len is not null").select(
        *keys,
        "block_id",
        F.coalesce(
            F.sum("_len").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("char_offset"),
        (F.sum("_len").over(whole) - 1).alias("total_chars"),
        F.min("_first").over(whole).alias("start_time"),
        F.lead("block_id").over(ordered).isNotNull().alias("_more"),
    )


def _pieces(dealt: DataFrame, places: DataFrame, keys: Sequence[str]) -> DataFrame:
    where = [*keys, "block_id", "char_offset", "total_chars", "start_time"]
    joined = F.expr("listagg(_text, ' ') within group (order by _start, _text)")
    return (
        dealt.join(places, [*keys, "block_id"])
        .groupBy(*where, "_more")
        .agg(joined.alias("_piece"))
        .select(*where, F.when(F.col("_more"), F.concat("_piece", F.lit(" "))).otherwise(F.col("_piece")).alias("piece"))
    )


def chunk(
    df: DataFrame,
    max_chars: int = 1000,
    overlap: int = 100,
    text_col: str = "normalized_text",
    order_col: str = "start",
    block_span: int = TEXT_BLOCK,
) -> DataFrame:
    """Cut the joined text of every video at fixed character positions.

    Chunk k holds the characters from ``k * (max_chars - overlap)`` on, at most ``max_chars`` of
    them; every chunk of a video carries the start of its first segment. Chunks inside one piece
    are cut in place; only chunks across a piece border, found in videos of several pieces, are put
    together by a second, small shuffle. An empty text has no chunks.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and smaller than max_chars")
    step = max_chars - overlap
    keys = ["video_id"]
    dealt = _deal(df, keys, text_col, order_col, block_span)
    places = _places(dealt, keys)
    inside = _parts(_pieces(dealt, places, keys), max_chars, step).where("whole")
    several = places.where("char_offset > 0 or _more")
    across = (
        _parts(_pieces(dealt, several, keys), max_chars, step)
        .where("not whole")
        .groupBy("video_id", "chunk_id")
        .agg(
            F.expr("listagg(part, '') within group (order by block_id)").alias("normalized_text"),
            F.min("start_time").alias("start_time"),
        )
    )
    return inside.select("video_id", "chunk_id", F.col("part").alias("normalized_text"), "start_time").unionByName(across)


def _parts(pieces: DataFrame, max_chars: int, step: int) -> DataFrame:
    """The part of every chunk that lies in each piece, and whether it is the whole chunk."""
    begin, end, total = F.col("char_offset"), F.col("_end"), F.col("total_chars")
    first = F.greatest(F.lit(0), F.floor((begin - max_chars) / step) + 1).cast("bigint")
    last = F.floor((F.least(end, total) - 1) / step).cast("bigint")

    def part(k):
        lo = F.greatest(k * step, begin)
        hi = F.least(k * step + max_chars, end, total)
        return F.struct(
            k.alias("chunk_id"),
            F.col("piece").substr((lo - begin + 1).cast("int"), (hi - lo).cast("int")).alias("part"),
            ((k * step >= begin) & (F.least(k * step + max_chars, total) <= end)).alias("whole"),
        )

    return (
        pieces.withColumn("_end", begin + F.length("piece"))
        .where((end > begin) & (last >= first))
        .select("video_id", "block_id", "start_time", F.explode(F.transform(F.sequence(first, last), part)).alias("p"))
        .select("video_id", "block_id", "start_time", "p.*")
    )


def merge_by_gap(
    df: DataFrame, gap: float = 5.0, order_col: str = "start", block_span: float = BLOCK_ROWS
) -> DataFrame:
    """Number the runs of segments whose pause to the segment before is below ``gap`` seconds.

    The texts of a run come from ``join_segments`` with the keys ``video_id, group_id``, its
    extent from ``gap_spans``.
    """
    order = [order_col, "duration"]
    block = block_of(F.col(order_col), block_span)
    ends = previous_value(
        df, ["video_id"], order, block, F.col(order_col) + F.col("duration"), "_prev_end"
    )
    opens = F.when(F.col(order_col) - F.col("_prev_end") < gap, 0).otherwise(1)
    flagged = ends.withColumn("_opens", opens).drop("_prev_end")
    return (
        running_total(flagged, ["video_id"], order, block, F.col("_opens"), "_earlier")
        .withColumn("group_id", (F.col("_earlier") + F.col("_opens") - 1).cast("bigint"))
        .drop("_earlier", "_opens")
    )


def gap_spans(merged: DataFrame, order_col: str = "start") -> DataFrame:
    """Start, duration and number of segments of every run found by ``merge_by_gap``."""
    begin = F.min(order_col)
    return merged.groupBy("video_id", "group_id").agg(
        begin.alias("start"),
        (F.max(F.col(order_col) + F.col("duration")) - begin).alias("duration"),
        F.count("*").alias("num_segments"),
    )


def chunk_spans(
    df: DataFrame,
    max_chars: int = 1000,
    overlap: int = 100,
    text_col: str = "normalized_text",
    order_col: str = "start",
    block_span: int = BLOCK_ROWS,
) -> DataFrame:
    """Start, duration and number of the segments that reach into each chunk.

    Works on character offsets alone; no text is shuffled. Segments without characters belong to
    no chunk.
    """
    step = max_chars - overlap
    lengths = df.where(F.col(text_col).isNotNull()).select(
        "video_id", order_col, "duration", F.length(text_col).cast("bigint").alias("_len")
    )
    placed = running_total(
        lengths, ["video_id"], [order_col], block_of(F.col(order_col), block_span), F.col("_len") + 1, "_begin"
    ).where("_len > 0")
    first = F.greatest(F.lit(0), F.floor((F.col("_begin") - max_chars) / step) + 1).cast("bigint")
    last = F.floor((F.col("_begin") + F.col("_len") - 1) / step).cast("bigint")
    begin = F.min(order_col)
    return (
        placed.where(first <= last)
        .withColumn("chunk_id", F.explode(F.sequence(first, last)))
        .groupBy("video_id", "chunk_id")
        .agg(
            begin.alias("start"),
            (F.max(F.col(order_col) + F.col("duration")) - begin).alias("duration"),
            F.count("*").alias("num_segments"),
        )
    )
