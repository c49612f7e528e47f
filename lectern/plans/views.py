"""The questions people ask of the processed chunks: counts, means, shares and lists.

``chunks`` always has the columns video_id, chunk_id, normalized_text, start_time, title, topic_id
and sentiment as far as a view needs them; ``names`` has topic_id and name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import OUTLIER_TOPIC
from lectern.functions.text import matches, sentiment_bucket, short_title, topic_label, video_url
from lectern.operators.ordered import block_of, running_total
from lectern.operators.skew import lookup_join, spread_join

KEY = ["video_id", "chunk_id"]


def without_outliers(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("topic_id") != OUTLIER_TOPIC)


def with_titles(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of the titles, and of the days of publication if there are any; videos with very many
    chunks are dealt over several tasks.

    A repeated video id in the metadata must not multiply chunks, so ids are made unique first.
    """
    carried = [x for x in ("title", "publish_date") if x in metadata.columns]
    titles = metadata.groupBy("video_id").agg(*(F.min(x).alias(x) for x in carried))
    return spread_join(chunks, titles, ["video_id"], ["chunk_id"], "left")


def with_topic_names(chunks: DataFrame, names: DataFrame, spread_by: Sequence[str] = KEY, how: str = "left") -> DataFrame:
    return lookup_join(chunks, names.select("topic_id", "name"), ["topic_id"], spread_by, how)


def enrich(chunks: DataFrame, *parts: DataFrame) -> DataFrame:
    """Topics, polarity and emotions next to their chunk, by chunk key instead of row position."""
    for part in parts:
        chunks = chunks.join(part, KEY, "left")
    return chunks


def overview(chunks: DataFrame) -> DataFrame:
    """Chunks, videos and topics; the outlier topic does not count as a topic."""
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct("video_id").alias("total_videos"),
        F.count_distinct(F.when(F.col("topic_id") != OUTLIER_TOPIC, F.col("topic_id"))).alias("topics_discovered"),
    )


def explore(
    chunks: DataFrame,
    names: DataFrame,
    video_ids: Sequence[str] | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Chunks with link and topic name, filtered by videos and by a text pattern."""
    found = chunks
    if video_ids:
        found = found.where(F.col("video_id").isin(list(video_ids)))
    if pattern:
        found = found.where(matches(F.col("normalized_text"), pattern))
    found = found.select("video_id", "chunk_id", "title", "topic_id", "normalized_text", "sentiment")
    return with_topic_names(found, names).select(
        video_url(F.col("video_id")).alias("video_url"),
        "title",
        F.col("name").alias("topic"),
        F.col("normalized_text").alias("text"),
        "sentiment",
    )


def search(chunks: DataFrame, pattern: str) -> DataFrame:
    return chunks.where(matches(F.col("normalized_text"), pattern))


def topic_options(names: DataFrame) -> DataFrame:
    return without_outliers(names).select(
        "topic_id", topic_label(F.col("topic_id"), F.col("name")).alias("label")
    )


def video_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select("video_id").distinct()


def video_options(chunks: DataFrame) -> DataFrame:
    """Every video once with its title, shortened for display, by title."""
    return (
        chunks.select("video_id", "title")
        .distinct()
        .select("video_id", "title", short_title(F.col("title")).alias("label"))
        .orderBy("title", "video_id")
    )


def video_stats(chunks: DataFrame, video_id: str | None = None) -> DataFrame:
    stats = _of_video(chunks, video_id).groupBy("video_id").agg(
        F.count("*").alias("total_chunks"), F.avg("sentiment").alias("avg_sentiment")
    )
    return stats.withColumn("bucket", sentiment_bucket(F.col("avg_sentiment")))


def video_topic_counts(chunks: DataFrame) -> DataFrame:
    return without_outliers(chunks).groupBy("video_id", "topic_id").agg(F.count("*").alias("n"))


def video_topic_distribution(chunks: DataFrame, names: DataFrame, video_id: str | None = None) -> DataFrame:
    """Named topic counts of one video (or of each video), most frequent first."""
    counts = video_topic_counts(_of_video(chunks, video_id))
    return with_topic_names(counts, names, ["video_id"]).orderBy("video_id", F.desc("n"), "topic_id")


def dominant_topic(chunks: DataFrame) -> DataFrame:
    """The most frequent topic of each video with its share of all chunks of the video, in percent.

    Ties go to the lowest topic id. Videos with outliers only are left out.
    """
    counts = chunks.groupBy("video_id", "topic_id").agg(F.count("*").alias("n"))
    topical = F.col("topic_id") != OUTLIER_TOPIC
    best = F.max_by(F.struct("topic_id", "n"), F.when(topical, F.struct(F.col("n"), -F.col("topic_id"))))
    return (
        counts.groupBy("video_id")
        .agg(best.alias("_best"), F.sum("n").alias("_all"), F.max(topical).alias("_topical"))
        .where("_topical")
        .select("video_id", "_best.topic_id", "_best.n", (F.col("_best.n") / F.col("_all") * 100).alias("share"))
    )


def video_sentiment(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Title, link, dominant topic and mean sentiment of every video."""
    means = chunks.groupBy("video_id").agg(
        F.avg("sentiment").alias("avg_sentiment"), F.min_by("title", "chunk_id").alias("title")
    )
    joined = means.join(dominant_topic(chunks).select("video_id", "topic_id"), "video_id", "left")
    return with_topic_names(joined, names, ["video_id"]).select(
        "title",
        video_url(F.col("video_id")).alias("url"),
        F.col("name").alias("dominant_topic"),
        "avg_sentiment",
    )


def topic_sentiment(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Mean sentiment of every named topic without the outliers, best first."""
    means = without_outliers(chunks).groupBy("topic_id").agg(F.avg("sentiment").alias("avg_sentiment"))
    return (
        means.join(names.select("topic_id", "name"), "topic_id")
        .select("topic_id", F.col("name").alias("topic"), "avg_sentiment")
        .orderBy(F.desc("avg_sentiment"), "topic_id")
    )


def sentiment_timeline(chunks: DataFrame, video_id: str | None = None) -> DataFrame:
    """Sentiment by position: the chunks of a video by start time, then chunk number, from 0 on.

    The position is the number of chunks with a smaller start time plus the rank among chunks of
    the same start time. Both are block-wise running totals, so that a video of any size, with all
    starts equal or all different, is never ordered in one task.
    """
    rows = _of_video(chunks, video_id).select("video_id", "chunk_id", "start_time", "sentiment")
    rows = rows.withColumn("start_time", F.coalesce("start_time", F.lit(0.0)))
    ranked = running_total(
        rows, ["video_id", "start_time"], ["chunk_id"], block_of(F.col("chunk_id")), F.lit(1), "_rank"
    )
    sizes = rows.groupBy("video_id", "start_time").agg(F.count("*").alias("_n"))
    earlier = running_total(
        sizes, ["video_id"], ["start_time"], block_of(F.col("start_time")), F.col("_n"), "_earlier"
    )
    # Equal starts share a key, and a video may have one start for all its chunks.
    shared = sizes.withColumnRenamed("_n", "_rows")
    placed = spread_join(ranked, earlier.drop("_n"), ["video_id", "start_time"], ["chunk_id"], counts=shared)
    return placed.select(
        "video_id", "chunk_id", (F.col("_earlier") + F.col("_rank")).alias("x"), "sentiment"
    )


def video_chunks(chunks: DataFrame, names: DataFrame, video_id: str | None = None) -> DataFrame:
    """Chunks of one video (or of each video) with topic name; chunk numbers may be absent."""
    rows = with_optional(_of_video(chunks, video_id), "chunk_id", "bigint")
    return with_topic_names(rows, names, ["chunk_id", "normalized_text"]).select(
        "video_id",
        F.col("chunk_id").alias("chunk"),
        F.col("name").alias("topic"),
        F.col("normalized_text").alias("text"),
        "sentiment",
    )


def with_optional(df: DataFrame, name: str, type_: str) -> DataFrame:
    """The column, or nulls of the given type where the table has no such column."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(type_))


def row_index(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """0-based row number in a total order; for result tables of bounded size."""
    return df.withColumn("index", F.row_number().over(Window.orderBy(*order)) - 1)


def has_scores(chunks: DataFrame) -> bool:
    """Whether there is anything to show: a sentiment column and at least one chunk."""
    return "sentiment" in chunks.columns and not chunks.isEmpty()


def first_n(df: DataFrame, n: int | None, order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows in an explicit order; ``None`` keeps all, 0 keeps none."""
    return df if n is None else df.orderBy(*order).limit(n)


def sample_n(
    df: DataFrame, n: int | None, seed: int = 42, keys: Sequence[str] = tuple(KEY), sort_limit: int = 100_000
) -> DataFrame:
    """Exactly ``n`` rows, chosen by a hash of the key and the seed.

    The choice does not depend on how the rows are partitioned. A small sample is a top-k. For a
    large one, the 65,536 hash prefixes are counted first; all rows below the prefix in which the
    n-th row lies are taken as they are, and only that one prefix is sorted.
    """
    if n is None:
        return df
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    marked = df.withColumn("_mark", mark)
    if n <= sort_limit:
        return marked.orderBy("_mark", *keys).limit(n).drop("_mark")
    prefix = F.substring("_mark", 1, 4)
    sizes = marked.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    cut = sizes.withColumn("upto", upto).where(F.col("upto") > n).orderBy("p").limit(1).collect()
    if not cut:
        return df
    edge, taken = cut[0]["p"], cut[0]["upto"] - cut[0]["n"]
    below = marked.where(prefix < edge)
    rest = marked.where(prefix == edge).orderBy("_mark", *keys).limit(n - taken)
    return below.unionByName(rest).drop("_mark")


def _of_video(chunks: DataFrame, video_id: str | None) -> DataFrame:
    return chunks if video_id is None else chunks.where(F.col("video_id") == video_id)
