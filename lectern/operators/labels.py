"""Short labels for topics from several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import OUTLIER_TOPIC
from lectern.functions.text import tokens
from lectern.operators.skew import lookup_join
from lectern.operators.terms import english_stop_words, explode_terms, words_of
from lectern.operators.vectors import bucket_idf, buckets
from lectern.session import cut_lineage


def keyphrases(
    chunks: DataFrame,
    n: int = 5,
    dims: int = 64,
    stop_words: Sequence[str] | None = None,
    text_col: str = "normalized_text",
) -> DataFrame:
    """(topic_id, rank, phrase, score): words and word pairs closest to the topic's text.

    Phrase and text are compared as hashed TF-IDF vectors. The text of a topic is never put
    together: its vector comes from the bucket counts of its words.
    """
    topical = chunks.where(F.col("topic_id") != OUTLIER_TOPIC)
    words = tokens(F.col(text_col))
    idf = bucket_idf(chunks, dims, words)
    cells = (
        topical.select("topic_id", F.explode(buckets(words, dims).cast("array<int>")).alias("bucket"))
        .groupBy("topic_id", "bucket")
        .agg(F.count("*").alias("n"))
    )
    per_topic = cells.groupBy("topic_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("_n")
    ).withColumn("_idf", idf.scalar())
    vector = per_topic.select(
        "topic_id",
        "_idf",
        F.transform("_idf", lambda w, i: w * F.coalesce(F.col("_n")[i], F.lit(0))).alias("_v"),
    ).withColumn("_norm", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x)))
    candidates = explode_terms(topical, ["topic_id"], stop_words, 2, text_col).distinct()
    placed = candidates.withColumn("_b", buckets(F.split("term", " "), dims).cast("array<int>"))
    met = lookup_join(placed, cut_lineage(vector), ["topic_id"], ["term"], "inner")
    first, second = F.col("_b")[0], F.get("_b", F.lit(1))
    a, b = F.get("_idf", first), F.get("_idf", second)
    dot = a * F.get("_v", first) + F.coalesce(b * F.get("_v", second), F.lit(0.0))
    length = (
        F.when(second.isNull(), a).when(first == second, 2 * a).otherwise(F.sqrt(a * a + b * b))
    )
    scored = met.select("topic_id", F.col("term").alias("phrase"), (dot / length / F.col("_norm")).alias("score"))
    best = Window.partitionBy("topic_id").orderBy(F.desc(F.round("score", 9)), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(
        "topic_id", "rank", "phrase", "score"
    )


def statistical_scores(
    chunks: DataFrame, stop_words: Sequence[str] | None = None, text_col: str = "normalized_text"
) -> DataFrame:
    """(topic_id, phrase, score): words and word pairs scored from statistics of the topic alone;
    a lower score is better.

    A word scores by its frequency, the chunks it is found in, how early these come in their
    video, and how varied its neighbours are; a pair scores by its words and its own frequency.
    Letter case is no feature, as the text is in lower case. The middle position is the exact median,
    from running counts of the positions.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    rows = chunks.where(F.col("topic_id") != OUTLIER_TOPIC).select(
        "topic_id", "chunk_id", words_of(F.col(text_col), stop_words).alias("_words")
    )
    uses = F.transform("_words", lambda w: F.struct(w.alias("word"), F.lit(None).cast("bigint").alias("at")))
    places = F.transform(F.array_distinct("_words"), lambda w: F.struct(w.alias("word"), F.col("chunk_id").alias("at")))
    placed = F.col("at").isNotNull()
    by_word = Window.partitionBy("topic_id", "word")
    found = (
        rows.select("topic_id", F.inline(F.concat(uses, places)))
        .groupBy("topic_id", "word", "at")
        .agg(F.count("*").alias("n"))
        .withColumn("_upto", F.sum(F.when(placed, F.col("n"))).over(by_word.orderBy("at")))
        .withColumn("_all", F.sum(F.when(placed, F.col("n"))).over(by_word))
        .groupBy("topic_id", "word")
        .agg(
            F.sum(F.when(~placed, F.col("n"))).alias("tf"),
            F.coalesce(F.sum(F.when(placed, F.col("n"))), F.lit(0)).alias("sf"),
            F.min(F.when(placed & (2 * F.col("_upto") >= F.col("_all")), F.col("at"))).alias("middle"),
        )
    )
    neighbours = F.zip_with(
        "_words", F.slice("_words", 2, 2_000_000_000), lambda a, b: F.struct(a.alias("w1"), b.alias("w2"))
    )
    # Written once: the neighbours on both sides and the scores of pairs read it.
    pairs = cut_lineage(
        rows.select("topic_id", F.inline(neighbours))
        .where("w2 is not null")
        .groupBy("topic_id", "w1", "w2")
        .agg(F.count("*").alias("tf"))
    )
    left = pairs.groupBy("topic_id", F.col("w2").alias("word")).agg((F.count("*") / F.sum("tf")).alias("dl"))
    right = pairs.groupBy("topic_id", F.col("w1").alias("word")).agg((F.count("*") / F.sum("tf")).alias("dr"))
    found = cut_lineage(found)
    spread = found.groupBy("topic_id").agg(
        F.max("tf").alias("_max"), (F.avg("tf") + F.stddev_pop("tf")).alias("_scale")
    )
    sentences = rows.groupBy("topic_id").agg(F.count("*").alias("_chunks"))
    per_topic = cut_lineage(spread.join(sentences, "topic_id"))
    rel = 1 + (F.coalesce("dl", F.lit(0.0)) + F.coalesce("dr", F.lit(0.0))) * F.col("tf") / F.col("_max")
    early = F.log(F.log(3 + F.col("middle")))
    words = cut_lineage(
        lookup_join(
            found.join(left, ["topic_id", "word"], "left").join(right, ["topic_id", "word"], "left"),
            per_topic, ["topic_id"], ["word"], "inner",
        )
        .withColumn("_rel", rel)
        .select(
            "topic_id",
            "word",
            "tf",
            (
                F.col("_rel") * early
                / (F.col("tf") / F.col("_scale") / F.col("_rel") + F.col("sf") / F.col("_chunks") / F.col("_rel"))
            ).alias("s"),
        )
    )
    of = words.select("topic_id", F.col("word").alias("w1"), F.col("s").alias("s1"))
    to = words.select("topic_id", F.col("word").alias("w2"), F.col("s").alias("s2"))
    two = pairs.join(of, ["topic_id", "w1"]).join(to, ["topic_id", "w2"]).select(
        "topic_id",
        F.concat_ws(" ", "w1", "w2").alias("phrase"),
        (F.col("s1") * F.col("s2") / (F.col("tf") * (1 + F.col("s1") + F.col("s2")))).alias("score"),
    )
    one = words.select(
        "topic_id", F.col("word").alias("phrase"), (F.col("s") / (F.col("tf") * (1 + F.col("s")))).alias("score")
    )
    return one.unionByName(two)


def keywords_statistical(scores: DataFrame, n: int = 5, dedup_ratio: float = 0.9) -> DataFrame:
    """(topic_id, rank, phrase, score): the ``n`` best phrases, near copies of a better one left out.

    Each round takes the best phrase left in every topic and drops what is too similar to it, which
    is the same as walking down the whole list; no candidate is cut off beforehand.
    """
    order = F.struct(F.round("score", 9).alias("o"), "phrase", "score")
    left = cut_lineage(scores)
    picked = None
    for rank in range(1, n + 1):
        best = left.groupBy("topic_id").agg(F.min(order).alias("b"))
        best = cut_lineage(
            best.select("topic_id", F.lit(rank).alias("rank"), F.col("b.phrase").alias("phrase"), F.col("b.score").alias("score"))
        )
        picked = best if picked is None else picked.unionByName(best)
        if rank < n:
            taken = best.select("topic_id", F.col("phrase").alias("_taken"))
            longer = F.greatest(F.length("phrase"), F.length("_taken"))
            # At least the difference in length has to be changed, which tells most phrases apart at no cost.
            apart = 1 - F.abs(F.length("phrase") - F.length("_taken")) / longer <= dedup_ratio
            ratio = 1 - F.levenshtein("phrase", "_taken") / longer
            left = cut_lineage(
                lookup_join(left, taken, ["topic_id"], ["phrase"], "inner").where(apart | (ratio <= dedup_ratio)).drop("_taken")
            )
    return picked


def label_lists(ranked: DataFrame, out: str) -> DataFrame:
    """One list of phrases per topic, in rank order."""
    return ranked.groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda p: p["phrase"]).alias(out)
    )


def merge_labels(
    names: DataFrame, phrases: DataFrame, statistical: DataFrame, extra: DataFrame | None = None
) -> DataFrame:
    """(topic_id, default_name, keyphrases, keywords, extra): labels of all sources per topic.

    A topic without phrases gets an empty list, one without an extra label a null.
    """
    none = F.array().cast("array<string>")
    merged = (
        names.select("topic_id", F.col("name").alias("default_name"))
        .join(label_lists(phrases, "keyphrases"), "topic_id", "left")
        .join(label_lists(statistical, "keywords"), "topic_id", "left")
        .withColumn("keyphrases", F.coalesce("keyphrases", none))
        .withColumn("keywords", F.coalesce("keywords", none))
    )
    if extra is None:
        return merged.withColumn("extra", F.lit(None).cast("string"))
    return merged.join(extra.select("topic_id", F.col("label").alias("extra")), "topic_id", "left")
