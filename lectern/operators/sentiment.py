"""Polarity and emotion scores per chunk, and their means per topic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import POLARITY_LABELS
from lectern.functions.text import tokens
from lectern.operators.skew import is_small
from lectern.session import cut_lineage

KEY = ("video_id", "chunk_id")
# Word weights up to this number of words are broadcast, about 100 MB; of more, every block of texts gets
# those of its own words.
MAX_VOCABULARY = 1_000_000
BLOCK_CHARS = 8 << 20


def learn_polarity(
    texts: DataFrame, labels: Sequence[str] = POLARITY_LABELS, text_col: str = "normalized_text"
) -> tuple[DataFrame, DataFrame]:
    """Smoothed log word probabilities per class from labelled texts (multinomial naive Bayes).

    ``texts`` needs the columns ``label`` and ``text_col``. Returns the word weights, one column
    per class, and a one-row table with the prior and the weight of an unseen word of each class.
    """
    words = texts.select("label", F.explode(tokens(F.col(text_col))).alias("word"))
    # One row per word, written once: weights, totals and bias all read it.
    counts = cut_lineage(
        words.groupBy("word").agg(*[F.count_if(F.col("label") == v).alias(f"n_{v}") for v in labels])
    )
    totals = counts.agg(
        F.struct(F.count("*").alias("vocab"), *[F.sum(f"n_{v}").alias(f"n_{v}") for v in labels]).alias("totals")
    ).scalar()
    weights = counts.withColumn("_t", totals).select(
        "word",
        *[
            F.log((F.col(f"n_{v}") + 1) / (F.col(f"_t.n_{v}") + F.col("_t.vocab"))).alias(f"w_{v}")
            for v in labels
        ],
    )
    bias = (
        texts.agg(F.count("*").alias("_all"), *[F.count_if(F.col("label") == v).alias(f"_{v}") for v in labels])
        .withColumn("_t", totals)
        .select(
            *[F.log((F.col(f"_{v}") + 1) / (F.col("_all") + len(labels))).alias(f"prior_{v}") for v in labels],
            *[F.log(1 / (F.col(f"_t.n_{v}") + F.col("_t.vocab"))).alias(f"unseen_{v}") for v in labels],
        )
    )
    return weights, bias


def learn_emotions(
    texts: DataFrame, labels: Sequence[str], text_col: str = "normalized_text"
) -> tuple[DataFrame, DataFrame]:
    """Smoothed log odds of every word for each emotion on its own.

    ``texts`` needs one boolean column per emotion. The result has the layout of
    ``learn_polarity``; an unseen word speaks neither for nor against an emotion.
    """
    words = texts.select(*labels, F.explode(tokens(F.col(text_col))).alias("word"))
    counts = cut_lineage(
        words.groupBy("word").agg(
            *[F.count_if(F.col(v)).alias(f"y_{v}") for v in labels],
            *[F.count_if(~F.col(v)).alias(f"n_{v}") for v in labels],
        )
    )
    totals = counts.agg(
        F.struct(
            F.count("*").alias("vocab"),
            *[F.sum(f"y_{v}").alias(f"y_{v}") for v in labels],
            *[F.sum(f"n_{v}").alias(f"n_{v}") for v in labels],
        ).alias("totals")
    ).scalar()

    def share(side: str, v: str) -> Column:
        return F.log((F.col(f"{side}_{v}") + 1) / (F.col(f"_t.{side}_{v}") + F.col("_t.vocab")))

    weights = counts.withColumn("_t", totals).select(
        "word", *[(share("y", v) - share("n", v)).alias(f"w_{v}") for v in labels]
    )
    bias = texts.agg(
        *[
            F.log((F.count_if(F.col(v)) + 1) / (F.count_if(~F.col(v)) + 1)).alias(f"prior_{v}")
            for v in labels
        ],
        *[F.lit(0.0).alias(f"unseen_{v}") for v in labels],
    )
    return weights, bias


def _evidence(
    chunks: DataFrame,
    weights: DataFrame,
    bias: DataFrame,
    labels: Sequence[str],
    keys: Sequence[str],
    text_col: str,
) -> DataFrame:
    """Prior plus mean word weight of every label, one column ``s_<label>`` each.

    ``weights`` is counted up to the broadcast bound first, so it should be a stored table; with more words
    ``chunks`` are read three times, so they should be one, too.
    """
    keys = list(keys)
    if is_small(weights, MAX_VOCABULARY):
        words = chunks.select(*keys, F.explode_outer(tokens(F.col(text_col))).alias("word"))
        known = words.join(F.broadcast(weights), "word", "left")
        summed = known.groupBy(*keys).agg(
            F.count("word").alias("_words"),
            F.count_if(F.col("word").isNotNull() & F.col(f"w_{labels[0]}").isNull()).alias("_unseen"),
            *[F.sum(f"w_{v}").alias(f"_s_{v}") for v in labels],
        )
    else:
        summed = _block_sums(chunks, weights, labels, keys, text_col)
    base = bias.agg(F.first(F.struct("*")).alias("bias")).scalar()
    n = F.greatest(F.col("_words"), F.lit(1))

    def score(v: str) -> Column:
        total = F.coalesce(f"_s_{v}", F.lit(0.0)) + F.col("_unseen") * F.col(f"_b.unseen_{v}")
        return (F.col(f"_b.prior_{v}") + total / n).alias(f"s_{v}")

    return summed.withColumn("_b", base).select(*keys, *[score(v) for v in labels])


def _block_sums(
    chunks: DataFrame, weights: DataFrame, labels: Sequence[str], keys: Sequence[str], text_col: str
) -> DataFrame:
    """(keys, _words, _unseen, _s_<label>) for more weights than can be broadcast.

    Texts are dealt by a hash into blocks of about BLOCK_CHARS, in one shuffle. Only one row per word and block
    is moved, to its weights and back to the block, not one per word and text. Rows of equal keys are one text.
    """
    keys = list(keys)
    names = [f"w_{v}" for v in labels]
    own = chunks.select(*keys, F.col(text_col).alias("_text"))
    chars = own.agg(F.sum(F.length("_text") + 1)).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    dealt = own.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(n))).repartition("_block")

    def split_words(texts: pa.Table) -> tuple[np.ndarray, pa.Array]:
        text = texts["_text"].combine_chunks().fill_null("").cast(pa.large_string())
        split = pc.split_pattern(text, " ")
        row = np.repeat(np.arange(len(text)), np.diff(split.offsets.to_numpy()))
        word = split.flatten()
        real = pc.greater_equal(pc.utf8_length(word), 2)
        return row[real.to_numpy(zero_copy_only=False)], word.filter(real)

    def distinct(texts: pa.Table) -> pa.Table:
        word = split_words(texts)[1].unique().cast(pa.string())
        return pa.table({"_of": pa.array(np.full(len(word), texts["_block"][0].as_py())), "word": word})

    # A group reads all columns of the texts, as the sums do, so that Spark reuses their shuffle.
    words = dealt.groupBy("_block").applyInArrow(distinct, "_of long, word string")
    known = words.join(weights.select("word", *names), "word")

    def sums(texts: pa.Table, found: pa.Table) -> pa.Table:
        text = texts["_text"]
        row, word = split_words(texts)
        listed = found["word"].combine_chunks().cast(pa.large_string())
        at = pc.index_in(word, value_set=listed).fill_null(-1).to_numpy(zero_copy_only=False)
        count = lambda rows, by=None: np.bincount(rows, by, len(text))
        out = {k: texts[k] for k in keys}
        out |= {"_words": count(row).astype(np.int64), "_unseen": count(row[at < 0]).astype(np.int64)}
        for v, name in zip(labels, names, strict=True):
            out[f"_s_{v}"] = count(row[at >= 0], found[name].to_numpy()[at[at >= 0]]).astype(np.float64)
        return pa.table(out)

    schema = T.StructType([f for f in own.schema if f.name in keys]).add("_words", "long").add("_unseen", "long")
    for v in labels:
        schema = schema.add(f"_s_{v}", "double")
    found = dealt.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(sums, schema)
    return found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in found.columns if c not in keys])


def score_polarity(
    chunks: DataFrame,
    weights: DataFrame,
    bias: DataFrame,
    labels: Sequence[str] = POLARITY_LABELS,
    keys: Sequence[str] = KEY,
    text_col: str = "normalized_text",
) -> DataFrame:
    """Class probabilities ``polarity_<label>`` per chunk, and ``sentiment``."""
    found = _evidence(chunks, weights, bias, labels, keys, text_col)
    peak = F.greatest(*[F.col(f"s_{v}") for v in labels]) if len(labels) > 1 else F.col(f"s_{labels[0]}")
    shifted = {v: F.exp(F.col(f"s_{v}") - peak) for v in labels}
    total = sum(shifted.values(), F.lit(0.0))
    return with_sentiment(found.select(*keys, *[(shifted[v] / total).alias(f"polarity_{v}") for v in labels]))


def score_emotions(
    chunks: DataFrame,
    weights: DataFrame,
    bias: DataFrame,
    labels: Sequence[str],
    keys: Sequence[str] = KEY,
    text_col: str = "normalized_text",
) -> DataFrame:
    """Independent scores ``emotion_<label>`` between 0 and 1 per chunk."""
    found = _evidence(chunks, weights, bias, labels, keys, text_col)
    return found.select(*keys, *[(1 / (1 + F.exp(-F.col(f"s_{v}")))).alias(f"emotion_{v}") for v in labels])


def score_with_model(
    df: DataFrame,
    make_predict_fn: Callable,
    labels: Sequence[str],
    prefix: str,
    text_col: str = "normalized_text",
    batch_size: int = 8,
) -> DataFrame:
    """Scores from a caller's model: ``make_predict_fn()`` loads it once per Python worker and
    returns a function from a batch of texts to a ``len(labels)``-wide matrix of scores."""
    predict = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    scored = df.withColumn("_scores", predict(F.col(text_col)))
    scored = scored.select(
        *df.columns, *[F.col("_scores")[i].alias(f"{prefix}{v}") for i, v in enumerate(labels)]
    )
    return with_sentiment(scored) if prefix == "polarity_" else scored


def with_sentiment(scored: DataFrame) -> DataFrame:
    """Positive minus negative score, if both are there."""
    if {"polarity_positive", "polarity_negative"} <= set(scored.columns):
        return scored.withColumn("sentiment", F.col("polarity_positive") - F.col("polarity_negative"))
    return scored


def label_pivot(
    df: DataFrame, keys: Sequence[str], labels: Sequence[str], prefix: str = "polarity_"
) -> DataFrame:
    """One row per key from rows of (key, label, score); one column per label named up front."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col("label") == v, F.col("score"))).alias(f"{prefix}{v}") for v in labels]
    )


def score_columns(df: DataFrame, anywhere: bool = False) -> list[str]:
    """Score columns by name: with the known prefixes, or with them anywhere in the name."""
    marks = ("polarity_", "emotion_")
    if anywhere:
        return [c for c in df.columns if any(m in c for m in marks)]
    return [c for m in marks for c in df.columns if c.startswith(m)]


def sentiment_by_topic(df: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """Mean of every score column per topic; only the topics if there are no score columns."""
    if topic_col not in df.columns:
        raise ValueError(f"missing column {topic_col}")
    scores = score_columns(df)
    if not scores:
        return distinct_topics(df, topic_col)
    return df.groupBy(topic_col).agg(*[F.avg(c).alias(f"{c}_mean") for c in scores]).orderBy(topic_col)


def distinct_topics(df: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    return df.select(topic_col).distinct()


def sentiment_long(topic_scores: DataFrame, topic_col: str = "topic_id") -> DataFrame | None:
    """Score columns as rows (topic, sentiment, score); nothing if there are none."""
    scores = score_columns(topic_scores, anywhere=True)
    if not scores:
        return None
    return topic_scores.unpivot([topic_col], scores, "sentiment", "score")
