"""Topic coherence: how well the top words of a topic go together in the texts.

Texts are chunks, so a text is never long. ``keywords`` is the result of ``topic_keywords``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import OUTLIER_TOPIC
from lectern.functions.text import tokens
from lectern.session import cut_lineage

EPSILON = 1e-12
MAX_TOP_WORDS = 200_000


def pair_counts(
    chunks: DataFrame, top: DataFrame, size: int | None, text_col: str = "normalized_text"
) -> DataFrame:
    """(word_i, word_j, n): in how many sliding windows two top words of one topic occur together.

    ``size`` is the window length in words, ``None`` takes each chunk as one window; a chunk
    shorter than a window is one window. ``word_i = word_j`` counts the windows of a single word.
    Every task counts its chunks against the broadcast word pairs and emits one row per pair, so
    no text is shuffled. Word lists above the broadcast bound are taken in slices of topics.
    """
    slices = -(-top.count() // MAX_TOP_WORDS) or 1
    found = None
    for part in range(slices):
        mine = top if slices == 1 else top.where(F.pmod(F.xxhash64("topic_id"), F.lit(slices)) == part)
        counted = _pair_counts_of(chunks, mine, size, text_col)
        found = counted if found is None else found.unionByName(counted)
    return found.groupBy("word_i", "word_j").agg(
        F.max("n").alias("n") if slices > 1 else F.sum("n").alias("n")
    )


def _pair_counts_of(chunks: DataFrame, top: DataFrame, size: int | None, text_col: str) -> DataFrame:
    listed = top.select("topic_id", "word").toPandas()
    words = np.array(sorted(set(listed["word"])), dtype=object)
    n_words = max(len(words), 1)
    listed["code"] = np.searchsorted(words, listed["word"].to_numpy()) if len(words) else []
    pairs = listed.merge(listed, on="topic_id", suffixes=("_i", "_j"))
    wanted = np.unique(pairs["code_i"].to_numpy(dtype="int64") * n_words + pairs["code_j"].to_numpy(dtype="int64"))
    given = chunks.sparkSession.sparkContext.broadcast((words, wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes = given.value
        vocabulary = pa.array(names, pa.string())
        sums = np.zeros(len(codes), dtype="int64")
        for batch in batches:
            column = batch.column("_words")
            found = pc.fill_null(pc.index_in(column.flatten(), value_set=vocabulary), -1).to_numpy()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
            for begin, end in zip(np.concatenate(([0], ends[:-1])), ends):
                inside = found[begin:end]
                at = np.flatnonzero(inside >= 0)
                if not len(at):
                    continue
                present, row = np.unique(inside[at], return_inverse=True)
                together = _windows_together(row, at, len(present), end - begin, size)
                code = (present[:, None].astype("int64") * len(names) + present[None, :]).ravel()
                slot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[slot] == code
                sums[slot[hit]] += together.ravel()[hit]
        some = np.flatnonzero(sums)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[codes[some] // len(names)], pa.string()),
                    pa.array(names[codes[some] % len(names)], pa.string()),
                    pa.array(sums[some]),
                ],
                names=["word_i", "word_j", "n"],
            )

    counted = chunks.select(tokens(F.col(text_col)).alias("_words")).mapInArrow(
        count, "word_i string, word_j string, n bigint"
    )
    return counted.groupBy("word_i", "word_j").agg(F.sum("n").alias("n"))


def _windows_together(row: np.ndarray, at: np.ndarray, n_rows: int, n_tokens: int, size: int | None) -> np.ndarray:
    """Windows shared by every two words of one text; word ``row[i]`` stands at position ``at[i]``."""
    if size is None or n_tokens <= size:
        return np.ones((n_rows, n_rows), dtype="int64")
    windows = n_tokens - size + 1
    edges = np.zeros((n_rows, windows + 1))
    np.add.at(edges, (row, np.maximum(at - size + 1, 0)), 1)
    np.add.at(edges, (row, np.minimum(at, windows - 1) + 1), -1)
    held = (np.cumsum(edges, axis=1)[:, :windows] > 0).astype("float64")
    return (held @ held.T).astype("int64")


def _top_words(keywords: DataFrame) -> DataFrame:
    """Top words per topic: a few rows per topic, made final so that every use reads the same."""
    return cut_lineage(keywords.where(F.col("topic_id") != OUTLIER_TOPIC).select("topic_id", "rank", "word"))


def _counted_pairs(chunks: DataFrame, top: DataFrame, size: int | None, same: bool, text_col: str) -> DataFrame:
    """(topic_id, word_i, word_j, n_i, n_j, n_ij): word i ranked before word j, or all ordered pairs."""
    counts = cut_lineage(pair_counts(chunks, top, size, text_col))
    i = top.select("topic_id", F.col("rank").alias("rank_i"), F.col("word").alias("word_i"))
    j = top.select("topic_id", F.col("rank").alias("rank_j"), F.col("word").alias("word_j"))
    pairs = i.join(j, "topic_id")
    pairs = pairs if same else pairs.where("rank_i < rank_j")
    single = counts.where("word_i = word_j")
    return (
        pairs.join(single.select("word_i", F.col("n").alias("n_i")), "word_i", "left")
        .join(single.select("word_j", F.col("n").alias("n_j")), "word_j", "left")
        .join(counts.withColumnRenamed("n", "n_ij"), ["word_i", "word_j"], "left")
        .na.fill(0, ["n_i", "n_j", "n_ij"])
    )


def coherence_umass(chunks: DataFrame, keywords: DataFrame, text_col: str = "normalized_text") -> DataFrame:
    """Mean over word pairs of ``ln((D(wi, wj) + 1) / D(wi))``, wi the higher ranked word."""
    pairs = _counted_pairs(chunks, _top_words(keywords), None, False, text_col)
    ratio = F.log((F.col("n_ij") + 1) / F.greatest(F.col("n_i"), F.lit(1)))
    return pairs.groupBy("topic_id").agg(F.avg(ratio).alias("u_mass"))


def _total_windows(chunks: DataFrame, size: int, text_col: str) -> Column:
    n = F.size(tokens(F.col(text_col)))
    return chunks.where(n > 0).agg(F.sum(F.greatest(n - (size - 1), F.lit(1)))).scalar()


def _npmi(pairs: DataFrame, total: Column) -> DataFrame:
    together = F.col("n_ij") / F.col("_all") + EPSILON
    apart = (F.col("n_i") / F.col("_all")) * (F.col("n_j") / F.col("_all"))
    value = F.when(apart == 0, 0.0).otherwise(F.log(together / apart) / -F.log(together))
    return pairs.withColumn("_all", total).select("topic_id", "word_i", "word_j", value.alias("npmi"))


def coherence_npmi(
    chunks: DataFrame, keywords: DataFrame, size: int = 10, text_col: str = "normalized_text"
) -> DataFrame:
    """Mean normalised pointwise mutual information of word pairs in sliding windows."""
    pairs = _counted_pairs(chunks, _top_words(keywords), size, False, text_col)
    scored = _npmi(pairs, _total_windows(chunks, size, text_col))
    return scored.groupBy("topic_id").agg(F.avg("npmi").alias("c_npmi"))


def coherence_cv(
    chunks: DataFrame, keywords: DataFrame, size: int = 110, text_col: str = "normalized_text"
) -> DataFrame:
    """Mean cosine between each word's vector of NPMI values and the sum of these vectors."""
    pairs = _counted_pairs(chunks, _top_words(keywords), size, True, text_col)
    vectors = _npmi(pairs, _total_windows(chunks, size, text_col))
    sums = vectors.groupBy("topic_id", "word_j").agg(F.sum("npmi").alias("s"))
    lengths = F.col("_a") * F.col("_b")
    return (
        vectors.join(sums, ["topic_id", "word_j"])
        .groupBy("topic_id", "word_i")
        .agg(
            F.sum(F.col("npmi") * F.col("s")).alias("_dot"),
            F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))).alias("_a"),
            F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("_b"),
        )
        .groupBy("topic_id")
        .agg(F.avg(F.when(lengths == 0, 0.0).otherwise(F.col("_dot") / lengths)).alias("c_v"))
    )
