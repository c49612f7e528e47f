"""How topics and their words change over time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.skew import lookup_join
from lectern.operators.terms import COUNT, WEIGHT, grouped, packed_counts, packed_weights, summed_by, unpacked
from lectern.session import cut_lineage


def with_time_bin(df: DataFrame, time_col: str, bins: int = 20, out: str = "bin") -> DataFrame:
    """Add the number of the equal-width time bin, closed on the right, and the bin's left edge.

    Rows without a time have no bin and are left out. If all times are equal there is one bin.
    """
    t = F.col(time_col)
    known = df.where(t.isNotNull())
    ends = known.agg(F.struct(F.min(t).alias("lo"), F.max(t).alias("hi"))).scalar()
    width = F.col("_e.hi") - F.col("_e.lo")
    number = F.when(width == 0, 0).otherwise(
        F.least(F.greatest(F.ceil((t - F.col("_e.lo")) * bins / width) - 1, F.lit(0)), F.lit(bins - 1))
    )
    return (
        known.withColumn("_e", ends)
        .withColumn(out, number.cast("int"))
        .withColumn("bin_start", F.col("_e.lo") + F.col(out) * width / bins)
        .drop("_e")
    )


def topic_frequency(df: DataFrame, time_col: str, bins: int = 20, topic_col: str = "topic_id") -> DataFrame:
    """(topic, bin, bin_start, frequency): rows per topic and time bin."""
    binned = with_time_bin(df, time_col, bins)
    return binned.groupBy(topic_col, "bin").agg(
        F.first("bin_start").alias("bin_start"), F.count("*").alias("frequency")
    )


def topics_over_time(
    chunks: DataFrame,
    weights: DataFrame,
    time_col: str,
    bins: int = 20,
    global_tuning: bool = True,
    evolution_tuning: bool = True,
    n: int = 5,
    stop_words: Sequence[str] | None = None,
    max_n: int = 2,
) -> DataFrame:
    """(topic_id, bin, bin_start, frequency, words): the top words of every topic in every bin.

    ``weights`` is the class TF-IDF of the same chunks. With tuning, word weights are scaled to
    sum 1; the weights of the period before are averaged in where the topic was there in that
    period, then the topic's overall weights. A period is a bin that has any chunks. A (topic,
    term) pair has at most ``bins`` entries, so the running average is one row-local fold.
    """
    binned = with_time_bin(chunks, time_col, bins)
    frequency = cut_lineage(
        binned.groupBy("topic_id", "bin").agg(F.first("bin_start").alias("bin_start"), F.count("*").alias("frequency"))
    )
    # At most ``bins`` rows are ranked here.
    periods = frequency.select("bin").distinct().withColumn(
        "period", (F.row_number().over(Window.orderBy("bin")) - 1).cast("int")
    )
    tuned = global_tuning or evolution_tuning
    # Terms are counted before they move, and meet their weights by bucket, packed. One row per (topic, term),
    # written once. A topic's overall words count in every period, also those not said in any chunk of it.
    topic = chunks.schema["topic_id"].dataType
    said = packed_counts(binned.join(F.broadcast(periods), "bin"), ["topic_id", "period"], stop_words, max_n)
    known = packed_weights(weights.withColumn("topic_id", F.col("topic_id").cast(topic)))
    schema = T.StructType().add("topic_id", topic).add("term", "string").add("_score", "double")
    schema = schema.add("_at", T.ArrayType(T.IntegerType())).add("_w", T.ArrayType(T.DoubleType())).add("_tf", T.ArrayType(T.LongType()))
    per_term = cut_lineage(
        said.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_by_period(bins, global_tuning), schema)
    )
    parts = F.arrays_zip(F.col("_at").alias("period"), F.col("_w" if tuned else "_tf").alias("part"))
    sums = per_term.select("topic_id", F.inline(parts)).groupBy("topic_id", "period").agg(F.sum("part").alias("total"))
    totals = (
        frequency.join(F.broadcast(periods), "bin")
        .join(sums, ["topic_id", "period"], "left")
        .select("topic_id", "period", F.coalesce("total", F.lit(0.0)).alias("total"))
    )
    present = totals.groupBy("topic_id").agg(
        F.array_sort(F.collect_list(F.struct("period", "total"))).alias("_present")
    )
    overall = weights.groupBy("topic_id").agg(F.sum("score").alias("_sum"))
    per_topic = cut_lineage(present.join(overall, "topic_id"))
    rows = lookup_join(per_term, per_topic, ["topic_id"], ["term"], "inner").select(
        F.col("topic_id").cast("bigint").alias("topic_id"),
        "term",
        (F.col("_score") / F.col("_sum")).alias("g"),
        "_at",
        "_w",
        F.col("_present.period").alias("_periods"),
        F.col("_present.total").alias("_totals"),
    )
    best = _best_terms(bins, n, global_tuning, evolution_tuning)
    candidates = rows.mapInArrow(best, "topic_id bigint, period int, term string, x double")
    order = Window.partitionBy("topic_id", "period").orderBy(F.desc(F.round("x", 12)), "term")
    words = (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .groupBy(F.col("topic_id").cast("int").alias("topic_id"), "period")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
        .select("topic_id", "period", F.array_join(F.transform("_t", lambda t: t["term"]), ", ").alias("words"))
    )
    return (
        frequency.join(F.broadcast(periods), "bin")
        .join(words, ["topic_id", "period"], "left")
        .select("topic_id", "bin", "bin_start", "frequency", F.coalesce("words", F.lit("")).alias("words"))
    )


def _by_period(bins: int, silent: bool):
    """Arrow function: of one bucket, the terms of each topic that have a weight, with the periods in which they
    were said; with ``silent`` also those never said."""

    def joined(said: pa.Table, weights: pa.Table) -> pa.Table:
        terms, (topics,), (idf, score) = unpacked(weights, ["topic_id"], WEIGHT)
        topic, listed = grouped([topics])
        coded = terms.dictionary_encode()
        n = max(len(listed[0]), 1)
        key = coded.indices.to_numpy().astype(np.int64) * n + topic
        order = np.argsort(key)
        key = key[order]

        words, (of, period), (times,) = unpacked(said, ["topic_id", "period"], COUNT)
        place = lambda some, among: pc.index_in(some, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        term, of = place(words, coded.dictionary), place(of, listed[0])
        sought = np.where((term >= 0) & (of >= 0), term * n + of, -1)
        row = np.searchsorted(key, sought)
        found = np.append(key, -2)[row] == sought
        cell, tf = summed_by(row[found] * bins + period.to_numpy()[found], times[found])
        row, period = np.divmod(cell, bins)

        many = np.bincount(row, minlength=len(key))
        some = np.arange(len(key)) if silent else np.flatnonzero(many)
        edge = pa.array(np.append(0, np.cumsum(many[some])), pa.int32())
        weight = tf * idf[order[row]]
        lists = (pa.ListArray.from_arrays(edge, pa.array(x)) for x in (period.astype(np.int32), weight, tf.astype(np.int64)))
        own = pa.array(order[some])
        cells = [topics.take(own), terms.take(own).cast(pa.string()), pa.array(score[order[some]]), *lists]
        return pa.table(cells, names=["topic_id", "term", "_score", "_at", "_w", "_tf"])

    return joined


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of every row in its group, from 0; the rows of a group stand together."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def _nth(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For every row the ``n``-th largest value of its group, or the smallest of fewer."""
    order = np.lexsort((-values, groups))
    groups = groups[order]
    last = np.flatnonzero(np.r_[groups[1:] != groups[:-1], True])
    size = np.diff(np.r_[-1, last])
    cut = values[order][last - size + np.minimum(size, n)]
    out = np.empty(len(values))
    out[order] = np.repeat(cut, size)
    return out


def _best_terms(bins: int, n: int, global_tuning: bool, evolution_tuning: bool):
    """Arrow function: the tuned weight of every term in every period, of which the ``n`` best per
    topic and period of each batch are emitted; the rest could not be among the best of all."""

    def spread(values: pa.Array, at: pa.Array) -> np.ndarray:
        """Values as a matrix of rows by periods, each value at its period."""
        out = np.zeros((len(at), bins))
        size = pc.fill_null(pc.list_value_length(at), 0).to_numpy()
        out[np.repeat(np.arange(len(at)), size), at.flatten().to_numpy()] = values.to_numpy()
        return out

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = batch.column("topic_id").to_numpy()
            term = batch.column("term")
            g = batch.column("g").to_numpy()
            said = spread(batch.column("_w").flatten(), batch.column("_at"))
            total = spread(batch.column("_totals").flatten(), batch.column("_periods"))
            there = spread(pc.add(batch.column("_periods").flatten(), 1), batch.column("_periods")) > 0
            x = np.zeros(len(topic))
            for period in range(bins):
                here = there[:, period]
                now = np.divide(said[:, period], total[:, period], out=np.zeros(len(topic)), where=total[:, period] > 0)
                if evolution_tuning and period:
                    now = np.where(there[:, period - 1], (now + x) / 2, now)
                if global_tuning:
                    now = (now + g) / 2
                x = np.where(here, now, 0.0)
                some = np.flatnonzero(x > 0)
                if not len(some):
                    continue
                # Numbers alone show what is at least as good as the nth; the few such rows are put in order by term.
                value = np.round(x[some], 12)
                some = some[value >= _nth(topic[some], value, n)]
                words = term.take(pa.array(some)).to_numpy(zero_copy_only=False)
                order = some[np.lexsort((words, -np.round(x[some], 12), topic[some]))]
                top = order[_places(topic[order]) < n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(topic[top]),
                        pa.array(np.full(len(top), period, dtype="int32")),
                        term.take(pa.array(top)).cast(pa.string()),
                        pa.array(x[top]),
                    ],
                    names=["topic_id", "period", "term", "x"],
                )

    return best
