"""Topic words: term counts per topic, class TF-IDF and what is built from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import OUTLIER_TOPIC
from lectern.functions.text import tokens
from lectern.operators.skew import lookup_join
from lectern.session import cut_lineage

KEY = ("video_id", "chunk_id")
#: So much text of a topic gets the weights of its terms at once: it bounds memory, not the result.
SLICE_CHARS = 8 << 20
#: Bytes of words that a task counts at once.
COUNTED_BYTES = 32 << 20
#: Terms are dealt by their letters over so many buckets for each shuffle partition; a task holds one bucket at a time.
BUCKETS = 4
#: Rows that are packed at once.
PACKED_ROWS = 1 << 20


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def words_of(text: Column, stop_words: Sequence[str]) -> Column:
    """Words of two or more letters without stop words."""
    return F.filter(tokens(text), lambda w: ~w.isin(list(stop_words)))


def with_pairs(words: Column) -> Column:
    """The words and the pairs of neighbours among them."""
    # The last word has no right neighbour; its pair is null and is dropped.
    pairs = F.zip_with(words, F.slice(words, 2, 2_000_000_000), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(F.concat(words, pairs), lambda t: t.isNotNull())


def explode_terms(
    df: DataFrame,
    keep: Sequence[str],
    stop_words: Sequence[str] | None = None,
    max_n: int = 2,
    text_col: str = "normalized_text",
) -> DataFrame:
    stop_words = english_stop_words() if stop_words is None else stop_words
    words = df.select(*keep, words_of(F.col(text_col), stop_words).alias("_words"))
    terms = F.col("_words") if max_n == 1 else with_pairs(F.col("_words"))
    return words.select(*keep, F.explode(terms).alias("term"))


def term_counts(
    df: DataFrame,
    min_df: int = 2,
    stop_words: Sequence[str] | None = None,
    max_n: int = 2,
    text_col: str = "normalized_text",
) -> DataFrame:
    """(topic_id, term, tf, topics, total) for terms found in at least ``min_df`` topics.

    Tasks count the terms of COUNTED_BYTES of text at a time, by numbers of their words, and only distinct
    terms become strings, so a topic with a third of all chunks costs no more than its distinct terms. What
    they count moves once, packed by bucket (see :func:`packed`): a bucket holds all rows of its terms, so
    sums per topic, ``topics`` and ``total`` all come from that one shuffle.
    """
    schema = T.StructType([df.schema["topic_id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    schema = schema.add("topics", "long").add("total", "long")

    def summed(parts: pa.Table) -> pa.Table:
        terms, (topics,), (n,) = unpacked(parts, ["topic_id"], COUNT)
        topic, listed = grouped([topics])
        distinct, term = in_order(terms)
        key, tf = summed_by(term * len(listed[0]) + topic, n)
        term, topic = np.divmod(key, max(len(listed[0]), 1))
        many = np.bincount(term, minlength=len(distinct))
        total = np.bincount(term, tf, len(distinct)).astype(np.int64)
        some = np.flatnonzero(many[term] >= min_df)
        term = term[some]
        cells = [listed[0].take(pa.array(topic[some])), distinct.take(pa.array(term)).cast(pa.string())]
        return pa.table([*cells, *map(pa.array, (tf[some], many[term], total[term]))], names=schema.names)

    parts = packed_counts(df, ["topic_id"], stop_words, max_n, text_col)
    return parts.groupBy("bucket").applyInArrow(summed, schema)


#: The values of packed counts: how many times a term was found.
COUNT = {"n": "<i8"}
#: Those of packed weights.
WEIGHT = {"idf": "<f8", "score": "<f8"}


def packed_counts(df: DataFrame, by: Sequence[str], stop_words: Sequence[str] | None, max_n: int, text_col: str = "normalized_text") -> DataFrame:
    """Packed rows of (``by``, term, n) by what each task counted; a term may have several rows of equal ``by``."""
    stop_words = english_stop_words() if stop_words is None else stop_words
    texts = df.select(*by, F.col(text_col).alias("_text"))
    count, pack = _counted(list(stop_words), max_n, by), _packing(by, COUNT, _buckets(df))
    return texts.mapInArrow(lambda batches: pack(count(batches)), _packed_schema(df, by))


def packed_weights(weights: DataFrame) -> DataFrame:
    """Packed rows of (topic_id, term, idf, score)."""
    rows = weights.where("topic_id is not null").select("topic_id", "term", *WEIGHT)
    return rows.mapInArrow(_packing(["topic_id"], WEIGHT, _buckets(weights)), _packed_schema(weights, ["topic_id"]))


def _buckets(df: DataFrame) -> int:
    return BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _packed_schema(df: DataFrame, by: Sequence[str]) -> T.StructType:
    schema = T.StructType().add("bucket", "integer").add("rows", "integer").add("size", "long").add("cells", "binary")
    for name in by:
        schema = schema.add(name, T.ArrayType(df.schema[name].dataType))
    return schema


def _packing(by: Sequence[str], values: dict[str, str], n: int):
    """Arrow function: rows of (``by``, term, ``values``) as :func:`packed` ones, PACKED_ROWS or more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= PACKED_ROWS:
                yield packed(held, by, values, n)[0]
                held = []
        if held:
            yield packed(held, by, values, n)[0]

    return run


def _zipped(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def packed(held: Sequence[pa.RecordBatch], by: Sequence[str], values: dict[str, str], n: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row for each of ``n`` buckets with all its rows in it, compressed; and the order in which they are.

    A bucket has the terms of some letters. ``cells`` holds, for ``rows`` rows, the place of their ``by`` among
    those listed, the lengths of their terms, ``values`` and the letters of the terms: ``size`` bytes.
    """
    column = lambda name: pa.concat_arrays([batch[name] for batch in held])
    offsets, letters = _letters(column("term"))
    bucket = _bucket_of(offsets, letters, n)
    order = np.argsort(bucket, kind="stable")
    at, listed = grouped([column(name) for name in by]) if by else (np.zeros(len(order), np.int64), [])
    at, length = at[order], np.diff(offsets)[order].astype("<i4")
    own = [column(name).to_numpy(zero_copy_only=False).astype(kind)[order] for name, kind in values.items()]
    first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
    sizes, cells, kept = [], [], []
    for lo, hi in zip(first, [*first[1:], len(order)], strict=True):
        some, place = np.unique(at[lo:hi], return_inverse=True)
        kept.append(some)
        text = letters[ranges(offsets[order[lo:hi]], length[lo:hi])]
        parts = [place.astype("<i4"), length[lo:hi], *(x[lo:hi] for x in own), text]
        data = b"".join(x.tobytes() for x in parts)
        sizes.append(len(data))
        cells.append(_zipped(data))
    edge = np.cumsum([0, *map(len, kept)])
    taken = pa.array(np.concatenate(kept))
    lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), x.take(taken)) for x in listed]
    rows = pa.array(np.diff([*first, len(order)]), pa.int32())
    columns = [pa.array(bucket[order[first]], pa.int32()), rows, pa.array(sizes, pa.int64()), pa.array(cells, pa.binary()), *lists]
    return pa.record_batch(columns, names=["bucket", "rows", "size", "cells", *by]), order


def unpacked(table: pa.Table, by: Sequence[str], values: dict[str, str]) -> tuple[pa.Array, list[pa.Array], list[np.ndarray]]:
    """(term, ``by``, ``values``) of all rows in packed ones."""
    kinds = ["<i4", "<i4", *values.values()]
    found: list[list[np.ndarray]] = [[np.empty(0, kind)] for kind in [*kinds, "u1"]]
    begin = 0
    lists = {name: _whole(table[name]) for name in by}
    listed = np.diff(next(iter(lists.values())).offsets.to_numpy()) if by else np.zeros(len(table), np.int64)
    for rows, size, cells, own in zip(*(table[x].to_pylist() for x in ("rows", "size", "cells")), listed, strict=True):
        data, at = pa.decompress(cells, size, codec="zstd"), 0
        for out, kind in zip(found, kinds, strict=False):
            out.append(np.frombuffer(data, kind, rows, at))
            at += out[-1].nbytes
        found[0][-1] = found[0][-1] + begin
        begin += own
        found[-1].append(np.frombuffer(data, "u1", offset=at))
    place, length, *own, letters = map(np.concatenate, found)
    edge = np.append(0, np.cumsum(length, dtype=np.int64))
    buffers = [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(letters)]
    terms = pa.Array.from_buffers(pa.large_string(), len(length), buffers)
    return terms, [x.flatten().take(pa.array(place)) for x in lists.values()], own


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def grouped(columns: Sequence[pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """(number of the group of each row, the cells of each group by column)."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        coded = column.dictionary_encode("encode")
        code = code * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, [column.take(pa.array(first)) for column in columns]


def in_order(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct terms in order, number of each term among them)."""
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def summed_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of ``n`` of each)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _letters(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of terms."""
    terms = pa.concat_arrays([terms.cast(pa.large_string())])
    _, offsets, data = terms.buffers()
    offsets = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    letters = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets - offsets[0], letters[offsets[0] : offsets[-1]]


def _bucket_of(offsets: np.ndarray, letters: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each term, by its letters alone; some terms at a time."""
    out = np.empty(len(offsets) - 1, np.int32)
    for lo, hi in _runs(offsets[1:], 1 << 20):
        own = offsets[lo : hi + 1] - offsets[lo]
        size = np.diff(own)
        power = np.cumprod(np.full(max(int(size.max()), 1), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(own[-1]) - np.repeat(own[:-1], size)
        value = (letters[offsets[lo] : offsets[hi]].astype(np.uint64) + np.uint64(1)) * power[place]
        upto = np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64))
        h = upto[own[1:]] - upto[own[:-1]]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        out[lo:hi] = (h % np.uint64(n)).astype(np.int32)
    return out


def _counted(stop_words: Sequence[str], max_n: int, by: Sequence[str] = ("topic_id",)):
    """Arrow function: (``by``, term, n) of the words, and of neighbours among them, of some texts at a time."""
    stops = pa.array(stop_words, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[pa.Array], pa.Array, np.ndarray]] = []
        size = 0
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch["_text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for lo, hi in _runs(upto, COUNTED_BYTES // 4):
                words, row = _split_words(batch["_text"].slice(lo, hi - lo), stops)
                # A copy, as the whole batch is one piece of memory.
                held.append(([batch[x].take(pa.array(np.arange(lo, hi))) for x in by], words, row))
                size += words.nbytes
                if size > COUNTED_BYTES:
                    yield from _summed(held, max_n, by)
                    held, size = [], 0
        if held:
            yield from _summed(held, max_n, by)

    return run


def _split_words(texts: pa.Array, stops: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words as in :func:`words_of`, the row of each)."""
    split = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
    words = split.flatten()
    row = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    kept = pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, value_set=stops)))
    return words.filter(kept), row[kept.to_numpy(zero_copy_only=False)]


def _summed(held: list[tuple[list[pa.Array], pa.Array, np.ndarray]], max_n: int, by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    # Numbers of words follow their order, so that what is counted lies in order, too.
    listed, word = in_order(pa.concat_arrays([words for _, words, _ in held]))
    group, cells = grouped([pa.concat_arrays(x) for x in zip(*(own for own, _, _ in held), strict=True)])
    firsts = np.cumsum([0, *(len(own[0]) for own, _, _ in held)])
    row = np.concatenate([row + first for (_, _, row), first in zip(held, firsts, strict=False)])
    n = max(len(listed), 1)

    def rows(of: np.ndarray, terms: pa.Array, times: np.ndarray) -> pa.RecordBatch:
        columns = [*(x.take(pa.array(of)) for x in cells), terms.cast(pa.string()), pa.array(times)]
        return pa.record_batch(columns, names=[*by, "term", "n"])

    key, times = np.unique(group[row] * n + word, return_counts=True)
    if len(key):
        yield rows(key // n, listed.take(pa.array(key % n)), times)
    if max_n < 2:
        return
    near = np.flatnonzero(row[1:] == row[:-1])
    # Groups one at a time: the number of a pair is that of two words.
    order = np.argsort(group[row[near]], kind="stable")
    for part in np.split(near[order], np.flatnonzero(np.diff(group[row[near[order]]])) + 1):
        if len(part):
            key, times = np.unique(word[part] * n + word[part + 1], return_counts=True)
            left, right = (listed.take(pa.array(x)) for x in np.divmod(key, n))
            terms = pc.binary_join_element_wise(left, right, pa.scalar(" ", pa.large_string()))
            yield rows(np.full(len(key), group[row[part[0]]]), terms, times)


def ctfidf(counts: DataFrame) -> DataFrame:
    """Class TF-IDF: ``tf / n(topic) * ln(1 + A / total)`` with A the mean terms per topic, floored.

    The counts, far fewer than the words they come from, are written first: sizes, mean and
    weights then read them instead of counting again, and the number of topics can be checked.
    """
    counts = cut_lineage(counts)
    sizes = cut_lineage(counts.groupBy("topic_id").agg(F.sum("tf").alias("topic_terms")))
    mean = sizes.agg(F.floor(F.avg("topic_terms")).alias("mean")).scalar()
    return lookup_join(counts, sizes, ["topic_id"], ["term"], "inner").select(
        "topic_id",
        "term",
        "tf",
        "total",
        F.log(1 + mean / F.col("total")).alias("idf"),
        (F.col("tf") / F.col("topic_terms") * F.log(1 + mean / F.col("total"))).alias("score"),
    )


def topic_keywords(weights: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best words of every topic, ranked from 1; equal scores by word."""
    best = Window.partitionBy("topic_id").orderBy(F.desc(F.round("score", 12)), "term")
    return (
        weights.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select("topic_id", "rank", F.col("term").alias("word"), "score")
    )


def topic_info(chunks: DataFrame, keywords: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Topic, Count, Name, Representation and Representative_Docs; outliers are topic -1.

    ``docs`` is the result of ``representative_docs``.
    """
    sizes = chunks.groupBy("topic_id").agg(F.count("*").alias("Count"))
    words = keywords.groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: w["word"]).alias("Representation")
    )
    info = sizes.join(words, "topic_id", "left").withColumn(
        "Representation", F.coalesce("Representation", F.array().cast("array<string>"))
    )
    if docs is None:
        info = info.withColumn("Representative_Docs", F.array().cast("array<string>"))
    else:
        texts = docs.groupBy("topic_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "normalized_text"))), lambda t: t["normalized_text"]).alias(
                "Representative_Docs"
            )
        )
        info = info.join(texts, "topic_id", "left").withColumn(
            "Representative_Docs", F.coalesce("Representative_Docs", F.array().cast("array<string>"))
        )
    name = F.concat_ws("_", F.col("topic_id").cast("string"), F.slice("Representation", 1, 4))
    return info.select(
        F.col("topic_id").alias("Topic"), "Count", name.alias("Name"), "Representation", "Representative_Docs"
    )


def topic_names(info: DataFrame) -> DataFrame:
    return info.select(F.col("Topic").alias("topic_id"), F.col("Name").alias("name"))


def representative_docs(
    chunks: DataFrame,
    weights: DataFrame,
    n: int = 3,
    stop_words: Sequence[str] | None = None,
    keys: Sequence[str] = KEY,
    max_n: int = 2,
) -> DataFrame:
    """The ``n`` chunks of every topic whose term vector is closest to the topic's, ranked from 1.

    The chunks of a topic are dealt over slices of about SLICE_CHARS. A slice asks for the weights of its own
    terms, each once and packed by bucket (see :func:`packed`); a bucket sends back two numbers for each of
    them, in the same order. The texts are shuffled once. ``chunks`` are read three times and should be a
    stored table.
    """
    keys = list(keys)
    stops = english_stop_words() if stop_words is None else list(stop_words)
    lengths = cut_lineage(
        weights.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    )
    slices = chunks.groupBy("topic_id").agg(F.ceil(F.sum(F.length("normalized_text") + 1) / SLICE_CHARS).alias("_slices"))
    sliced = lookup_join(chunks.select(*keys, "topic_id", "normalized_text"), cut_lineage(slices), ["topic_id"], keys, "inner")
    dealt = sliced.select(
        *keys,
        "topic_id",
        F.pmod(F.xxhash64(*keys), F.greatest("_slices", F.lit(1))).alias("_slice"),
        F.col("normalized_text").alias("_text"),
    ).repartition("topic_id", "_slice")
    of = {"_topic": dealt.schema["topic_id"].dataType, "_of": T.LongType()}
    packed_by = _packed_schema(dealt, [])
    packed_by, answer = (T.StructType([T.StructField(k, v) for k, v in of.items()] + some) for some in (packed_by.fields, packed_by.fields[:1] + packed_by.fields[3:]))
    # A group reads all columns of the texts, as the products do, so that Spark reuses their shuffle.
    asked = dealt.groupBy("topic_id", "_slice").applyInArrow(_asking(stops, max_n, _buckets(chunks)), packed_by)
    known = packed_weights(weights.withColumn("topic_id", F.col("topic_id").cast(of["_topic"])))
    told = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_told, answer)
    schema = T.StructType([f for f in dealt.schema if f.name in [*keys, "topic_id"]]).add("_dot", "double").add("_norm", "double")
    per_doc = (
        dealt.groupBy("topic_id", "_slice")
        .cogroup(told.groupBy("_topic", "_of"))
        .applyInArrow(_term_products([f.name for f in schema][:-2], stops, max_n, _buckets(chunks)), schema)
    )
    close = lookup_join(per_doc, lengths, ["topic_id"], keys, "inner").select(
        *keys, "topic_id", (F.col("_dot") / (F.col("_norm") * F.col("norm"))).alias("similarity")
    )
    best = Window.partitionBy("topic_id").orderBy(F.desc(F.round("similarity", 9)), *keys)
    top = close.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    # A few rows per topic: made final here, so that their number can be checked before the texts move.
    top = cut_lineage(top)
    return lookup_join(chunks.select(*keys, "normalized_text"), top, keys, keys, "inner").select(
        "topic_id", "rank", *keys, "similarity", "normalized_text"
    )


def _distinct_terms(texts: pa.Array, stops: Sequence[str], max_n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, the row of each term of the texts, its number among the distinct ones)."""
    words, row = _split_words(texts, pa.array(stops, pa.large_string()))
    listed, word = in_order(words)
    n = len(listed)
    if max_n < 2 or not n:
        return listed, row, word
    near = row[1:] == row[:-1]
    key, pair = np.unique(word[:-1][near] * n + word[1:][near], return_inverse=True)
    left, right = (listed.take(pa.array(x)) for x in np.divmod(key, n))
    pairs = pc.binary_join_element_wise(left, right, pa.scalar(" ", pa.large_string()))
    return pa.concat_arrays([listed, pairs]), np.concatenate([row, row[1:][near]]), np.concatenate([word, n + pair])


def _asking(stops: Sequence[str], max_n: int, n: int):
    """Arrow function: the distinct terms of a slice, packed."""

    def asked(texts: pa.Table) -> pa.Table:
        terms = _distinct_terms(_whole(texts["_text"]), stops, max_n)[0]
        rows = packed([pa.record_batch([terms], names=["term"])], [], {}, n)[0] if len(terms) else None
        of = {"_topic": _whole(texts["topic_id"]), "_of": _whole(texts["_slice"])}
        names = ["bucket", "rows", "size", "cells"]
        if rows is None:
            return pa.table({k: v[:0] for k, v in of.items()} | {k: pa.array([], t) for k, t in zip(names, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)})
        first = pa.array(np.zeros(len(rows), np.int64))
        return pa.table({k: v.take(first) for k, v in of.items()} | {k: rows[k] for k in names})

    return asked


def _told(asked: pa.Table, weights: pa.Table) -> pa.Table:
    """Of one bucket: idf and score of the terms that each slice asked for, in its order; none where not known."""
    terms, (topics,), (idf, score) = unpacked(weights, ["topic_id"], WEIGHT)
    topic, listed = grouped([topics])
    coded = terms.dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * max(len(listed[0]), 1) + topic
    order = np.argsort(key)
    key, idf, score = key[order], np.append(idf[order], np.nan), np.append(score[order], np.nan)
    wanted = unpacked(asked, [], {})[0]
    rows = asked["rows"].to_numpy()
    term = pc.index_in(wanted, value_set=coded.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
    own = pc.index_in(_whole(asked["_topic"]), value_set=listed[0]).fill_null(-1).to_numpy(zero_copy_only=False)
    own = np.repeat(own, rows)
    sought = np.where((term >= 0) & (own >= 0), term.astype(np.int64) * max(len(listed[0]), 1) + own, -1)
    at = np.searchsorted(key, sought)
    at = np.where(np.append(key, -2)[at] == sought, at, len(key))
    edge = np.append(0, np.cumsum(rows))
    cells = [
        _zipped(idf[at[lo:hi]].tobytes() + score[at[lo:hi]].tobytes())
        for lo, hi in zip(edge[:-1], edge[1:], strict=True)
    ]
    return pa.table([*(asked[x] for x in ("_topic", "_of", "bucket")), pa.array(cells, pa.binary())], names=["_topic", "_of", "bucket", "cells"])


def _term_products(kept: Sequence[str], stops: Sequence[str], max_n: int, n: int):
    """Arrow function: product with the topic and length of each text of a slice that has a known term."""

    def products(texts: pa.Table, told: pa.Table) -> pa.Table:
        terms, row, term = _distinct_terms(_whole(texts["_text"]), stops, max_n)
        idf, score = np.full(len(terms), np.nan), np.full(len(terms), np.nan)
        # The places of a bucket, in the order in which its terms were packed.
        bucket = _bucket_of(*_letters(terms), n)
        order = np.argsort(bucket, kind="stable")
        first, last = (np.searchsorted(bucket[order], told["bucket"].to_numpy(), side) for side in ("left", "right"))
        for lo, hi, cells in zip(first, last, told["cells"].to_pylist(), strict=True):
            both = np.frombuffer(pa.decompress(cells, 16 * (hi - lo), codec="zstd"), "<f8")
            idf[order[lo:hi]], score[order[lo:hi]] = both[: hi - lo], both[hi - lo :]
        known = ~np.isnan(idf[term])
        key, times = np.unique(row[known] * max(len(terms), 1) + term[known], return_counts=True)
        row, term = np.divmod(key, max(len(terms), 1))
        weight = times * idf[term]
        sums = lambda x: np.bincount(row, x, len(texts)).astype(np.float64)
        out = {k: texts[k] for k in kept}
        out |= {"_dot": sums(weight * score[term]), "_norm": np.sqrt(sums(weight * weight))}
        return pa.table(out).filter(pa.array(np.bincount(row, minlength=len(texts)) > 0))

    return products


def topic_diversity(keywords: DataFrame) -> DataFrame:
    """Share of distinct words among the top words of all topics without the outliers."""
    return keywords.where(F.col("topic_id") != OUTLIER_TOPIC).agg(
        (F.count_distinct("word") / F.count("word")).alias("diversity")
    )


#: A term of more topics than this is multiplied by blocks of topics; the pairs of any other are listed.
SHORT_LIST = 128
#: So many pairs are listed or held by a task before they are summed up, and handed on if that leaves more than half.
HELD_PAIRS = 2_000_000


def related_topics(weights: DataFrame, block: int = 512, rows: int = 1024) -> DataFrame:
    """Cosine distance of the topics that share a term (topic_a < topic_b), without the outliers.

    Every two topics that are not listed have distance 1. Every task sums its products by pair of topics
    before they are shuffled. Terms of few topics give their pairs; where few topics meet, or a term has
    very many, ``block`` by ``block`` matrices are multiplied, one at a time. A task holds one such matrix
    and HELD_PAIRS sums at most, however many topics there are.
    """
    topical = weights.where(F.col("topic_id") != OUTLIER_TOPIC).select("topic_id", "term", "score")
    by_term = topical.groupBy("term").agg(
        F.collect_list("topic_id").alias("topics"), F.collect_list("score").alias("scores")
    )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, dot = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, dot = key[order], dot[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return key[first], np.add.reduceat(dot, first)

        def out(key: np.ndarray, dot: np.ndarray) -> pa.RecordBatch:
            a, b = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, dot)], names=["a", "b", "dot"])

        for big in batches:
            for at in range(0, big.num_rows, rows):
                for part in _pair_products(big.slice(at, rows), block):
                    held.append(part)
                    size += len(part[0])
                    if size > HELD_PAIRS:
                        held[:] = [summed()]
                        size = len(held[0][0])
                        if size > HELD_PAIRS // 2:
                            yield out(*held[0])
                            held.clear()
                            size = 0
        if size:
            yield out(*summed())

    dots = by_term.mapInArrow(products, "a int, b int, dot double").groupBy("a", "b").agg(F.sum("dot").alias("dot"))
    norms = _norms(topical)
    side = lambda x: norms.select(F.col("topic_id").alias(x), F.col("norm").alias(f"norm_{x}"))
    return (
        dots.where("dot <> 0")
        .join(side("a"), "a")
        .join(side("b"), "b")
        .select(
            F.col("a").alias("topic_a"),
            F.col("b").alias("topic_b"),
            (1 - F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).alias("distance"),
        )
    )


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b & 0xFFFFFFFF


def _pair_products(batch: pa.RecordBatch, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair of topics, smaller first, product) of some terms; a pair may come several times. What comes at once is at most a matrix of ``block`` by ``block``, or HELD_PAIRS and one term."""
    lists = batch.column("topics")
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), size)
    topic = lists.flatten().to_numpy().astype(np.int64)
    score = batch.column("scores").flatten().to_numpy()
    order = np.lexsort((topic, row))
    topic, score = topic[order], score[order]

    names, number = np.unique(topic, return_inverse=True)
    short = size <= (SHORT_LIST if len(names) > block else 0)
    listed = short[row]

    # The pairs of short lists: every place with those after it in its list, some places at a time.
    at = np.flatnonzero(listed)
    later = (np.cumsum(size)[row] - 1 - np.arange(len(row)))[at]
    upto = np.cumsum(later)
    for lo, hi in _runs(upto, HELD_PAIRS):
        many = later[lo:hi]
        left = np.repeat(at[lo:hi], many)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        if len(left):
            yield _pair(topic[left], topic[right]), score[left] * score[right]

    # All others by matrices, over blocks of the topics that these terms have.
    at = np.flatnonzero(~listed)
    if not len(at):
        return
    names, number = np.unique(topic[at], return_inverse=True)
    _, row = np.unique(row[at], return_inverse=True)
    score = score[at]
    in_block = [np.flatnonzero(number // block == k) for k in range(-(-len(names) // block))]

    def dense(k: int) -> np.ndarray:
        m = np.zeros((row[-1] + 1, min(block, len(names) - k * block)))
        m[row[in_block[k]], number[in_block[k]] - k * block] = score[in_block[k]]
        return m

    for i in range(len(in_block)):
        left = dense(i)
        for j in range(i, len(in_block)):
            sums = left.T @ (left if i == j else dense(j))
            a, b = np.nonzero(np.triu(sums, 1) if i == j else sums)
            yield _pair(names[a + i * block], names[b + j * block]), sums[a, b]


def _runs(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes, with the running total ``upto``, add up to ``most``, or one item."""
    lo = 0
    while lo < len(upto):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield lo, hi
        lo = hi


def _norms(topical: DataFrame) -> DataFrame:
    return topical.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))


def topic_distances(weights: DataFrame, block: int = 512, rows: int = 1024) -> DataFrame:
    """Cosine distance of every two topics (topic_a < topic_b), without the outliers: for charts.

    One row per pair, so for as many topics as a chart can show; :func:`related_topics` has the pairs that
    matter, and is what the merge tree is built from.
    """
    related = related_topics(weights, block, rows)
    names = weights.where(F.col("topic_id") != OUTLIER_TOPIC).select("topic_id").distinct()
    other = names.select(F.col("topic_id").alias("topic_b"))
    every = names.select(F.col("topic_id").alias("topic_a")).join(other, F.col("topic_a") < F.col("topic_b"))
    return every.join(related, ["topic_a", "topic_b"], "left").select(
        "topic_a", "topic_b", F.coalesce("distance", F.lit(1.0)).alias("distance")
    )
