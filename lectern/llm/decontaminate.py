"""Benchmark passages in documents, found by suffix arrays over the documents.

Documents are the text that is indexed: every task takes its documents in shards of bounded size and
builds a suffix array of each shard's words. All suffixes of the benchmark items are searched in it at
once, by binary search refined word by word, which gives for every item position the longest verbatim
match and all places in the shard. Only words that benchmark items hold have numbers; any other word
ends a match, so suffixes that cannot reach the shortest window before such a word are left out of the
array. That drops no match.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``window``
consecutive words of an item; an item with fewer words, but not none, is one window. A document word
inside any occurrence of a window is hit.

The benchmark is the stated query set. It is taken in blocks of bounded size, one after another over the
same rows, and each block's search runs on the documents where they lie: nothing is shuffled.

Nulls: a null text has no words, an item with null text none either; null item ids are left out of the
list of items, but their windows count. Items with the same id count as one item. Repeated documents are
treated each for itself. An empty benchmark hits nothing. Other columns of the documents pass through
:func:`annotate` untouched, except ``n_words``, ``hits`` and ``items``, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import ALNUM_LOWER, ranges, slices, split_words

WINDOW = 10
#: Characters of benchmark text in one block; the documents are passed once per block.
BLOCK_CHARS = 16 << 20
#: Bytes of document text in one shard, that is, under one suffix array.
SHARD_BYTES = 4 << 20

_SPAN = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


class Block:
    """Words, item starts and windows of some benchmark items, as numbers."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        self.firsts, words = split_words(pa.array(texts, pa.string()), ALNUM_LOWER)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        # Number 0 is any word that no item holds, and the end of an item.
        self.words = coded.indices.to_numpy().astype(np.int32) + 1
        lengths = np.diff(self.firsts)
        self.ids = ids
        self.item = np.repeat(np.arange(len(ids)), lengths)
        #: Words that a window starting at each position has; 0 where none starts.
        left = np.repeat(self.firsts[1:], lengths) - np.arange(len(self.words))
        whole = np.repeat(lengths, lengths)
        own = np.arange(len(self.words)) == np.repeat(self.firsts[:-1], lengths)
        self.window = np.where(left >= window, window, np.where(own & (whole < window), whole, 0))
        self.left = left
        self.shortest = int(self.window[self.window > 0].min()) if len(self.words) else window


def suffix_array(words: np.ndarray, reach: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of suffixes of at least ``shortest`` known words, in order of their known words.

    ``reach`` is the number of known words from each position on. Ranks are doubled until all
    suffixes that differ are apart or have been compared as far as they reach.
    """
    at = np.flatnonzero(reach >= shortest)
    if not len(at):
        return at
    rank = words.astype(np.int64)
    width, longest = 1, int(reach[at].max())
    while width < longest:
        # The rank of the part after the first ``width`` words; 0 where the suffix has ended.
        after = np.zeros_like(rank)
        after[:-width] = rank[width:]
        after[reach <= width] = 0
        known = np.flatnonzero(reach > 0)
        pair = rank[known] * (int(rank.max()) + 1) + after[known]
        _, ranks = np.unique(pair, return_inverse=True)
        rank = np.zeros_like(rank)
        rank[known] = ranks + 1
        width *= 2
    return at[np.argsort(rank[at], kind="stable")]


def search(block: Block, words: np.ndarray, suffixes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Binary search of all item suffixes, one word further at each step.

    Yields (matched words, item positions, first and end row in the suffix array) while any matches.
    """
    query = np.flatnonzero(block.left > 0)
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(suffixes), np.int64)
    padded = np.append(words, 0)
    depth = 0
    while len(query):
        wanted = block.words[query + depth]

        def bound(right: bool, wanted=wanted, low=low, high=high, depth=depth) -> np.ndarray:
            a, b = low.copy(), high.copy()
            while (active := a < b).any():
                mid = (a + b) // 2
                have = padded[np.minimum(suffixes[np.where(active, mid, 0)] + depth, len(words))]
                down = active & ((have <= wanted) if right else (have < wanted))
                a = np.where(down, mid + 1, a)
                b = np.where(active & ~down, mid, b)
            return a

        low, high = bound(False), bound(True)
        depth += 1
        found = low < high
        query, low, high = query[found], low[found], high[found]
        if len(query):
            yield depth, query, low, high
        more = block.left[query] > depth
        query, low, high = query[more], low[more], high[more]


def _known(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(words), np.int32)
    found = pc.index_in(words, value_set=vocabulary.cast(words.type))
    return pc.add(found, 1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)


def _long_runs(words: np.ndarray, firsts: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at least ``shortest`` known words inside a text, each closed by a 0.

    Returns (their words with the closing zeros, the known words from each place on, the place of each
    of their words in the whole).
    """
    n = len(words)
    known = words > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    inner = firsts[:-1][firsts[:-1] < n]
    begin[inner] |= known[inner]
    starts = np.flatnonzero(begin)
    stops = np.append(np.flatnonzero(~known), n)
    text_end = firsts[np.searchsorted(firsts, starts, side="right")] if len(starts) else starts
    lengths = np.minimum(stops[np.searchsorted(stops, starts)], text_end) - starts
    starts, lengths = starts[lengths >= shortest], lengths[lengths >= shortest]
    origin = ranges(starts, lengths)
    run = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(origin)) + run
    total = len(origin) + len(starts)
    closed, reach, back = np.zeros(total, np.int32), np.zeros(total, np.int64), np.zeros(total, np.int64)
    closed[place] = words[origin]
    reach[place] = np.repeat(starts + lengths, lengths) - origin
    back[place] = origin
    return closed, reach, back


def find(block: Block, firsts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit mark of every word, (text, item) pairs with a window, longest match from each word)."""
    closed, reach, origin = _long_runs(words, firsts, block.shortest)
    suffixes = suffix_array(closed, reach, block.shortest)
    edges = np.zeros(len(words) + 1, np.int64)
    longest = np.zeros(len(words), np.int64)
    pairs: list[np.ndarray] = []
    if len(suffixes):
        for depth, query, low, high in search(block, closed, suffixes):
            if depth < block.shortest:
                continue
            places = origin[suffixes[ranges(low, high - low)]]
            longest[places] = depth
            full = np.repeat(block.window[query] == depth, high - low)
            if full.any():
                hit, item = places[full], np.repeat(block.item[query], high - low)[full]
                edges += np.bincount(hit, minlength=len(edges))
                edges -= np.bincount(hit + depth, minlength=len(edges))
                text = np.searchsorted(firsts, hit, side="right") - 1
                pairs.append(np.unique(np.stack([text, item], 1), axis=0))
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return np.cumsum(edges[:-1]) > 0, found, longest


def _spans(hit: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last) of the runs of hit words."""
    begin = hit.copy()
    begin[1:] &= ~hit[:-1]
    inner = firsts[:-1][firsts[:-1] < len(hit)]
    begin[inner] |= hit[inner]
    starts = np.flatnonzero(begin)
    text = np.searchsorted(firsts, starts, side="right") - 1
    stops = np.append(np.flatnonzero(~hit), len(hit))
    ends = np.minimum(stops[np.searchsorted(stops, starts)], firsts[text + 1])
    return text, starts - firsts[text], ends - firsts[text]


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of ``n`` rows of the values whose (ascending) row number it is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _annotate(block: Block, item_ids: pa.Array, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=SHARD_BYTES):
                firsts, words = split_words(part["text"], ALNUM_LOWER)
                hit, pairs, longest = find(block, firsts, _known(words, block.vocabulary))
                text, start, end = _spans(hit, firsts)
                best = np.zeros(part.num_rows, np.int64)
                full = np.flatnonzero(np.diff(firsts))
                if len(full):
                    best[full] = np.maximum.reduceat(longest, firsts[full])
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
                items = item_ids.take(pa.array(pairs[:, 1]))
                yield pa.record_batch(
                    [
                        *(part[x] for x in names),
                        pa.array(np.diff(firsts)),
                        _lists(text, part.num_rows, spans),
                        _lists(pairs[:, 0], part.num_rows, items),
                        pa.array(best),
                    ],
                    names=[*names, "_words", "_spans", "_items", "_best"],
                )

    return run


def _blocks(benchmark: DataFrame, block_chars: int, window: int) -> Iterator[Block]:
    """The items in blocks; each is a part of the rows by a hash, so that only one is held at a time."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield Block(rows["item_id"].to_pylist(), rows["text"].to_pylist(), window)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with n_words, ``hits`` (spans of hit words), ``items`` (ids of the items with occurring
    windows, distinct and sorted as strings) and ``longest_match`` (words of the longest verbatim match
    that is at least as long as the shortest window)."""
    columns = [x for x in docs.columns if x not in ("n_words", "hits", "items", "longest_match")]
    out = docs.select(*columns).withColumn("text", F.col("text").cast("string"))
    names = out.columns
    schema = out.schema
    extra = [
        T.StructField("_words", T.LongType()),
        T.StructField("_spans", _SPAN),
        T.StructField("_items", T.ArrayType(T.StringType())),
        T.StructField("_best", T.LongType()),
    ]
    empty = F.array()
    out = out.select(
        *names, F.lit(0).cast("long").alias("n_words"), empty.cast(_SPAN).alias("hits"),
        empty.cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest_match"),
    )
    carried = out.columns
    schema = out.schema
    for block in _blocks(benchmark, block_chars, window):
        out = out.mapInArrow(
            _annotate(block, pa.array(block.ids, pa.string()), carried), T.StructType([*schema.fields, *extra])
        ).select(
            *names,
            F.col("_words").alias("n_words"),
            F.concat("hits", "_spans").alias("hits"),
            F.concat("items", "_items").alias("items"),
            F.greatest("longest_match", "_best").alias("longest_match"),
        )
    items = F.array_sort(F.array_distinct(F.array_compact("items")))
    return out.withColumn("items", items)


def n_hit(hits: str) -> F.Column:
    """Words inside any of the spans, which may overlap when they come from several blocks."""
    ordered = F.array_sort(hits)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        ordered,
        start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(x["end"], a["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, with the columns of ``docs``."""
    return annotate(docs, benchmark, window).where(F.size("hits") == 0).select(*docs.columns)
