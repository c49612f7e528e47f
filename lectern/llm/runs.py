"""Runs of repeated words, found on a grammar of the texts.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) that is at least
``least`` words and ``times`` periods long and that no neighbouring word extends.

The words of a slice of documents become numbers and are compressed by Re-Pair: in rounds, every pair of
neighbouring symbols that occurs more than once and beats the pairs it overlaps by frequency becomes a
nonterminal, until no pair occurs twice. Pairs never cross documents; documents of a slice share the rules.
A run lies whole in the smallest part of some derivation that holds it, and crosses the boundary between
the two halves of that part. So the stretches that cross a boundary are worked out once per nonterminal, at
one of its occurrences and within it, and moved to every other place where it is derived; the symbols left
at the end have the document as their part. What a part cuts off is contained in a longer stretch of the
same period that a larger part has, and is merged into it.

At a boundary ``c`` a run of ``times >= 4`` periods has two of them on one side: the ``q`` words there stand
twice in a row. Periods below four are tried one by one, longer ones at the places where the four words at
the boundary stand again. Stretches are then measured exactly, by comparing words.

Everything is local to a document: one pass, nothing is shuffled. Texts are taken whole; a slice is bounded
by its bytes and a longer text is one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import SPACED, ranges, slices, strings, text_buffers, word_places

LEAST = 6
TIMES = 4
SLICE_BYTES = 2 << 20
#: Periods from here on are looked up by so many words.
GRAM = 4
#: Candidates compared at once; bounds memory only.
CANDIDATES = 1 << 18

_SYMBOL = np.uint64(32)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """Re-Pair over the words of documents: rules, where they are derived, and what is left."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        # A symbol lies at the place of its first word; the next one begins where it ends.
        symbol, end, before = words.astype(np.uint64), np.arange(1, n + 1), np.arange(-1, n - 1)
        edges = np.r_[np.flatnonzero(np.diff(doc)) + 1, n]
        doc_end = edges[np.searchsorted(edges, np.arange(n), side="right")]
        gone = np.zeros(n, bool)
        fresh, known = int(words.max(initial=-1)) + 1, 0
        #: Of every rule: start, boundary and end of its first derivation.
        self.first: list[np.ndarray] = []
        #: (rule, start) of all derivations.
        self.rules: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        # A pair that stands once stays so until one of its symbols is new; only the others are counted again.
        live = np.flatnonzero(end < doc_end)
        while len(live):
            nexts = end[live]
            pairs = (symbol[live] << _SYMBOL) | symbol[nexts]
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            new = np.r_[True, pairs[1:] != pairs[:-1]]
            count = np.bincount(np.cumsum(new) - 1)
            # Frequency first, then a hash, so that of equally frequent pairs in a row many are taken at once:
            # a number of its own for every pair, 0 for one that stands once.
            mixed = pairs[new] * _MULTIPLIER
            rank = np.empty(len(count), np.int64)
            rank[np.lexsort((mixed ^ (mixed >> _SYMBOL), count))] = np.arange(1, len(count) + 1)
            rank[count < 2] = 0
            here = np.empty(len(live), np.int64)
            here[order] = np.repeat(rank, count)
            touch = nexts[:-1] == live[1:]
            left = np.r_[0, np.where(touch, here[:-1], 0)]
            right = np.r_[np.where(touch, here[1:], 0), 0]
            # Of a stretch of equal pairs every other one is taken.
            since = np.where(here != left, np.arange(len(here)), 0)
            even = (np.arange(len(here)) - np.maximum.accumulate(since)) % 2 == 0
            chosen = (here > 0) & even & (left <= here) & (right <= here)
            at, mid = live[chosen], nexts[chosen]
            if not len(at):
                break
            _, lead, rule = np.unique(here[chosen], return_index=True, return_inverse=True)
            self.first.append(np.stack([at[lead], mid[lead], end[mid[lead]]]))
            self.rules.append(rule + known)
            self.starts.append(at)
            symbol[at] = (fresh + rule).astype(np.uint64)
            end[at] = end[mid]
            gone[mid] = True
            inside = at[end[at] < doc_end[at]]
            before[end[inside]] = inside
            known, fresh = known + len(lead), fresh + len(lead)
            changed = before[at]
            changed = changed[(changed >= 0) & (doc[changed] == doc[at])]
            live = np.unique(np.concatenate([live[here > 0], at, changed]))
            live = live[~gone[live] & (end[live] < doc_end[live])]
        #: Boundaries between the symbols left.
        self.left = np.flatnonzero(~gone & (np.r_[-1, doc[:-1]] == doc)[:n])


def _matches(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``a`` and ``b`` on (``step`` 1) or back (-1) are equal, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    active, size = np.flatnonzero(most > 0), 8
    while len(active):
        per = max(1, (1 << 20) // size)
        still = []
        for lot in (active[i : i + per] for i in range(0, len(active), per)):
            offset = out[lot][:, None] + np.arange(size)[None, :]
            inside = offset < most[lot][:, None]
            offset = np.where(inside, offset, 0)
            equal = (words[a[lot][:, None] + step * offset] == words[b[lot][:, None] + step * offset]) & inside
            run = np.where(equal.all(axis=1), size, np.argmin(equal, axis=1))
            out[lot] += run
            still.append(lot[(run == size) & (out[lot] < most[lot])])
        active, size = np.concatenate(still), min(size * 4, 1 << 12)
    return out


def _stretches(words, who, q, way, c, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of period ``q`` that begin with the words beside the boundaries."""
    c, low, high = c[who], low[who], high[who]
    # To the right the words at c and c + q, to the left those before; on the other side q words earlier.
    back = np.where(way > 0, 0, q)
    right = _matches(words, c - back, c - back + q, high - c - q + back, 1)
    left = _matches(words, c - 1 - back, c - 1 - back + q, c - back - low, -1)
    return c - back - left, c - back + q + right


def _crossing(words, doc, c, low, high, least, times) -> tuple[np.ndarray, ...]:
    """(which, start, end, period) of the stretches over the boundaries ``c`` within ``low`` to ``high``."""
    which, period, side = [], [], []
    longest = (high - low) // times
    every = np.arange(len(c))
    for q in range(1, GRAM):
        for way in (1, -1):
            fits = every[(longest >= q) & (c + 2 * q <= high if way > 0 else c - 2 * q >= low)]
            base = c[fits] if way > 0 else c[fits] - 2 * q
            equal = np.ones(len(fits), bool)
            for i in range(q):
                equal &= words[base + i] == words[base + q + i]
            which.append(fits[equal])
            period.append(np.full(int(equal.sum()), q))
            side.append(np.full(int(equal.sum()), way))
    n = len(words) - GRAM + 1
    if n > 0 and (longest >= GRAM).any():
        gram = doc[:n].astype(np.uint64)
        for i in range(GRAM):
            gram = (gram ^ words[i : i + n].astype(np.uint64)) * _MULTIPLIER
            gram ^= gram >> np.uint64(29)
        order = np.argsort(gram, kind="stable")
        new = np.r_[True, gram[order][1:] != gram[order][:-1]]
        group = np.empty(n, np.int64)
        group[order] = np.cumsum(new) - 1
        # Sorted by group, then place.
        key = group[order] * (n + 1) + order
        repeated = np.bincount(group)[group] > 1
        for way in (1, -1):
            at = c if way > 0 else c - GRAM
            reach = np.minimum(longest, (high - c if way > 0 else c - low) // 2)
            fits = every[reach >= GRAM]
            fits = fits[repeated[at[fits]]]
            own = group[at[fits]] * (n + 1) + at[fits]
            if way > 0:
                a = np.searchsorted(key, own + GRAM)
                b = np.searchsorted(key, own + reach[fits], side="right")
            else:
                a = np.searchsorted(key, own - reach[fits])
                b = np.searchsorted(key, own - GRAM, side="right")
            lengths = np.maximum(b - a, 0)
            cuts = np.searchsorted(np.cumsum(lengths), np.arange(0, int(lengths.sum()) + CANDIDATES, CANDIDATES))
            for i, j in zip(cuts[:-1], np.maximum(cuts[1:], cuts[:-1] + 1), strict=True):
                who = np.repeat(fits[i:j], lengths[i:j])
                q = np.abs(order[ranges(a[i:j], lengths[i:j])] - at[who])
                # A few words of the two periods first, so that nearly all others go.
                for part, parts in ((1, 1), (1, 2), (1, 3), (2, 3)):
                    base = c[who] + part * (q - 1) // parts - (0 if way > 0 else 2 * q)
                    good = words[base] == words[base + q]
                    who, q = who[good], q[good]
                which.append(who)
                period.append(q)
                side.append(np.full(len(who), way))
    who, q, way = np.concatenate(which), np.concatenate(period), np.concatenate(side)
    by = np.lexsort((q, way, who))
    who, q, way = who[by], q[by], way[by]
    done, lot = [], 1
    while len(who):
        # The smallest periods of every boundary and side first, twice as many each time.
        new = np.r_[True, (who[1:] != who[:-1]) | (way[1:] != way[:-1])]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        now = np.arange(len(who)) - first[group] < lot
        start, end = _stretches(words, who[now], q[now], way[now], c, low, high)
        done.append((who[now], start, end, q[now]))
        # Two periods that lie in a stretch of a smaller period are made of that, and so is their run.
        reach = np.zeros(len(first), np.int64)
        np.maximum.at(reach, group[now], np.where(way[now] > 0, end - c[who[now]], c[who[now]] - start))
        rest = ~now & (2 * q > reach[group])
        who, q, way, lot = who[rest], q[rest], way[rest], 2 * lot
    none = np.empty(0, np.int64)
    who, start, end, q = (np.concatenate([none, *x]) for x in (zip(*done, strict=True) if done else [()] * 4))
    good = (end - start >= least) & (end - start >= times * q)
    who, start, end, q = who[good], start[good], end[good], q[good]
    # The smallest period of a stretch is among its candidates.
    best = np.lexsort((q, end, start, who))
    who, start, end, q = who[best], start[best], end[best], q[best]
    new = np.r_[True, (who[1:] != who[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(who)]
    return who[new], start[new], end[new], q[new]


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs, by start, then period; ``doc`` numbers the document of each word."""
    if times < 4:
        raise ValueError("runs of fewer than four periods are not found at every boundary")
    none = np.empty(0, np.int64)
    if len(words) < least:
        return none, none, none
    grammar = Grammar(words, doc)
    low, mid, high = np.concatenate([*grammar.first, np.empty((3, 0), np.int64)], axis=1).astype(np.int64)
    large = np.flatnonzero(high - low >= least)
    edges = np.flatnonzero(np.diff(doc)) + 1
    doc_low, doc_high = np.r_[0, edges], np.r_[edges, len(words)]
    rank = np.searchsorted(doc_low, grammar.left, side="right") - 1
    who, start, end, q = _crossing(
        words, doc,
        np.r_[mid[large], grammar.left], np.r_[low[large], doc_low[rank]], np.r_[high[large], doc_high[rank]],
        least, times,
    )
    # Stretches of a rule go to all its derivations.
    ruled = who < len(large)
    rule = large[who[ruled]]
    derived, places = np.concatenate([*grammar.rules, none]).astype(np.int64), np.concatenate([*grammar.starts, none])
    by = np.argsort(derived, kind="stable")
    a, b = np.searchsorted(derived[by], rule), np.searchsorted(derived[by], rule, side="right")
    moved = places[by[ranges(a, b - a)]]
    shift = lambda x: np.r_[np.repeat(x[ruled] - low[rule], b - a) + moved, x[~ruled]].astype(np.int64)
    start, end = shift(start), shift(end)
    q = np.r_[np.repeat(q[ruled], b - a), q[~ruled]].astype(np.int64)
    # A stretch inside another of its period is a part of the same run.
    by = np.lexsort((-end, start, q))
    start, end, q = start[by], end[by], q[by]
    reach = end + q * (len(words) + 1)
    before = np.r_[-1, np.maximum.accumulate(reach)[:-1]][: len(reach)]
    kept = (reach > before) | (before < q * (len(words) + 1))
    start, end, q = start[kept], end[kept], q[kept]
    by = np.lexsort((q, start))
    return start[by], end[by], q[by]


_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def annotate(
    docs: DataFrame, order: Column | None = None, least: int = LEAST, times: int = TIMES, text_col: str = "text"
) -> DataFrame:
    """The columns of ``docs`` but the text, with n_words, runs (start, length, period) and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``collapsed`` joins the words by one space, without
    those that lie in some run after its first period. ``order`` (start, period; both long) may say that
    every word from ``start`` on is taken as the words from there on, repeated with that period; null
    leaves the text as it is.

    A null text has no words and collapses to an empty one. Repeated rows are treated each for itself, and
    other columns are not looked at; columns called n_words, runs or collapsed are replaced.
    """
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "runs", "collapsed")]
    order = F.lit(None).cast("struct<start:long,period:long>") if order is None else order
    shown = docs.select(
        F.struct(F.lit(True).alias("_"), *[F.col(c) for c in kept]).alias("row"),
        F.col(text_col).cast("string").alias("text"),
        order.alias("again"),
    )
    schema = T.StructType([shown.schema["row"]])
    schema = schema.add("n_words", T.LongType()).add("runs", T.ArrayType(_RUN, False)).add("collapsed", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = _slice(part["text"], part["again"].to_pylist(), least, times)
                yield pa.RecordBatch.from_arrays([part["row"], *found], names=schema.names)

    found = shown.mapInArrow(run, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "n_words", "runs", "collapsed")


def _slice(texts: pa.Array, again: list, least: int, times: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    offsets, data = text_buffers(texts)
    starts, ends = word_places(offsets, SPACED[data])
    firsts = np.searchsorted(starts, offsets)
    n = np.diff(firsts)
    for i, x in enumerate(again):
        if x is not None and x["start"] < n[i]:
            a, b = firsts[i] + x["start"], firsts[i + 1]
            source = a + np.arange(b - a) % x["period"]
            starts[a:b], ends[a:b] = starts[source], ends[source]
    doc = np.repeat(np.arange(len(n)), n)
    lengths = ends - starts
    cells = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=cells[1:])
    coded = strings(cells, data[ranges(starts, lengths)]).cast(pa.large_binary()).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end, q = find_runs(words, doc, least, times)

    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + q, 1)
    np.add.at(gone, end, -1)
    stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    # Every word with one space after it; the last of a text goes without.
    size = lengths[stays] + 1
    last = np.r_[doc[stays][1:] != doc[stays][:-1], True][: len(stays)]
    after = np.cumsum(size) - 1
    joined = np.append(data, np.uint8(0x20))[ranges(starts[stays], size)]
    joined[after] = 0x20
    keep = np.ones(len(joined), bool)
    keep[after[last]] = False
    text_size = np.bincount(doc[stays], weights=size - last, minlength=len(n)).astype(np.int64)
    collapsed = strings(np.r_[0, np.cumsum(text_size)], joined[keep])

    owner = doc[start] if len(start) else start
    list_offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(n)))].astype(np.int32)
    fields = [start - firsts[:-1][owner], end - start, q] if len(start) else [start, start, start]
    runs = pa.ListArray.from_arrays(
        list_offsets, pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in fields], fields=[pa.field(f.name, pa.int64(), False) for f in _RUN])
    )
    return pa.array(n.astype(np.int64)), runs, collapsed.cast(pa.string())
