"""Documents that share most of their word shingles: a size-aware heavy-light Jaccard join.

Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct word shingles
(of ``size`` words; a shorter text is one shingle). Copies are one set. Shingles and sets are told apart
by 64-bit hashes.

* All sets order their shingles alike: heavy ones, which occur in many documents, last, then by hash. (Which
  ones count as heavy changes the speed, never the result.) A set of n shingles shares at least
  t = ceil(percent * n / 100) with any partner, so two partners have their first k shared shingles among
  the first n - t + k of each.
* Small sets (light side) enumerate the 2-subsets of their first n - t + 2 shingles; partners share one.
* Large sets (heavy side) scan the inverted lists of their first n - t + k shingles, with k growing with n,
  and partners meet in k lists. A set that meets others in fewer lists has no partner and is left out
  of all lists, which is done twice; so passages that many documents share bring few sets together. Small
  sets that are large enough to be partners of large ones are in these lists too.
* The boundary is the size at which subsets and list entries are fewest, from the sizes of all sets.

A list of m sets is not turned into m * m pairs. In a few rounds each set is compared with one of its list
only, and what links is joined into components. Then sets are compared with all sets of larger components
that they still share a list with: pairs of rows for short lists, blocks of sets inside tasks for long
ones, where only links come out. So groups of many copies cost rows in proportion to their size, and no
link between different components is missed.

Nulls: a null, empty or wordless text has an empty set and links with nothing; its component is its own
id. A null ``doc_id`` takes part in links, and the component is the smallest id that is not null. Repeated
rows link like any copies and each gives a row. An empty table gives an empty table. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import SPACED_LOWER, ranges, slices, split_words, text_buffers
from lectern.operators.clusters import connected_components
from lectern.operators.skew import is_small, lookup_join
from lectern.session import cut_lineage

SHINGLE = 4
PERCENT = 85
#: A shingle that leads in more documents than this is heavy; MAX_HEAVY (8 bytes each) of them at most. A task
#: counts its own, the MAX_COUNTED most frequent at a time, and hands on those it met twice.
HEAVY_DOCS = 100
MAX_HEAVY = 1 << 20
MAX_COUNTED = 1 << 17
#: Sets that a task remembers, so as not to list their copies.
MAX_SEEN = 1 << 16
#: A partner of a set of n is met in about one list for every STEP shingles, at least one.
STEP = 20
#: Sets are small up to at most this size; the boundary lies at or below it.
MAX_SMALL = 64
#: Sets that are wanted again are picked in the scan up to so many (8 bytes each), else by a join.
MAX_WANTED = 1 << 20
PEELED = 2
#: Rounds that compare the sets of a list with one of them only, before those that are still apart. Each
#: costs a search of components, which takes longer than the comparisons that it saves beyond the first.
CENTRES = 1
#: Longer lists are compared inside tasks, in blocks of about so many shingles (8 bytes each).
LONG_LIST = 256
BLOCK_SHINGLES = 1 << 20
#: Pairs are told apart by bitmaps of so many 64-bit words first, where they can be, then by those of at least so
#: many bits a shingle.
BIT_WORDS = 16
WIDE_BITS = 4
#: Texts are hashed so many bytes at a time, which takes some 25 times as much memory for a while.
_SLICE = 512 << 10

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial in its bytes, mixed with its length."""
    offsets, data = text_buffers(words)
    lengths = np.diff(offsets)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    longest = int(lengths.max())
    powers = np.multiply.accumulate(np.full(longest + 1, _A, np.uint64))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
    return _mixed(np.add.reduceat(terms, offsets[:-1]) + lengths.astype(np.uint64))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every text, ascending, as unsigned 64-bit numbers."""
    firsts, words = split_words(texts, SPACED_LOWER)
    hashes = _word_hashes(words)
    n = len(hashes)
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        full = full * _A + hashes[k : n - size + 1 + k]
    full = _mixed(full)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for x in hashes[a:b]:
                whole = whole * _A + x
            yield _mixed(np.array([whole ^ _B]))
        else:
            yield full[:0]


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _least(n: int, percent: int) -> int:
    """Fewest shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def _met(n: int, step: int) -> int:
    """Lists for the first shared shingles of a set of n."""
    return 1 + n // step


def _sets(size: int):
    """doc_id, key and number of shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=_SLICE):
                found = [(_key(s) if len(s) else None, len(s)) for s in shingle_sets(part["text"], size)]
                keys, counts = zip(*found, strict=True)
                yield pa.record_batch(
                    [part["doc_id"], pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "key", "n"]
                )

    return run


def _leads(size: int, percent: int, step: int, most: int):
    """h, c: the shingles that come first by hash, half as many again as are listed, counted in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, max_bytes=_SLICE):
                leads = [
                    s[: (len(s) - _least(len(s), percent) + _met(len(s), step)) * 3 // 2]
                    for s in shingle_sets(part["text"], size)
                ]
                new, n = np.unique(np.concatenate([*leads, np.zeros(0, np.uint64)]), return_counts=True)
                h, place = np.unique(np.concatenate([h, new]), return_inverse=True)
                c = np.bincount(place, np.concatenate([c, n]), len(h)).astype(np.int64)
                if len(h) > most:
                    kept = np.sort(np.argsort(-c, kind="stable")[:most])
                    h, c = h[kept], c[kept]
        yield pa.record_batch([h[c > 1].view(np.int64), c[c > 1]], names=["h", "c"])

    return run


def _signatures(size: int, percent: int, boundary: int, heavy: Broadcast, step: int):
    """sig, key, n: subsets of small sets, list entries of large ones. Of copies in a task
    most are listed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = heavy.value, set()
        for batch in batches:
            for part in slices(batch, max_bytes=_SLICE):
                sigs, rows = [], []
                if len(seen) > MAX_SEEN:
                    seen.clear()
                for s in shingle_sets(part["text"], size):
                    n = len(s)
                    key = _key(s) if n else None
                    if not n or key in seen:
                        continue
                    seen.add(key)
                    if len(last):
                        is_heavy = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        s = np.concatenate([s[~is_heavy], s[is_heavy]])
                    least, own = _least(n, percent), []
                    if n < boundary:
                        lead = s[: n - least + 2]
                        i, j = np.triu_indices(len(lead), 1)
                        low, high = np.minimum(lead[i], lead[j]), np.maximum(lead[i], lead[j])
                        own.append(_mixed((low * _A + high) ^ _B))
                    if 100 * n >= percent * boundary:
                        own.append(s[: n - least + _met(n, step)])
                    sigs += own
                    rows += [(key, n)] * len(own)
                if sigs:
                    lengths = [len(x) for x in sigs]
                    key, n = (np.repeat(np.array(x, np.int64), lengths) for x in zip(*rows, strict=True))
                    yield pa.record_batch([np.concatenate(sigs).view(np.int64), key, n], names=["sig", "key", "n"])

    return run


def _bitmap(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` (a power of two) 64-bit words; a bit is set if a shingle falls on it."""
    bits = np.zeros(64 * words, np.uint8)
    bits[(shingles >> np.uint64(24)) % np.uint64(64 * words)] = 1
    return np.packbits(bits).view(np.int64)


def _wide_words(n: int) -> int:
    return max(BIT_WORDS, 1 << ((WIDE_BITS * n - 1) >> 6).bit_length())


def _wanted_sets(size: int, wanted: Broadcast | None):
    """key, n, bitmaps and shingles of the wanted sets. Of copies in a task most are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, seen = None if wanted is None else wanted.value, set()
        for batch in batches:
            for part in slices(batch, max_bytes=_SLICE):
                found: dict[int, np.ndarray] = {}
                if len(seen) > MAX_SEEN:
                    seen.clear()
                for s in shingle_sets(part["text"], size):
                    key = _key(s) if len(s) else None
                    if key is None or key in seen:
                        continue
                    if chosen is None or (len(chosen) and chosen[min(np.searchsorted(chosen, key), len(chosen) - 1)] == key):
                        seen.add(key)
                        found[key] = s
                if found:
                    n = np.array([*map(len, found.values())])
                    lists = lambda own: pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum([*map(len, own)])), pa.int32()), pa.array(np.concatenate(own).view(np.int64))
                    )
                    bits = [_bitmap(s, BIT_WORDS) for s in found.values()]
                    wide = [_bitmap(s, _wide_words(len(s))) for s in found.values()]
                    yield pa.record_batch(
                        [pa.array(list(found), pa.int64()), n, lists(bits), lists(wide), lists(list(found.values()))],
                        names=["key", "n", "bits", "wide", "shingles"],
                    )

    return run


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The size from which sets are large: fewest rows of subsets and list entries.

    ``sizes`` counts the sets below MAX_SMALL. Larger sets are listed in any case.
    """

    def cost(boundary: int) -> int:
        total = 0
        for n, count in sizes.items():
            spare = n - _least(n, percent)
            if n < boundary:
                total += count * math.comb(min(spare + 2, n), 2)
            if 100 * n >= percent * boundary:
                # An entry is written, and met by all others of its list.
                total += 2 * count * min(spare + _met(n, STEP), n)
        return total

    return min(range(2, MAX_SMALL + 1), key=lambda b: (cost(b), b))


def _not_apart(pairs: DataFrame, marks: DataFrame, bits: str, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets may link by their bitmaps.

    Sets differ in as many shingles as their bitmaps differ in bits, or more. Of bitmaps of two lengths the
    halves of the longer one, of at most twice the length for sets that may link, are laid together.
    """
    named = lambda x: marks.select(*(F.col(c).alias(f"{to}_{x}") for c, to in [("key", "key"), ("n", "n"), (bits, "bits")]))
    both = pairs.join(named("a"), F.col("a") == F.col("key_a")).join(named("b"), F.col("b") == F.col("key_b"))
    short = F.expr("least(size(bits_a), size(bits_b))").alias("short")
    laid = lambda x: F.expr(
        f"if(size({x}) = short, {x}, transform(slice({x}, 1, short), (v, i) -> v | {x}[i + short])) as {x}"
    )
    both = both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b", short).select("a", "b", "n_a", "n_b", laid("bits_a"), laid("bits_b"))
    apart = F.expr("aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    near = both.where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    return cut_lineage(near.select("a", "b"))


def _shingles(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """key and shingles, once, of the sets named in ``keys``: no others are moved."""
    keys = F.broadcast(keys) if is_small(keys, MAX_WANTED) else keys
    return sets.select("key", "shingles").join(keys, "key", "left_semi").dropDuplicates(["key"])


def _linked(pairs: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets link. Pairs that differ in too many bits go before any shingles are moved."""
    near = _not_apart(_not_apart(pairs, marks, "bits", percent), marks, "wide", percent)
    keys = cut_lineage(_nodes(near).withColumnRenamed("node", "key"))
    own = cut_lineage(_shingles(sets, keys))
    with_a = near.join(own.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(own.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (of the set; null if it is empty), n_shingles, component_id of every row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = cut_lineage(docs.mapInArrow(_sets(size), "doc_id long, key long, n long"))
    small = sets.where(f"n > 0 and n < {MAX_SMALL}").groupBy("n").agg(F.count("*").alias("c"))
    boundary = choose_boundary({r["n"]: r["c"] for r in small.collect()}, percent)

    leads = docs.mapInArrow(_leads(size, percent, STEP, MAX_COUNTED), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    leads = leads.where(F.col("c") > HEAVY_DOCS).orderBy(F.desc("c"), "h").limit(MAX_HEAVY).select("h").toArrow()
    heavy = sc.broadcast(np.sort(leads["h"].to_numpy().astype(np.int64).view(np.uint64)))

    rows = docs.mapInArrow(_signatures(size, percent, boundary, heavy, STEP), "sig long, key long, n long")
    # One shuffle: equal rows, the count and what follows all go by the signature.
    lists = rows.repartition("sig").dropDuplicates(["sig", "key"])
    for _ in range(PEELED):
        listed = lists.withColumn("c", F.count("*").over(Window.partitionBy("sig"))).where("c > 1").drop("c")
        listed = cut_lineage(listed)
        enough = listed.groupBy("key", "n").agg(F.count("*").alias("c"))
        # The smallest partner of a set is in as many lists as its own size gives, and shares as many.
        least = F.expr(f"(99 + {percent} * n) div 100")
        need = F.when(F.col("n") < boundary, 1).otherwise(F.least(F.expr(f"1 + (99 + {percent} * n) div 100 div {STEP}"), least))
        enough = cut_lineage(enough.where(F.col("c") >= need).select("key"))
        lists = lookup_join(listed, enough, ["key"], ["sig"], "inner")
    lists = lists.withColumn("c", F.count("*").over(Window.partitionBy("sig"))).where("c > 1").select("sig", "key", "n")
    lists = cut_lineage(lists)

    wanted = lists.select("key").distinct()
    n_wanted = wanted.count()
    chosen = None
    if n_wanted <= MAX_WANTED:
        chosen = sc.broadcast(np.sort(wanted.toArrow()["key"].to_numpy().astype(np.int64)))
    kinds = "key long, n long, bits array<long>, wide array<long>, shingles array<long>"
    found = docs.mapInArrow(_wanted_sets(size, chosen), kinds)
    if chosen is None:
        found = found.join(wanted, "key", "left_semi")
    # Where they lie: a set that several tasks hold is there several times, and its bitmaps are moved alone.
    found = cut_lineage(found)
    marks = cut_lineage(found.drop("shingles").dropDuplicates(["key"]))

    placed = lists.withColumn("component", F.col("key"))
    joined = None
    for seed in range(CENTRES):
        placed = cut_lineage(_mixed_lists(placed))
        near = _with_centre(placed, seed, percent).distinct()
        joined, placed = _merged(joined, placed, cut_lineage(_linked(near, marks, found, percent)))
    placed = cut_lineage(_ranked(_mixed_lists(placed)))
    near = _with_larger(placed.where(F.col("c") <= LONG_LIST), percent).distinct()
    links = _linked(near, marks, found, percent)
    links = links.unionByName(_linked_in_blocks(placed.where(F.col("c") > LONG_LIST), found, percent))
    joined, _ = _merged(joined, placed.select("sig", "key", "n", "component"), cut_lineage(links.distinct()))
    return _answers(sets, joined)


def _fits(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _mixed_lists(placed: DataFrame) -> DataFrame:
    """The lists that hold sets of several components."""
    mixed = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return placed.join(mixed.select("sig"), "sig", "left_semi")


def _with_centre(placed: DataFrame, seed: int, percent: int) -> DataFrame:
    """Each set of a list with one of them. Lists agree on it where they can, so few pairs are different."""
    own = F.struct(F.xxhash64("key", F.lit(seed)).alias("h"), F.col("key").alias("k"), F.col("n").alias("m"), "component")
    near = placed.withColumn("first", F.min(own).over(Window.partitionBy("sig")))
    near = near.where((F.col("component") != F.col("first.component")) & _fits("n", "first.m", percent))
    return near.select(*_pair("key", "first.k"))


def _ranked(placed: DataFrame) -> DataFrame:
    """Lists with ``rank``, that of the set's component by size, the highest of the list, and its length."""
    sizes = placed.select("component", "key").distinct().groupBy("component").agg(F.count("*").alias("s"))
    ranked = lookup_join(placed, cut_lineage(sizes), ["component"], ["sig"])
    by_sig = Window.partitionBy("sig")
    return (
        ranked.withColumn("rank", F.struct("s", "component"))
        .withColumns({"top": F.max("rank").over(by_sig), "c": F.count("*").over(by_sig), "total": F.sum("n").over(by_sig)})
        .drop("s")
    )


def _with_larger(ranked: DataFrame, percent: int) -> DataFrame:
    """Sets with all sets of larger components in their lists, of at most LONG_LIST each."""
    y = ranked.select("sig", F.col("key").alias("k"), F.col("n").alias("m"), F.col("rank").alias("r"))
    near = ranked.where("rank < top").join(y, "sig").where((F.col("rank") < F.col("r")) & _fits("n", "m", percent))
    return near.select(*_pair("key", "k"))


def _linked_in_blocks(ranked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets with sets of larger components in long lists.

    Of lists with the same sets one is compared. A list is cut into blocks of about BLOCK_SHINGLES; each pair
    of blocks is one group with the sets' shingles, and only links leave it. A pair is compared in the first
    long list that has both.
    """
    same = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"x{k}") for k in range(2)]
    held = ranked.groupBy("sig").agg(F.count("*").alias("c"), *same)
    held = cut_lineage(held.groupBy("c", "x0", "x1").agg(F.min("sig").alias("sig")).select("sig"))
    ranked = cut_lineage(lookup_join(ranked, held, ["sig"], ["key"], "inner"))
    longs = ranked.groupBy("key").agg(F.sort_array(F.collect_list("sig")).alias("long"))
    rows = (
        ranked.withColumn("blocks", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("others", F.sequence(F.lit(0), F.col("blocks") - 1))
        .join(longs, "key")
        .join(_shingles(sets, longs.select("key")), "key")
    )
    own = ["sig", "key", F.col("rank.s").alias("s"), F.col("rank.component").alias("component"), "long", "shingles"]
    # Inside a block each set comes once, as seeker and as partner.
    seeks = F.col("rank") < F.col("top")
    seekers = rows.where(seeks & (F.col("blocks") > 1)).withColumn("y", F.explode("others")).where("y <> block")
    seekers = seekers.select(*own, F.col("block").alias("x"), "y", F.lit(True).alias("seeks"))
    larger = rows.withColumn("x", F.explode("others"))
    larger = larger.select(*own, "x", F.col("block").alias("y"), (seeks & (F.col("x") == F.col("block"))).alias("seeks"))
    return (
        seekers.unionByName(larger)
        .groupBy("sig", "x", "y")
        .applyInArrow(_block_links(percent), "a long, b long")
    )


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(0, np.cumsum(lengths)), lists.flatten().to_numpy(zero_copy_only=False)


def _block_links(percent: int):
    def run(group: pa.Table) -> pa.Table:
        seeks = group["seeks"].to_numpy()
        sig = group["sig"][0].as_py()
        key, size, component = (group[x].to_numpy() for x in ("key", "s", "component"))
        firsts, shingles = _flat(group["shingles"])
        _, numbers = np.unique(shingles, return_inverse=True)
        n = np.diff(firsts)
        # Long lists before this one, as a table of 0 and 1: a pair that shares any is compared there.
        long_firsts, longs = _flat(group["long"])
        row = np.repeat(np.arange(len(key)), np.diff(long_firsts))
        earlier, column = np.unique(longs[longs < sig], return_inverse=True)
        before = np.zeros((len(key), len(earlier)), np.float32)
        before[row[longs < sig], column] = 1
        one_block = group["x"][0].as_py() == group["y"][0].as_py()
        partners = np.flatnonzero(~seeks | one_block)
        held = np.zeros(int(numbers.max(initial=-1)) + 1, bool)
        a, b = [], []
        for i in np.flatnonzero(seeks):
            larger = (size[partners] > size[i]) | ((size[partners] == size[i]) & (component[partners] > component[i]))
            larger &= 100 * np.minimum(n[partners], n[i]) >= percent * np.maximum(n[partners], n[i])
            some = partners[larger]
            some = some[before[some] @ before[i] == 0]
            if not len(some):
                continue
            own = numbers[firsts[i] : firsts[i + 1]]
            held[own] = True
            places = ranges(firsts[some], n[some])
            shared = np.add.reduceat(held[numbers[places]].astype(np.int64), np.cumsum(n[some]) - n[some])
            held[own] = False
            linked = some[100 * shared >= percent * (n[some] + n[i] - shared)]
            a.append(np.minimum(key[linked], key[i]))
            b.append(np.maximum(key[linked], key[i]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a + none), "b": np.concatenate(b + none)})

    return run


def _merged(joined: DataFrame | None, placed: DataFrame, links: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The components, and the lists with them, after more links between sets."""
    if links.isEmpty():
        return joined, placed
    if joined is None:
        joined = cut_lineage(connected_components(_nodes(links), links))
    else:
        new = _nodes(links).join(joined, "node", "left_anti").withColumn("component", F.col("node"))
        every = cut_lineage(joined.unionByName(new))
        # Links of components: a graph of what is still apart.
        ends = [every.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
        edges = links.join(ends[0], "a").join(ends[1], "b").select(*_pair("ca", "cb")).distinct()
        named = connected_components(_nodes(edges), edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
        every = lookup_join(every, cut_lineage(named), ["component"], ["node"])
        joined = cut_lineage(every.select("node", F.coalesce("to", "component").alias("component")))
    named = joined.select(F.col("node").alias("key"), F.col("component").alias("to"))
    placed = lookup_join(placed, named, ["key"], ["sig"])
    return joined, placed.select("sig", "key", "n", F.coalesce("to", "component").alias("component"))


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _answers(sets: DataFrame, joined: DataFrame | None) -> DataFrame:
    if joined is None:
        joined = sets.select(F.col("key").alias("node"), F.col("key").alias("component")).limit(0)
    ids = sets.where("key is not null").groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("id"))
    named = ids.join(joined.withColumnRenamed("node", "key"), "key", "left")
    # Only sets with copies or links need a name that is not their document's own.
    named = named.where("c > 1 or component is not null").withColumn("root", F.coalesce("component", "key"))
    named = cut_lineage(named)
    roots = cut_lineage(named.groupBy("root").agg(F.min("id").alias("component_id")))
    names = cut_lineage(lookup_join(named, roots, ["root"], ["key"]).select("key", "component_id"))
    return lookup_join(sets.drop("lead"), names, ["key"], ["doc_id"]).select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest ``doc_id``.

    A row with a null id stays unless it is linked with a row that has one. Of rows with equal id and equal
    set one stays, that of the smallest text. Only texts of ids that several rows have, or of a null one, are
    cut into shingles again: the id names all other rows.
    """

    @F.arrow_udf("long")
    def key_of(text: pa.Array) -> pa.Array:
        texts = pa.record_batch([text], names=["text"])
        sets = (x for part in slices(texts, "text", _SLICE) for x in shingle_sets(part["text"], size))
        return pa.array([_key(x) if len(x) else None for x in sets], pa.int64())

    own = docs.columns
    groups = cut_lineage(components(docs, size, percent).select("doc_id", "key", "component_id"))
    # -1 and a flag stand for a null id, so that joins can use it.
    flagged = lambda x: [F.coalesce(x, F.lit(-1)).alias("__copy_id"), x.isNull().alias("__copy_none")]
    by_id, on = ["__copy_id", "__copy_none"], ["__copy_id", "__copy_none", "__copy_key"]
    several = groups.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null")
    several = cut_lineage(several.select(*flagged(F.col("doc_id"))))
    gone = groups.where("key is not null and component_id is not null and (doc_id is null or doc_id <> component_id)")
    gone = cut_lineage(gone.select(*flagged(F.col("doc_id")), F.col("key").alias("__copy_key")).distinct())
    few = lambda x: F.broadcast(x) if is_small(x, MAX_WANTED) else x
    rows = docs.select(*own, *flagged(F.col("doc_id").cast("long")))
    if several.isEmpty():
        return rows.join(few(gone.select(*by_id)), by_id, "left_anti").select(*own)
    single = rows.join(few(several), by_id, "left_anti").join(few(gone.select(*by_id)), by_id, "left_anti").select(*own)
    again = groups.where("key is not null").groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1")
    again = cut_lineage(again.select(*flagged(F.col("doc_id")), F.col("key").alias("__copy_key")))
    # Rows of such ids are told apart by their set too.
    keyed = rows.join(few(several), by_id, "left_semi").withColumn("__copy_key", key_of(F.col("text").cast("string")))
    kept = keyed.join(few(gone), on, "left_anti")
    if again.isEmpty():
        return single.unionByName(kept.select(*own))
    # Equal texts go by a hash of the row: the choice never hangs on the order of tasks.
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    chosen = kept.join(few(again), on, "left_semi").groupBy(*on).agg(
        F.min_by(F.struct(*own), F.struct("text", F.xxhash64(*plain))).alias("__copy_row")
    )
    kept = kept.join(few(again), on, "left_anti").select(*own)
    return single.unionByName(kept).unionByName(chosen.select("__copy_row.*"))
