"""Hard negatives of anchor vectors, found by Fagin's threshold algorithm over blocks of rows.

Rows are integer vectors with a label. Every anchor looks for its best rows by inner product, twice: first
the best rows of its own label, its positives; then, for every positive, the best rows of other labels whose
score lies in a window below that of the positive.

Both searches are the stated query set (the anchors) against all rows, in blocks: a cell is one block of
anchors and one block of rows, both of bounded size and dealt by a hash of the id. In a cell every dimension
has its rows as a sorted list. An anchor reads each list from the end that its sign in that dimension
prefers, scores every row it meets there by random access to the whole vector, and knows that no row it has
not met can score more than the threshold, the product with the values it has come to in the lists. It
stops once the threshold lies strictly below the kth score of every window (below the window itself where
fewer are known): strictly, because a row that ties may have the smaller id. Lists are read to depths that
double, all anchors of the cell at once. The best of a cell are whole, so the best of all cells are too;
they are merged by a window that keeps only ``k`` rows a group in every task before the shuffle.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Rows of
equal id are one row, the one of the smallest label, then the smallest vector. A vector that is shorter
than others counts as if filled up with zeros. Scores and components have to fit a long. Equal scores go
to the smaller id. Without rows, anchors or positives there are no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: Rows and anchors of one cell: they bound its memory, never its result.
ROW_BLOCK = 4096
ANCHOR_BLOCK = 1024
#: Depth of the first reading, as a part of a list.
FIRST = 16
#: Cells get a task of their own up to so many.
MAX_TASKS = 100_000

_LOWEST = np.iinfo(np.int64).min
_HIGHEST = np.iinfo(np.int64).max
_FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def usable(vectors: DataFrame, vec_id: Column, label: Column, vector: Column, component) -> DataFrame:
    """(vec_id, label, v): one row per id that takes part; ``component`` makes a long of a component."""
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return (
        vectors.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~broken)
        .select("vec_id", F.struct("label", F.transform("v", lambda x: component(x).cast("long")).alias("v")).alias("row"))
        .groupBy("vec_id")
        .agg(F.min("row").alias("row"))
        .select("vec_id", "row.*")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    cells = column.combine_chunks()
    cells = pa.concat_arrays(cells.chunks) if isinstance(cells, pa.ChunkedArray) else cells
    lengths = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(cells), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = cells.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(table: pa.Table) -> int:
    return max((len(x) for x in table["v"]), default=0)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; doubles hold them exactly as long as no sum reaches 2^53."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def threshold_search(
    weights: np.ndarray, rows: np.ndarray, eligible: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every window: its number, and the anchors, rows and scores of its best ``k`` rows an anchor.

    ``rows`` are in the order in which ties go. ``eligible`` (anchor, row) says which rows count;
    ``low`` and ``high`` (anchor, window) are the windows, both ends included, none where low > high.
    """
    n = len(rows)
    order = np.argsort(rows, axis=0, kind="stable")
    lists = np.take_along_axis(rows, order, axis=0)
    scores = np.full((len(weights), n), _LOWEST)
    seen = np.zeros((len(weights), n), bool)
    active, depth = np.flatnonzero((low <= high).any(axis=1)) if n else np.empty(0, np.int64), 0
    dims = np.arange(rows.shape[1])
    while len(active):
        depth = min(n, max(2 * depth, n // FIRST, 1))
        w = weights[active]
        if depth < n:
            ends = np.zeros((2, len(dims), n), np.float32)
            ends[0, dims, order[n - depth :]] = 1
            ends[1, dims, order[:depth]] = 1
            met = ((w > 0).astype(np.float32) @ ends[0] + (w < 0).astype(np.float32) @ ends[1]) > 0
        else:
            met = np.ones((len(active), n), bool)
        new = met & ~seen[active]
        at = np.flatnonzero(new.any(axis=0))
        seen[active] |= met
        found = scores[np.ix_(active, at)]
        scores[np.ix_(active, at)] = np.where(new[:, at], _product(w, rows[at]), found)
        if depth == n:
            break
        threshold = _product(np.hstack([np.maximum(w, 0), np.minimum(w, 0)]), np.r_[lists[n - depth], lists[depth - 1]][None, :])[:, 0]
        # The kth score lies above the threshold if k scores of the window do.
        done = (threshold[:, None] < low[active]) | (low[active] > high[active])
        for i in np.flatnonzero((~done & (threshold[:, None] < high[active])).any(axis=1)):
            a = active[i]
            mine = scores[a][(scores[a] > threshold[i]) & eligible[a]]
            for j in np.flatnonzero(~done[i]):
                done[i, j] = np.count_nonzero((mine >= low[a, j]) & (mine <= high[a, j])) >= k
        active = active[~done.all(axis=1)]
    for j in range(low.shape[1]):
        inside = eligible & seen & (scores >= low[:, j, None]) & (scores <= high[:, j, None])
        mine = np.where(inside, scores, _LOWEST)
        if n > k:
            inside &= mine >= np.partition(mine, n - k, axis=1)[:, n - k, None]
        a, r = np.nonzero(inside)
        best = np.lexsort((r, -mine[a, r], a))
        a, r = a[best], r[best]
        first = np.searchsorted(a, np.arange(len(weights)))
        kept = np.arange(len(a)) - first[a] < k
        yield j, a[kept], r[kept], scores[a[kept], r[kept]]


def _cells(rows: DataFrame, anchors: DataFrame, k: int, same: bool, blocks: tuple[int, int]) -> DataFrame:
    """The best rows of every cell: ``anchors`` has vec_id, label, v and windows (id, score, low, high)."""
    n_rows, n_anchors = blocks
    number = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    tasks = min(n_rows * n_anchors, MAX_TASKS)
    left = anchors.withColumn("q", number(n_anchors)).withColumn("r", every(n_rows)).repartition(tasks, "q", "r")
    right = rows.withColumn("r", number(n_rows)).withColumn("q", every(n_anchors)).repartition(tasks, "q", "r")

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        width = max(_width(anchors), _width(rows))
        ids, label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        own, its = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        windows = anchors["windows"].to_pylist()
        most = max((len(x) for x in windows), default=0)
        low, high = np.full((len(own), most), _HIGHEST), np.full((len(own), most), _LOWEST)
        for i, given in enumerate(windows):
            for j, x in enumerate(given):
                low[i, j], high[i, j] = x["low"], x["high"]
        eligible = (its[:, None] == label[None, :]) == same
        eligible &= own[:, None] != ids[None, :]
        parts = [
            pa.table(
                {
                    "anchor_id": own[a],
                    "positive_id": pa.array([windows[i][j]["id"] for i in a], pa.int64()),
                    "positive_score": pa.array([windows[i][j]["score"] for i in a], pa.int64()),
                    "found_id": ids[r],
                    "score": score,
                }
            )
            for j, a, r, score in threshold_search(_matrix(anchors["v"], width), _matrix(rows["v"], width), eligible, low, high, k)
        ]
        empty = {c: pa.array([], pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "found_id", "score")}
        return pa.concat_tables([pa.table(empty), *parts])

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(search, _FOUND)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` come from :func:`usable`. A negative's score is from ``least`` to ``most`` per cent of the
    positive's; a positive whose score is below zero has no negatives.
    """
    rows = cut_lineage(rows)
    # Columns of their own, as the anchors meet the rows again.
    anchors = rows.where(is_anchor).select(*[F.col(c).alias(c) for c in rows.columns])
    blocks = (max(1, math.ceil(rows.count() / row_block)), max(1, math.ceil(anchors.count() / anchor_block)))
    window = lambda name, score, low, high: F.struct(name.alias("id"), score.alias("score"), low.alias("low"), high.alias("high"))
    none, lowest, highest = F.lit(None).cast("long"), F.lit(_LOWEST + 1), F.lit(_HIGHEST)
    nearest = _cells(rows, anchors.withColumn("windows", F.array(window(none, none, lowest, highest))), positives, True, blocks)
    percent = F.col("score").cast("decimal(20,0)")
    bounds = nearest.select(
        F.col("anchor_id").alias("vec_id"),
        "rank",
        window(
            F.col("found_id"),
            F.col("score"),
            F.ceil(percent * least / 100).cast("long"),
            F.floor(percent * most / 100).cast("long"),
        ).alias("window"),
    )
    windows = bounds.groupBy("vec_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "window"))), lambda x: x["window"]).alias("windows")
    )
    found = _cells(rows, anchors.join(windows, "vec_id"), negatives, False, blocks)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
