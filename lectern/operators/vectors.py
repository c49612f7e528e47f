"""Vectors: embedding, projection, nearest neighbours, topic membership."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, CountVectorizerModel, PCAModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import OUTLIER_TOPIC
from lectern.functions.text import tokens
from lectern.operators.skew import is_small
from lectern.session import cut_lineage

KEY = ("video_id", "chunk_id")
#: So many queries are broadcast at most.
QUERY_BLOCK = 20_000
#: Cells of base vectors, and rows of one block of cells: they bound memory, not the result.
MAX_PIVOTS = 1024
CELL_ROWS = 16384


# ------------------------------------------------------------ embedding


def buckets(words: Column, dims: int) -> Column:
    """The bucket of every word, from the first six hex digits of its MD5."""
    return F.transform(
        words, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint") % dims).cast("string")
    )


def bucket_counts(df: DataFrame, dims: int, words: Column, out: str = "counts") -> DataFrame:
    """Add the number of words per bucket as an array of ``dims`` numbers; no shuffle."""
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dims)], "_buckets", "_vector", 0.0)
    return (
        counter.transform(df.withColumn("_buckets", buckets(words, dims)))
        .withColumn(out, vector_to_array("_vector"))
        .drop("_buckets", "_vector")
    )


def bucket_idf(df: DataFrame, dims: int, words: Column) -> DataFrame:
    """One row: the inverse document frequency of every bucket, smoothed, as an array.

    Every task combines its texts to at most ``dims`` counts before they meet.
    """
    return _smoothed(df, F.explode(F.array_distinct(buckets(words, dims)).cast("array<int>")).alias("bucket"), "true", dims)


def _smoothed(df: DataFrame, found: Column, kept: str, dims: int) -> DataFrame:
    """The frequencies of :func:`bucket_idf` from the buckets ``found`` in every row, each once."""
    seen = (
        df.select(found)
        .where(kept)
        .groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("_seen"))
    )
    total = df.agg(F.count("*")).scalar()
    return seen.withColumn("_all", total).select(
        F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.log((F.col("_all") + 1) / (F.coalesce(F.col("_seen")[i], F.lit(0)) + 1)) + 1,
        ).alias("idf")
    )


def unit(values: Column, dims: int) -> Column:
    """Scaled to length 1 as array<float>; a null vector stays as it is."""
    square = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)
    length = F.when(square > 0, F.sqrt(square)).otherwise(1.0)
    # The length goes in as an array, so that it is worked out once per row and not per element.
    return F.zip_with(values, F.array_repeat(length, dims), lambda x, n: (x / n).cast("float"))


def embed_hashed(
    df: DataFrame, dims: int = 64, text_col: str = "normalized_text", idf: DataFrame | None = None
) -> DataFrame:
    """Add ``embedding``: hashed TF-IDF of the words, scaled to length 1, as array<float>.

    Everything but the ``dims`` document counts is row-local. Give ``idf`` to embed new texts with
    the counts of an earlier corpus; without, the counts of words are written first, so that neither ``df``
    nor the hash of a word is worked out again for the document counts.
    """
    counted = bucket_counts(df, dims, tokens(F.col(text_col)))
    if idf is None:
        counted = cut_lineage(counted)
        idf = _smoothed(counted, F.posexplode("counts").alias("bucket", "n"), "n > 0", dims)
    weighted = counted.withColumn("_idf", idf.scalar()).withColumn(
        "_weighted", F.zip_with("counts", "_idf", lambda c, w: c * w)
    )
    return weighted.withColumn("embedding", unit(F.col("_weighted"), dims)).drop("counts", "_idf", "_weighted")


def embed_with_model(
    df: DataFrame, make_predict_fn: Callable, text_col: str = "normalized_text", batch_size: int = 32
) -> DataFrame:
    """Add ``embedding`` from a caller's model: ``make_predict_fn()`` is called once per Python
    worker and returns a function from a batch of texts to a matrix."""
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", predict(F.col(text_col)))


# ------------------------------------------------------------ projection


def fit_projection(df: DataFrame, k: int, vector_col: str = "embedding") -> PCAModel:
    """Principal components of the vectors; the driver only sees a matrix of vector width."""
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(_with_vector(df, vector_col))


def project(df: DataFrame, k: int, vector_col: str = "embedding", out: str = "projected") -> DataFrame:
    """Add the ``k`` principal coordinates of every vector as array<double>.

    An axis points to where its largest coefficient is positive. Rows without a vector get null, and so
    does every row where no vector is.
    """
    known = df.where(F.col(vector_col).isNotNull())
    if known.isEmpty():
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    axes = fit_projection(known, k, vector_col).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    return df.withColumn(out, along_axes(F.col(vector_col), axes))


def along_axes(vector: Column, axes: np.ndarray) -> Column:
    """Products of a vector with the columns of a small matrix, in the JVM; null for a null vector."""
    lit = lambda axis: F.lit([float(x) for x in axis])
    dot = lambda axis: F.aggregate(F.zip_with(vector, lit(axis), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    return F.when(vector.isNotNull(), F.array(*[dot(axis) for axis in axes.T]))


def project_2d(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Add ``x`` and ``y`` for plotting."""
    placed = project(df, 2, vector_col, "_xy")
    return placed.withColumn("x", F.col("_xy")[0]).withColumn("y", F.col("_xy")[1]).drop("_xy")


def scatter_data(chunks: DataFrame, placed: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Position, topic and hover text of every chunk."""
    shown = [c for c in ("topic_id", "start_time", "normalized_text") if c in chunks.columns]
    return chunks.select(*keys, *shown).join(placed.select(*keys, "x", "y"), list(keys))


def _with_vector(df: DataFrame, vector_col: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))


# ------------------------------------------------------------ nearest neighbours


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def knn(
    base: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    query_id_col: str = "query_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` nearest base vectors of every query by squared Euclidean distance, exact.

    Up to ``query_block`` queries are broadcast: every task compares its base vectors with them, a matrix
    product at a time, keeps the ``k`` best per query, and only these are shuffled. More queries meet
    only the cells of base vectors that can hold one of their neighbours (:func:`_knn_cells`). Equal
    distances go to the lower id. Rows without a vector are left out.
    """
    base = base.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).cast("array<float>").alias("_v")
    )
    ids = queries.where(F.col(vector_col).isNotNull()).select(
        F.col(query_id_col).cast("bigint").alias("_q"), F.col(vector_col).cast("array<float>").alias("_v")
    )
    found = _knn_block(base, ids, k) if is_small(ids, query_block) else _knn_cells(base, ids, k)
    order = Window.partitionBy("_q").orderBy("distance", "_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("_q").alias(query_id_col), "rank", F.col("_id").alias(id_col), "distance")
    )


_NEAR = "_q bigint, _id bigint, distance double"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a product: fast, with rounding errors."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T


def _cell_table(base: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, list]:
    """Base vectors with their cell, the pivots, and (cell, rows, nearest, farthest, k smallest distances).

    A cell holds the vectors whose nearest pivot is the same one. Pivots are base vectors, the square root of
    their number and at most MAX_PIVOTS, chosen by a hash of the id.
    """
    n = base.count()
    wanted = min(MAX_PIVOTS, max(1, int(n**0.5)))
    chosen = base.orderBy(F.xxhash64("_id"), "_id").limit(wanted).select("_v").toArrow().combine_chunks()
    pivots = np.unique(_matrix(chosen.column("_v").combine_chunks()), axis=0) if n else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                batch = big.slice(at, 4096)
                v = _matrix(batch.column("_v"))
                cell = _distances(v, pivots).argmin(axis=1)
                far = np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1))
                arrays = [batch.column("_id"), batch.column("_v"), pa.array(cell.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_v", "cell", "far"])

    placed = cut_lineage(base.mapInArrow(assign, "_id bigint, _v array<float>, cell int, far double"))
    order = Window.partitionBy("cell").orderBy("far", "_id")
    near = placed.select("cell", "far", F.row_number().over(order).alias("k")).where(F.col("k") <= k)
    first = near.groupBy("cell").agg(F.array_sort(F.collect_list("far")).alias("first"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    return placed, pivots, sizes.join(first, "cell").orderBy("cell").collect()


def _reachable(queries: DataFrame, pivots: np.ndarray, cells: list, k: int, groups: np.ndarray | None = None) -> DataFrame:
    """(_q, _v, cell): the cells that can hold one of the ``k`` nearest vectors of a query. With ``groups``, the
    rising number of the group of each cell, a query comes once per group: (_q, _v, grp, cells).

    A vector ``f`` from its pivot is at most ``d + f`` from a query ``d`` from the pivot, so the kth smallest
    such sum bounds the kth distance; and it is at least ``d - f`` and ``f - d`` away.
    """
    names = np.array([c["cell"] for c in cells])
    low, high = (np.array([c[x] for c in cells]) for x in ("low", "high"))
    nearest = np.full((len(cells), k), np.inf)
    for i, c in enumerate(cells):
        nearest[i, : len(c["first"])] = c["first"]
    centers = pivots[names]

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = max(1, 2_000_000 // nearest.size)
        for big in batches:
            for at in range(0, big.num_rows, per):
                batch = big.slice(at, per)
                d = np.sqrt(np.maximum(_distances(_matrix(batch.column("_v")), centers), 0.0))
                sums = (d[:, :, None] + nearest[None, :, :]).reshape(len(d), -1)
                most = np.partition(sums, min(k, sums.shape[1]) - 1, axis=1)[:, min(k, sums.shape[1]) - 1, None]
                # Distances by products are off by some 1e-8 of the lengths; the slack is far above.
                slack = 1e-5 * (1.0 + np.where(np.isfinite(most), most, 0.0) + d)
                q, cell = np.nonzero(np.maximum(d - high, low - d) <= most + slack)
                if groups is not None:
                    grp = groups[cell]
                    first = np.flatnonzero(np.r_[len(q) > 0, (q[1:] != q[:-1]) | (grp[1:] != grp[:-1])][: len(q)])
                    pick = pa.array(q[first])
                    held = pa.ListArray.from_arrays(np.r_[first, len(q)].astype(np.int32), names[cell].astype(np.int32))
                    arrays = [batch.column("_q").take(pick), batch.column("_v").take(pick), pa.array(grp[first].astype(np.int32)), held]
                    yield pa.RecordBatch.from_arrays(arrays, names=["_q", "_v", "grp", "cells"])
                    continue
                pick = pa.array(q)
                arrays = [batch.column("_q").take(pick), batch.column("_v").take(pick), pa.array(names[cell].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["_q", "_v", "cell"])

    shape = "cell int" if groups is None else "grp int, cells array<int>"
    return queries.mapInArrow(reach, f"_q bigint, _v array<float>, {shape}")


def _knn_cells(base: DataFrame, queries: DataFrame, k: int, rows: int = CELL_ROWS) -> DataFrame:
    """Candidates for the ``k`` nearest: queries meet the cells they can reach, cut into bounded blocks.

    Cells of ``rows`` vectors together are a group, and a query is moved once per group with the list of those
    it can reach, however many these are. A group with many vectors (one large cell) or many queries is dealt
    over blocks of about ``rows`` of each, so a cell that holds a third of everything is many tasks. What the
    driver sees is one row per cell.
    """
    spark = base.sparkSession
    placed, pivots, cells = _cell_table(base, k)
    if not cells:
        return spark.createDataFrame([], _NEAR)
    group_of, held = [], 0
    for c in cells:
        new = not group_of or held + c["n"] > rows
        group_of.append((group_of[-1] + 1 if group_of else 0) if new else group_of[-1])
        held = c["n"] if new else held + c["n"]
    met = cut_lineage(_reachable(queries, pivots, cells, k, np.array(group_of)))
    asked = {r["grp"]: r["n"] for r in met.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    size = np.bincount(group_of, [c["n"] for c in cells]).astype(int).tolist()
    blocks = [(g, -(-n // rows), -(-asked[g] // rows)) for g, n in enumerate(size) if g in asked]
    if not blocks:
        return spark.createDataFrame([], _NEAR)
    shape = F.broadcast(spark.createDataFrame(blocks, "grp int, parts bigint, lots bigint"))
    groups = F.broadcast(spark.createDataFrame([(c["cell"], g) for c, g in zip(cells, group_of, strict=True)], "cell int, grp int"))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    block = ["grp", "part", "lot"]
    left = met.join(shape, "grp").withColumn("lot", number("_q", "lots")).withColumn("part", every("parts"))
    right = placed.join(groups, "cell").join(shape, "grp").withColumn("part", number("_id", "parts")).withColumn("lot", every("lots"))

    def ranked(row: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> np.ndarray:
        """Where the ``k`` best of every row are."""
        by = np.lexsort((ids, exact, row))
        return by[np.arange(len(by)) - np.searchsorted(row[by], row[by]) < k]

    def nearest(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if queries.num_rows and vectors.num_rows:
            q, b = _matrix(queries["_v"].combine_chunks()), _matrix(vectors["_v"].combine_chunks())
            ids, cell = vectors["_id"].to_numpy(), vectors["cell"].to_numpy()
            lists = queries["cells"].combine_chunks()
            wants, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            asker = asker[np.argsort(wants, kind="stable")]
            wants = np.sort(wants)
            for name in np.unique(cell):
                here = np.flatnonzero(cell == name)
                askers = asker[np.searchsorted(wants, name) : np.searchsorted(wants, name, side="right")]
                own, near = ids[here], b[here]
                take, per = min(k, len(here)), max(1, 2_000_000 // len(here))
                for at in range(0, len(askers), per):
                    some_rows = askers[at : at + per]
                    some = q[some_rows]
                    rough = _distances(some, near)
                    edge = np.partition(rough, take - 1, axis=1)[:, take - 1] + 1e-9 * (1.0 + (some * some).sum(axis=1))
                    i, j = np.nonzero(rough <= edge[:, None])
                    exact = np.concatenate(
                        [((near[j[c : c + 50_000]] - some[i[c : c + 50_000]]) ** 2).sum(axis=1) for c in range(0, len(i), 50_000)]
                    )
                    kept = ranked(i, own[j], exact)
                    out.append((some_rows[i[kept]], own[j[kept]], exact[kept]))
        row, found, exact = (np.concatenate(x) for x in zip(*out, strict=True))
        kept = ranked(row, found, exact)
        names = queries["_q"].to_numpy()[row[kept]] if len(kept) else row
        return pa.table({"_q": names, "_id": found[kept], "distance": exact[kept]})

    return left.select(*block, "_q", "_v", "cells").groupBy(*block).cogroup(
        right.select(*block, "_id", "_v", "cell").groupBy(*block)
    ).applyInArrow(nearest, _NEAR)


def _knn_block(base: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Candidates for the ``k`` nearest of a few queries: the best of every task."""
    spark = base.sparkSession
    table = ids.toArrow().combine_chunks()
    names = table.column("_q").to_numpy()
    if not len(names):
        return spark.createDataFrame([], _NEAR)
    given = spark.sparkContext.broadcast((names, _matrix(table.column("_v").combine_chunks())))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = given.value
        qq = (q * q).sum(axis=1)
        slack = 1e-9 * (1.0 + qq)
        per = max(1, 2_000_000 // len(qids))
        # The best so far as three columns, sorted by query, distance and id.
        row = np.empty(0, dtype=np.int64)
        name = np.empty(0, dtype=np.int64)
        dist = np.empty(0)
        limit = np.full(len(qids), np.inf)
        for big in batches:
            for at in range(0, big.num_rows, per):
                batch = big.slice(at, per)
                b = _matrix(batch.column("_v"))
                bid = batch.column("_id").to_numpy()
                rough = qq[:, None] + (b * b).sum(axis=1)[None, :] - 2 * q @ b.T
                # The product form is fast but rounds; whatever could be among the k is measured again.
                take = min(k, len(bid))
                edge = np.minimum(np.partition(rough, take - 1, axis=1)[:, take - 1], limit)
                i, j = np.nonzero(rough <= (edge + slack)[:, None])
                if not len(i):
                    continue
                exact = np.concatenate(
                    [((b[j[c : c + 50_000]] - q[i[c : c + 50_000]]) ** 2).sum(axis=1) for c in range(0, len(i), 50_000)]
                )
                row, name, dist = np.r_[row, i], np.r_[name, bid[j]], np.r_[dist, exact]
                order = np.lexsort((name, dist, row))
                row, name, dist = row[order], name[order], dist[order]
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
                limit[row[place == k - 1]] = dist[place == k - 1]
                row, name, dist = row[place < k], name[place < k], dist[place < k]
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[row]), pa.array(name), pa.array(dist)], names=["_q", "_id", "distance"]
            )

    return base.mapInArrow(nearest, _NEAR)


# ------------------------------------------------------------ topic membership


def centroids(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Mean vector of every topic without the outliers; partial sums first, so any topic size is fine."""
    topical = _with_vector(df.where(F.col("topic_id") != OUTLIER_TOPIC), vector_col)
    return topical.groupBy("topic_id").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))


def topic_probabilities(
    df: DataFrame,
    centers: DataFrame,
    keys: Sequence[str] = KEY,
    vector_col: str = "embedding",
    max_topics: int = 50_000,
) -> DataFrame:
    """(keys, topic_id, prob): cosine with every centroid, negatives as 0, divided by the row sum.

    The centroids are a checked broadcast; the products are matrix products on Arrow batches.
    """
    keys = list(keys)
    found = centers.orderBy("topic_id").limit(max_topics + 1).toArrow().combine_chunks()
    if found.num_rows > max_topics:
        raise ValueError(f"more than {max_topics} topics; reduce them first")
    names = found.column("topic_id").to_numpy()
    c = _matrix(found.column("centroid").combine_chunks())
    length = np.linalg.norm(c, axis=1, keepdims=True)
    given = df.sparkSession.sparkContext.broadcast((names, c / np.where(length > 0, length, 1.0)))
    rows = df.select(*keys, F.col(vector_col).cast("array<float>").alias("_v"))
    schema = T.StructType([f for f in rows.schema if f.name in keys])
    schema = schema.add("topic_id", T.IntegerType()).add("prob", T.DoubleType())

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, unit_centers = given.value
        per = max(1, 1_000_000 // max(1, len(topics)))
        for big in batches:
            for at in range(0, big.num_rows, per):
                batch = big.slice(at, per)
                v = _matrix(batch.column("_v"))
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                close = np.maximum(v @ unit_centers.T / np.where(norm > 0, norm, 1.0), 0.0)
                total = close.sum(axis=1, keepdims=True)
                prob = close / np.where(total > 0, total, 1.0)
                pick = pa.array(np.repeat(np.arange(len(v)), len(topics)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).take(pick) for n in keys]
                    + [pa.array(np.tile(topics, len(v)).astype("int32")), pa.array(prob.ravel())],
                    names=[*keys, "topic_id", "prob"],
                )

    return rows.mapInArrow(share, schema)


def topic_top_docs(probs: DataFrame, n: int = 5, keys: Sequence[str] = KEY) -> DataFrame:
    """The ``n`` chunks with the highest membership of every topic, best first."""
    order = Window.partitionBy("topic_id").orderBy(F.desc(F.round("prob", 9)), *keys)
    return probs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
