"""Grouping vectors into topics, and merging topics."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import OUTLIER_TOPIC
from lectern.operators.skew import is_small, lookup_join
from lectern.session import cut_lineage

KEY = ("video_id", "chunk_id")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached along the edges (a, b).

    Every round each node takes the neighbour with the smallest hash, or keeps itself, and the
    graph shrinks to the nodes taken; the hash changes from round to round, so the number of rounds
    grows with the logarithm of the graph, also on long chains. Taking the smallest neighbour is
    combined before the shuffle.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b"))
    label = nodes.select("node", F.col("node").alias("part"))
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seed = F.lit(rounds)
        taken = both.groupBy("a").agg(
            F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("to"))).alias("near")
        )
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("to"))
        step = cut_lineage(taken.select("a", F.least("near", own)["to"].alias("to")))
        # One part may come to hold most nodes, and one node most edges.
        renamed = step.withColumnRenamed("a", "part")
        label = cut_lineage(
            lookup_join(label, renamed, ["part"], ["node"]).select("node", F.coalesce("to", "part").alias("part"))
        )
        half = lookup_join(edges, step.withColumnRenamed("to", "x"), ["a"], ["b"], "inner").select("b", "x")
        other = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = cut_lineage(
            lookup_join(half, other, ["b"], ["x"], "inner")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    smallest = cut_lineage(label.groupBy("part").agg(F.min("node").alias("component")))
    return lookup_join(label, smallest, ["part"], ["node"], "inner").select("node", "component")


def _by_size(sizes: DataFrame, name: str) -> DataFrame:
    """Topic ids from 0 on, the largest group first; equal sizes by name."""
    order = Window.orderBy(F.desc("n"), name)
    return sizes.select(name, (F.row_number().over(order) - 1).cast("int").alias("topic_id"))


def _width(df: DataFrame, vector_col: str) -> int:
    """Coordinates of the vectors; 0 without any row."""
    row = df.where(F.col(vector_col).isNotNull()).select(F.size(vector_col)).first()
    return row[0] if row else 0


def suggested_cell_size(df: DataFrame, share: float = 0.2, vector_col: str = "projected") -> float:
    """A cell side in proportion to the data: ``share`` of the deviation along the widest coordinate."""
    dims = _width(df, vector_col)
    if not dims:
        return 1.0
    spread = df.agg(F.array_max(F.array(*[F.stddev_pop(F.col(vector_col)[i]) for i in range(dims)]))).first()[0]
    # Rounded, so that it does not hang on the order in which the rows were summed.
    return float(f"{share * spread:.3g}") if spread else 1.0


def cluster_density(
    df: DataFrame,
    cell_size: float,
    min_points: int = 5,
    min_cluster_size: int = 5,
    keys: Sequence[str] = KEY,
    vector_col: str = "projected",
    min_share: float = 0.0,
) -> DataFrame:
    """(keys, topic_id): density clusters of low-dimensional points, noise as -1, largest first as 0.

    The space is divided into cells of side ``cell_size``. A cell is dense if it and its
    neighbours (cells that touch it) hold at least ``min_points`` points; dense cells that touch
    belong together, other cells join the touching dense cell with the smallest cluster, and
    points in cells without a dense neighbour are noise. All work is on counts per cell: any
    number of equal or close points is one row, and no pairs of points are ever formed. Cells
    touch 3^k - 1 others, so project to a few dimensions first.

    With ``min_share`` both limits are that share of all points if it is more, so that the clusters
    follow the shape of the data and not the number of points. Rows without a vector are noise.
    """
    keys = list(keys)
    dims = _width(df, vector_col)
    if not dims:
        return df.select(*keys, F.lit(OUTLIER_TOPIC).alias("topic_id"))
    if min_share:
        least = math.ceil(min_share * df.where(F.col(vector_col).isNotNull()).count())
        min_points, min_cluster_size = max(min_points, least), max(min_cluster_size, least)
    points = df.select(
        *keys, F.transform(vector_col, lambda x: F.floor(x / cell_size).cast("bigint")).alias("cell")
    )
    cells = cut_lineage(points.where("cell is not null").groupBy("cell").agg(F.count("*").alias("n")))
    touching = _touching(cells, dims)
    around = touching.groupBy(F.col("b").alias("cell")).agg(F.sum("n").alias("near"))
    dense = cut_lineage(
        cells.join(around, "cell", "left")
        .where(F.col("n") + F.coalesce("near", F.lit(0)) >= min_points)
        .select(F.col("cell").alias("node"))
    )
    links = (
        touching.join(dense.withColumnRenamed("node", "a"), "a")
        .join(dense.withColumnRenamed("node", "b"), "b")
        .where("a < b")
        .select("a", "b")
    )
    grouped = connected_components(dense, links)
    border = (
        touching.join(grouped.select(F.col("node").alias("a"), "component"), "a")
        .join(dense.withColumnRenamed("node", "b"), "b", "left_anti")
        .groupBy(F.col("b").alias("cell"))
        .agg(F.min("component").alias("component"))
    )
    placed = grouped.select(F.col("node").alias("cell"), "component").unionByName(border)
    named = cut_lineage(cells.join(placed, "cell"))
    sizes = named.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") >= min_cluster_size)
    topics = named.join(_by_size(sizes, "component"), "component").select("cell", "topic_id")
    return lookup_join(points, topics, ["cell"], keys, "left").select(
        *keys, F.coalesce("topic_id", F.lit(OUTLIER_TOPIC)).alias("topic_id")
    )


#: Steps of density for every halving, and the most there can be.
STEPS, LEVELS = 2, 128
#: The smallest share of all points a cluster may ask for: bounds the tree that the driver sees.
LEAST_SHARE = 1e-5
#: Up to so many links the components of the tree are found in one task.
MAX_TASK_LINKS = 2_000_000


def density_tree(
    df: DataFrame,
    cell_size: float,
    min_share: float = 0.005,
    min_size: int = 5,
    keys: Sequence[str] = KEY,
    vector_col: str = "projected",
) -> DataFrame:
    """(keys, topic_id): the most persistent clusters over all levels of density, noise as -1, largest first as 0.

    The space is divided into cells of side ``cell_size``; the density of a cell is the number of points
    in it and in the cells that touch it. Levels of density go down from the densest cell, ``STEPS`` for
    every halving. At each level the cells that are at least so dense and touch belong together, so the
    parts of a level lie in those of the next one: a tree. A part counts if it holds ``min_share`` of all
    points (``min_size`` points at least). Where a part falls into two or more that count, it ends and these
    begin. A cluster's persistence is the number of its points summed over the levels it lasts, each level
    weighed by the step in the inverse distance between points that it stands for. Going up from the
    leaves, a cluster is taken if it is more persistent than those below it together. The whole table is a
    cluster only if nothing ever splits off in two.

    All limits go by shares, so repeating every point changes nothing as soon as ``min_share`` of the points
    is ``min_size`` or more. All work is on counts per cell and level; no pairs of points are formed, and the
    driver sees only parts that count, at most ``1 / min_share`` a level. Cells touch 3^k - 1 others, so
    project to a few dimensions first. Rows without a vector are noise.
    """
    if min_share < LEAST_SHARE:
        raise ValueError(f"min_share is at least {LEAST_SHARE}")
    keys = list(keys)
    dims = _width(df, vector_col)
    if not dims:
        return df.select(*keys, F.lit(OUTLIER_TOPIC).alias("topic_id"))
    points = df.select(
        *keys, F.transform(vector_col, lambda x: F.floor(x / cell_size).cast("bigint")).alias("cell")
    )
    counted = points.where("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))
    cells = cut_lineage(counted.withColumn("id", F.monotonically_increasing_id()))
    pairs = cut_lineage(_touching(cells, dims))
    near = pairs.groupBy(F.col("b").alias("cell")).agg(F.sum("n").alias("near"))
    dense = cut_lineage(
        cells.join(near, "cell", "left").select("id", "cell", "n", (F.col("n") + F.coalesce("near", F.lit(0))).cast("double").alias("density"))
    )
    total, top = dense.agg(F.sum("n"), F.max("density")).first()
    least = max(min_size, math.ceil(min_share * total))
    # A level is the number of steps whose bound lies above the density; squares keep the bounds exact.
    steps = F.sequence(F.lit(0), F.lit(LEVELS - 2))
    bound = lambda k: F.col("density") * F.col("density") * F.pow(F.lit(2.0), 2 * k / STEPS) < top * top
    levelled = cut_lineage(dense.withColumn("level", F.size(F.filter(steps, bound))))
    last = levelled.agg(F.max("level")).first()[0]
    node = lambda i, k: F.col(i) * LEVELS + F.col(k)
    end = lambda x: levelled.select(F.col("cell").alias(x), F.col("id").alias(f"id_{x}"), F.col("level").alias(f"level_{x}"))
    links = (
        pairs.join(end("a"), "a")
        .join(end("b"), "b")
        .where("id_a < id_b")
        .select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.greatest("level_a", "level_b").alias("level"))
    )
    # Links that close a circle at their level connect nothing new: dropped in every task, then once more.
    forest = cut_lineage(_forest(links))
    if is_small(forest, MAX_TASK_LINKS):
        forest = cut_lineage(_forest(forest.repartition(1)))
    links = forest.withColumn("k", F.explode(F.sequence("level", F.lit(last)))).select(
        node("a", "k").alias("a"), node("b", "k").alias("b")
    )
    nodes = levelled.select("id", "n", F.explode(F.sequence("level", F.lit(last))).alias("k")).select(
        node("id", "k").alias("node"), "id", "n"
    )
    parts = cut_lineage(nodes.join(_parts(nodes, cut_lineage(links)), "node", "left").withColumn("part", F.coalesce("part", "node")))
    # The part of the next level down holds the same cells.
    below = parts.select((F.col("node") - 1).alias("part"), F.col("part").alias("parent"))
    tree = (
        parts.groupBy("part").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
        .join(below, "part", "left").select("part", "parent", "size").collect()
    )
    taken = df.sparkSession.createDataFrame([(x,) for x in _persistent([tuple(r) for r in tree], dims)], "part long")
    placed = cut_lineage(parts.join(F.broadcast(taken), "part").select("part", "id").join(levelled, "id").select("part", "cell", "n"))
    sizes = placed.groupBy("part").agg(F.sum("n").alias("n"), F.min("cell").alias("first"))
    order = Window.orderBy(F.desc("n"), "first")
    ranked = sizes.select("part", (F.row_number().over(order) - 1).cast("int").alias("topic_id"))
    topics = placed.join(F.broadcast(ranked), "part").select("cell", "topic_id")
    return lookup_join(points, topics, ["cell"], keys, "left").select(
        *keys, F.coalesce("topic_id", F.lit(OUTLIER_TOPIC)).alias("topic_id")
    )


def _forest(links: DataFrame) -> DataFrame:
    """Of the links (a, b, level) of each partition a forest that connects the same nodes at every level."""

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)):
                while (up := root.get(a, a)) != a:
                    root[a] = a = root.get(up, up)
                while (up := root.get(b, b)) != b:
                    root[b] = b = root.get(up, up)
                if a != b:
                    root[b] = a
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return links.sortWithinPartitions("level", "a", "b").mapInArrow(spanning, links.schema)


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, part) of linked nodes: the smallest node that can be reached. Small tables in one task."""
    if not is_small(links, MAX_TASK_LINKS):
        return connected_components(nodes.select("node"), links).withColumnRenamed("component", "part")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(x["a"].to_numpy(), x["b"].to_numpy()) for x in batches]
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        names, place = np.unique(np.r_[a, b], return_inverse=True)
        a, b = place[: len(a)], place[len(a) :]
        root = np.arange(len(names))
        while (root[a] != root[b]).any():
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "part"])

    return links.repartition(1).mapInArrow(joined, "node long, part long")


def _persistent(tree: list[tuple], dims: int) -> list[int]:
    """The parts taken as clusters; ``tree`` has (part, part of the next level down or null, points)."""
    inner: dict[int, list[int]] = {}
    known = {part for part, _, _ in tree}
    roots = []
    for part, parent, _ in tree:
        (inner.setdefault(parent, []) if parent in known else roots).append(part)
    step = lambda k: 2.0 ** (-k / (STEPS * dims))
    own: dict[int, float] = {}
    best: dict[int, float] = {}
    splits: dict[int, list[int]] = {}
    for part, _, size in sorted(tree, key=lambda r: (r[0] % LEVELS, r[0])):
        level, mine = part % LEVELS, inner.get(part, [])
        own[part] = size * (step(level) - step(level + 1))
        if len(mine) == 1:
            own[part] += own[mine[0]]
            splits[part] = splits[mine[0]]
        else:
            splits[part] = mine
        best[part] = max(own[part], sum(best[x] for x in splits[part]))
    taken, open_ = [], roots
    if len(roots) == 1 and splits[roots[0]]:
        open_ = list(splits[roots[0]])
    while open_:
        part = open_.pop()
        if own[part] >= sum(best[x] for x in splits[part]):
            taken.append(part)
        else:
            open_ += splits[part]
    return taken


def _touching(cells: DataFrame, dims: int) -> DataFrame:
    """(a, b, n): pairs of occupied cells that touch, with the points of a."""
    moved = cells.select(F.col("cell").alias("a"), "n", F.array().cast("array<bigint>").alias("b"))
    for i in range(dims):
        moved = moved.select(
            "a", "n", F.explode(F.array(*[F.concat("b", F.array(F.col("a")[i] + s)) for s in (-1, 0, 1)])).alias("b")
        )
    return moved.where("a <> b").join(cells.select(F.col("cell").alias("b")), "b").select("a", "b", "n")


def cluster_k(df: DataFrame, k: int, seed: int = 42, vector_col: str = "embedding") -> DataFrame:
    """Add ``topic_id`` from k-means with a fixed number of topics, the largest first as 0."""
    vectors = df.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_k").fit(vectors)
    # One pair per cluster: bounded by k.
    order = sorted(range(len(model.summary.clusterSizes)), key=lambda c: (-model.summary.clusterSizes[c], c))
    rank = F.array(*[F.lit(order.index(c)) for c in range(len(order))])
    return model.transform(vectors).withColumn("topic_id", rank[F.col("_k")].cast("int")).drop("_v", "_k")


def topic_hierarchy(distances: DataFrame, topics: DataFrame | None = None, leaves: bool = True) -> DataFrame:
    """Merge tree of topics by average linkage: Parent, Left, Right, Topics, Distance.

    ``distances`` has topic_a < topic_b and distance; pairs that are not listed have distance 1, and
    ``topics`` (topic_id) names the topics where some are in no pair. Similarities (1 - distance) add up when
    groups merge, and absent pairs add nothing, so only listed pairs are ever held. Every round merges
    all pairs that are each other's nearest; for average linkage this gives the same tree as merging one
    pair at a time. What is left without any listed pair is merged at distance 1, by the smallest topic.
    Parents are numbered by distance, after the largest topic id. No merges for fewer than two topics.

    ``Topics`` lists all topics below a merge, which grows with the square of a deep tree; ``leaves=False``
    leaves it out, as Left and Right say the same.
    """
    spark = distances.sparkSession
    edges = cut_lineage(
        distances.select(F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), (1 - F.col("distance")).alias("s"))
    )
    if topics is None:
        topics = edges.select(F.explode(F.array("a", "b")).alias("topic_id"))
    members = cut_lineage(
        topics.select(F.col("topic_id").cast("int").alias("leaf")).distinct().select("leaf", F.col("leaf").alias("rep"))
    )
    sizes = members.select("rep", F.lit(1).cast("bigint").alias("n"))
    last = members.agg(F.max("leaf")).first()[0]
    steps = []
    while not edges.isEmpty():
        size = lambda x: sizes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"))
        apart = (1 - F.col("s") / (F.col("n_a") * F.col("n_b"))).alias("d")
        measured = cut_lineage(edges.join(size("a"), "a").join(size("b"), "b").select("a", "b", apart))
        both = measured.unionByName(measured.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        near = both.groupBy("a").agg(
            F.min(F.struct("d", F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"))).alias("n")
        )
        # A pair is merged when both of its ends name it.
        found = (
            near.select("n.l", "n.r", "n.d")
            .groupBy("l", "r")
            .agg(F.count("*").alias("votes"), F.min("d").alias("d"))
            .where("votes = 2")
            .select("l", "r", "d", F.lit(len(steps)).alias("round"))
        )
        step = cut_lineage(_with_leaves(found, members) if leaves else found)
        steps.append(step)
        into = step.select(F.col("r").alias("old"), F.col("l").alias("new"))
        if leaves:
            members = cut_lineage(
                members.join(into, F.col("rep") == F.col("old"), "left").select("leaf", F.coalesce("new", "rep").alias("rep"))
            )
        moved = sizes.join(into, F.col("rep") == F.col("old"), "left")
        sizes = cut_lineage(moved.groupBy(F.coalesce("new", "rep").alias("rep")).agg(F.sum("n").alias("n")))
        moved = edges
        for end in ("a", "b"):
            moved = (
                moved.join(into, F.col(end) == F.col("old"), "left")
                .withColumn(end, F.coalesce("new", end))
                .drop("old", "new")
            )
        edges = cut_lineage(
            moved.where("a <> b")
            .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.sum("s").alias("s"))
        )
    # Groups without a listed pair join the one of the smallest topic, one after another.
    rest = sizes.select(F.col("rep").alias("r"), F.row_number().over(Window.orderBy("rep")).alias("place"))
    rest = cut_lineage(rest)
    if rest.count() > 1:
        found = rest.where("place > 1").select(
            F.lit(rest.agg(F.min("r")).first()[0]).alias("l"), "r", F.lit(1.0).alias("d"), (F.col("place") + len(steps)).alias("round")
        )
        if leaves:
            within = members.join(rest.withColumnRenamed("r", "rep"), "rep").select("leaf", "place")
            lists = (
                rest.where("place > 1").withColumnRenamed("place", "upto").join(within, F.col("place") <= F.col("upto"))
                .groupBy("r").agg(F.array_sort(F.collect_list("leaf")).alias("Topics"))
            )
            found = found.join(lists, "r").select("l", "r", "d", "round", "Topics")
        steps.append(found)
    names = ["Parent", "Left", "Right", *(["Topics"] if leaves else []), "Distance"]
    if not steps:
        empty = "Parent int, `Left` int, `Right` int, Topics array<int>, Distance double"
        return spark.createDataFrame([], empty).select(*names)
    merges = functools.reduce(DataFrame.unionByName, steps)
    number = (F.row_number().over(Window.orderBy("d", "round", "l", "r")) + F.lit(last)).cast("int")
    # A group goes by its smallest topic: its last merge before is the child, or the topic itself.
    before = F.lag("Parent").over(Window.partitionBy("l").orderBy("Parent"))
    numbered = cut_lineage(merges.withColumn("Parent", number).withColumn("Left", F.coalesce(before, F.col("l").cast("int"))))
    latest = numbered.groupBy(F.col("l").alias("r")).agg(F.max("Parent").alias("child"))
    return (
        numbered.join(latest, "r", "left")
        .withColumn("Right", F.coalesce("child", F.col("r").cast("int")))
        .withColumnRenamed("d", "Distance")
        .select(*names)
    )


def _with_leaves(found: DataFrame, members: DataFrame) -> DataFrame:
    """Merges with all topics of both sides."""
    lists = (
        members.join(found.select(F.explode(F.array("l", "r")).alias("rep"), "l", "r"), "rep")
        .groupBy("l", "r")
        .agg(F.array_sort(F.collect_list("leaf")).alias("Topics"))
    )
    return found.join(lists, ["l", "r"])


def reduce_topics(assigned: DataFrame, hierarchy: DataFrame, n: int, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, topic_id) with at most ``n`` topics: the first merges of the tree are applied.

    Outliers stay outliers; the new topics are numbered by size. The tree needs no lists of topics.
    """
    topical = assigned.where(F.col("topic_id") != OUTLIER_TOPIC)
    old = cut_lineage(topical.groupBy("topic_id").agg(F.count("*").alias("n")))
    many = max(old.count() - max(n, 1), 0)
    applied = cut_lineage(hierarchy.orderBy("Parent").limit(many).select("Parent", "Left", "Right"))
    links = applied.select(F.col("Parent").alias("a"), F.explode(F.array("Left", "Right")).alias("b"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Those of a part go by its last merge.
    parts = cut_lineage(connected_components(nodes, links))
    top = parts.groupBy("component").agg(F.max("node").alias("merged"))
    moved = parts.join(top, "component").select(F.col("node").alias("topic_id"), "merged")
    grouped = old.join(moved, "topic_id", "left").withColumn("merged", F.coalesce("merged", "topic_id"))
    ranked = _by_size(grouped.groupBy("merged").agg(F.sum("n").alias("n")), "merged")
    new = cut_lineage(
        grouped.join(ranked.withColumnRenamed("topic_id", "new_id"), "merged").select("topic_id", "new_id")
    )
    return lookup_join(assigned.select(*keys, "topic_id"), new, ["topic_id"], list(keys), "left").select(
        *keys, F.coalesce("new_id", F.lit(OUTLIER_TOPIC)).alias("topic_id")
    )


def topic_map(df: DataFrame, vectors: DataFrame, vector_col: str = "centroid") -> DataFrame:
    """Two coordinates and the number of chunks of every topic, for the distance map."""
    from lectern.operators.vectors import project_2d

    sizes = df.where(F.col("topic_id") != OUTLIER_TOPIC).groupBy("topic_id").agg(F.count("*").alias("size"))
    return project_2d(vectors, vector_col).select("topic_id", "x", "y").join(sizes, "topic_id")
