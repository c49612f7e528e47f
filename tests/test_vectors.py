import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import clusters as cl
from lectern.operators import vectors as vc


def frame(spark, ids, matrix, name="vec_id"):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


def plain_knn(ids, base, qids, queries, k):
    out = {}
    for q, v in zip(qids, queries):
        d = ((base.astype("float64") - v.astype("float64")) ** 2).sum(axis=1)
        order = np.lexsort((ids, d))[:k]
        out[int(q)] = [int(ids[i]) for i in order]
    return out


@pytest.mark.parametrize("block", [20_000, 4])
def test_knn_equals_brute_force(spark, block):
    rng = np.random.default_rng(1234)
    base = rng.random((1000, 64)).astype("float32")
    base[500:540] = base[3]  # a group of equal vectors: ties go to the lower id
    queries = np.concatenate([rng.random((9, 64)).astype("float32"), base[3:4]])
    ids = rng.permutation(1000)
    found = vc.knn(
        frame(spark, ids, base).repartition(5), frame(spark, range(10), queries, "query_id"), 4, query_block=block
    )
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == plain_knn(ids, base, range(10), queries, 4)


def test_knn_of_more_queries_than_a_block_reads_only_near_cells(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 20, (25, 6))
    base = np.concatenate([c + rng.normal(0, 0.4, (100, 6)) for c in centers] + [np.tile(centers[:1], (900, 1))]).astype("float32")
    ids = rng.permutation(len(base))
    queries = (base[rng.integers(0, len(base), 600)] + rng.normal(0, 0.1, (600, 6))).astype("float32")
    queries[:40], queries[40] = base[-1], 500.0
    table = frame(spark, ids, base).repartition(4).select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_v"))
    asked = frame(spark, range(600), queries, "query_id")
    for rows in (vc.CELL_ROWS, 64):
        found = vc._knn_cells(table, asked.select(F.col("query_id").alias("_q"), F.col("embedding").alias("_v")), 7, rows)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r["_q"], r.distance, r["_id"])):
            got.setdefault(r["_q"], []).append(r["_id"])
        assert {q: x[:7] for q, x in got.items()} == plain_knn(ids, base, range(600), queries, 7)
    _, pivots, cells = vc._cell_table(table, 7)
    met = vc._reachable(asked.select(F.col("query_id").alias("_q"), F.col("embedding").alias("_v")), pivots, cells, 7)
    size = {c["cell"]: c["n"] for c in cells}
    compared = sum(size[r.cell] for r in met.collect())
    assert compared < 0.25 * len(base) * len(queries)


def test_knn_moves_a_query_once_per_group_of_cells(spark, monkeypatch):
    """In many dimensions a query reaches every cell: 40 of them here, which lie in two blocks."""
    rng = np.random.default_rng(6)
    base = rng.random((1600, 32)).astype("float32")
    table = frame(spark, range(1600), base).repartition(3)
    written = []
    monkeypatch.setattr(vc, "cut_lineage", lambda d: written.append(d.localCheckpoint()) or written[-1])
    cut = lambda df, name: df.select(F.col("vec_id").alias(name), F.col("embedding").alias("_v"))
    found = vc._knn_cells(cut(table, "_id"), cut(table.where("vec_id < 50"), "_q"), 5, 900).collect()
    placed, met = written
    assert placed.select("cell").distinct().count() > 30 and met.count() <= 50 * 2
    got = {}
    for r in sorted(found, key=lambda r: (r["_q"], r.distance, r["_id"])):
        got.setdefault(r["_q"], []).append(r["_id"])
    assert {q: x[:5] for q, x in got.items()} == plain_knn(np.arange(1600), base, range(50), base[:50], 5)


def test_knn_with_fewer_vectors_than_k_and_no_queries(spark):
    base = frame(spark, [1, 2], np.eye(2))
    assert vc.knn(base, base.withColumnRenamed("vec_id", "query_id"), 5).count() == 4
    assert vc.knn(base, base.where("vec_id > 9").withColumnRenamed("vec_id", "query_id"), 5).count() == 0
    assert vc.knn(base, base.withColumnRenamed("vec_id", "query_id"), 5, query_block=0).count() == 4
    assert vc.knn(base.where("vec_id > 9"), base.withColumnRenamed("vec_id", "query_id"), 5, query_block=0).count() == 0


def test_embedding_is_unit_and_repeatable(spark):
    df = spark.createDataFrame([(0, "cat dog"), (1, "cat cat bird"), (2, "")], "k int, normalized_text string")
    one = {r.k: r.embedding for r in vc.embed_hashed(df, 32).collect()}
    two = {r.k: r.embedding for r in vc.embed_hashed(df.repartition(3), 32).collect()}
    assert one == two and all(len(v) == 32 for v in one.values())
    assert np.linalg.norm(one[0]) == pytest.approx(1, abs=1e-6) and not any(one[2])


def test_texts_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, f"word w{i % 3}") for i in range(12)], "id long, normalized_text string")
    got = {r.id: r.embedding for r in vc.embed_hashed(df.mapInArrow(read, df.schema), 8).collect()}
    assert seen.value == 12
    given = vc.bucket_idf(df, 8, vc.tokens(vc.F.col("normalized_text")))
    assert got == {r.id: r.embedding for r in vc.embed_hashed(df, 8, idf=given).collect()}


def test_projection_keeps_the_main_direction(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=200)
    m = np.outer(t, [3.0, 4.0, 0.0]) + rng.normal(scale=0.01, size=(200, 3))
    got = vc.project_2d(frame(spark, range(200), m)).orderBy("vec_id").collect()
    assert abs(np.corrcoef([r.x for r in got], t)[0, 1]) > 0.999


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(4)
    v = frame(spark, range(60), rng.random((60, 8)) - 0.2).withColumn("topic_id", (F.col("vec_id") % 4 - 1).cast("int"))
    probs = vc.topic_probabilities(v, vc.centroids(v), ["vec_id"])
    sums = probs.groupBy("vec_id").agg(F.sum("prob").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 60 and all(r.s == pytest.approx(1) and r.n == 3 for r in sums)
    top = vc.topic_top_docs(probs, 5, ["vec_id"])
    assert top.groupBy("topic_id").count().where("count = 5").count() == 3
    with pytest.raises(ValueError):
        vc.topic_probabilities(v, vc.centroids(v), ["vec_id"], max_topics=2)


def test_components_equal_union_find(spark):
    rnd = random.Random(8)
    nodes = list(range(120))
    edges = [(i, i + 1) for i in range(40)] + [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(30)]
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = cl.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "a bigint, b bigint")
    )
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}


def test_density_finds_blobs_and_noise(spark):
    rng = np.random.default_rng(6)
    blobs = [rng.normal(c, 0.05, size=(n, 3)) for c, n in (((0, 0, 0), 80), ((2, 2, 2), 50), ((-2, 1, 0), 30))]
    noise = np.array([[9.0, 9, 9], [-9, 9, 1], [5, -7, 3]])
    copies = np.tile([[4.0, 4.0, -4.0]], (40, 1))
    m = np.concatenate([*blobs, copies, noise])
    df = frame(spark, range(len(m)), m).withColumnRenamed("embedding", "projected")
    got = {r.vec_id: r.topic_id for r in cl.cluster_density(df, 0.2, 5, 5, ["vec_id"]).collect()}
    parts = np.split(np.arange(len(m)), np.cumsum([80, 50, 30, 40]))
    assert [{got[i] for i in p} for p in parts] == [{0}, {1}, {3}, {2}, {-1}]


def test_small_clusters_become_noise(spark):
    m = [[0.0, 0.0]] * 9 + [[5.0, 5.0]] * 4
    df = frame(spark, range(13), m).withColumnRenamed("embedding", "projected")
    got = [r.topic_id for r in cl.cluster_density(df, 0.5, 3, 5, ["vec_id"]).orderBy("vec_id").collect()]
    assert got == [0] * 9 + [-1] * 4


def test_density_by_share_does_not_depend_on_the_number_of_points(spark):
    rnd = random.Random(3)
    blobs = [(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)]
    points = [(rnd.gauss(x, 0.3), rnd.gauss(y, 0.3)) for x, y in blobs for _ in range(120)]
    points += [(rnd.uniform(-2, 5), rnd.uniform(-2, 5)) for _ in range(40)]
    found = []
    for times in (1, 10):
        rows = [(i * times + k, [x, y]) for i, (x, y) in enumerate(points) for k in range(times)]
        df = spark.createDataFrame(rows, "vec_id bigint, projected array<double>")
        got = cl.cluster_density(df, 0.3, 3, 3, ["vec_id"], min_share=0.03).collect()
        found.append({r.vec_id // times: r.topic_id for r in got})
    assert found[0] == found[1] and set(found[0].values()) >= {0, 1, 2}


def blobs_of_all_kinds(rng):
    """A dense pair side by side, a thin wide cloud, and scattered points."""
    parts = [((0, 0), 0.1, 150), ((1.1, 0), 0.1, 150), ((8, 8), 1.2, 200)]
    points = [(rng.gauss(x, s), rng.gauss(y, s)) for (x, y), s, n in parts for _ in range(n)]
    return points + [(rng.uniform(-20, 30), rng.uniform(-20, 30)) for _ in range(40)]


def test_tree_finds_clusters_of_different_density_whatever_the_number_of_points(spark):
    points = blobs_of_all_kinds(random.Random(4))
    found = []
    for times in (1, 10, 30):
        rows = [(i * times + k, [x, y]) for i, (x, y) in enumerate(points) for k in range(times)]
        df = spark.createDataFrame(rows, "vec_id bigint, projected array<double>").repartition(3)
        got = cl.density_tree(df, 0.4, 0.05, 5, ["vec_id"]).collect()
        assert len(got) == len(rows)
        per = {}
        for r in got:
            per.setdefault(r.vec_id // times, set()).add(r.topic_id)
        assert all(len(x) == 1 for x in per.values())
        found.append({i: x.pop() for i, x in per.items()})
    assert found[0] == found[1] == found[2]
    main = [max(set(g), key=g.count) for g in ([found[0][i] for i in p] for p in (range(150), range(150, 300), range(300, 500)))]
    assert sorted(main) == [0, 1, 2]
    assert sum(found[0][i] == main[0] for i in range(150)) > 140 and sum(found[0][i] == main[2] for i in range(300, 500)) > 150
    assert sum(found[0][i] == -1 for i in range(500, 540)) > 25


def brute_tree(cells, dims, least):
    """Clusters of counted cells by walking every level and part."""
    near = {c: [d for d in cells if d != c and all(abs(x - y) <= 1 for x, y in zip(c, d))] for c in cells}
    density = {c: cells[c] + sum(cells[d] for d in near[c]) for c in cells}
    top = max(density.values())
    level = {c: sum(density[c] ** 2 * 2.0**k < top**2 for k in range(127)) for c in cells}
    last = max(level.values())

    def parts(k, among):
        left, out = {c for c in among if level[c] <= k}, []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                c = todo.pop()
                part.add(c)
                todo += [d for d in near[c] if d in left]
                left -= set(near[c])
            out.append(frozenset(part))
        return [p for p in out if sum(cells[c] for c in p) >= least]

    weight = lambda part, k: sum(cells[c] for c in part) * (2.0 ** (-k / 2 / dims) - 2.0 ** (-(k + 1) / 2 / dims))

    def follow(part, k):
        """(persistence while it does not split, clusters it splits into)."""
        mine, inner = weight(part, k), parts(k - 1, part) if k else []
        if len(inner) == 1:
            more, splits = follow(inner[0], k - 1)
            return mine + more, splits
        return mine, [(p, k - 1) for p in inner]

    def best(part, k):
        own, splits = follow(part, k)
        below = [best(*x) for x in splits]
        if own >= sum(x[0] for x in below):
            return own, [part]
        return sum(x[0] for x in below), [p for x in below for p in x[1]]

    roots = [(p, last) for p in parts(last, cells)]
    if len(roots) == 1:
        roots = follow(*roots[0])[1] or roots
    return [p for r in roots for p in best(*r)[1]]


def test_tree_equals_walking_every_level(spark, monkeypatch):
    for seed in range(3):
        rng = random.Random(seed)
        points = blobs_of_all_kinds(rng) + [(rng.gauss(-6, 0.5), rng.gauss(3, 0.2)) for _ in range(60)]
        cells = {}
        for x, y in points:
            c = (math.floor(x / 0.5), math.floor(y / 0.5))
            cells[c] = cells.get(c, 0) + 1
        want = sorted(brute_tree(cells, 2, 15), key=lambda p: (-sum(cells[c] for c in p), min(p)))
        if seed == 2:
            # The way of tables that are too large for one task.
            monkeypatch.setattr(cl, "MAX_TASK_LINKS", 3)
        df = spark.createDataFrame([(i, [x, y]) for i, (x, y) in enumerate(points)], "vec_id bigint, projected array<double>")
        got = cl.density_tree(df, 0.5, 0.00001, 15, ["vec_id"]).collect()
        topic = {c: t for t, p in enumerate(want) for c in p}
        cell = lambda i: (math.floor(points[i][0] / 0.5), math.floor(points[i][1] / 0.5))
        assert {r.vec_id: r.topic_id for r in got} == {i: topic.get(cell(i), -1) for i in range(len(points))}


def test_tree_of_one_cluster_small_and_empty_tables(spark):
    rows = [(i, [0.0, 0.1]) for i in range(9)] + [(9, None), (10, [50.0, 50.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, projected array<double>")
    got = {r.vec_id: r.topic_id for r in cl.density_tree(df, 0.5, keys=["vec_id"]).collect()}
    assert got == {**{i: 0 for i in range(9)}, 9: -1, 10: -1}
    assert {r.topic_id for r in cl.density_tree(df, 0.5, min_size=50, keys=["vec_id"]).collect()} == {-1}
    assert cl.density_tree(df.limit(0), 0.5, keys=["vec_id"]).collect() == []
    with pytest.raises(ValueError):
        cl.density_tree(df, 0.5, min_share=0.0, keys=["vec_id"])
    vectors = df.select("vec_id", F.col("projected").alias("embedding"))
    assert vc.project_2d(vectors.limit(0)).collect() == []
    assert [r.projected for r in vc.project(vectors.where("embedding is null"), 2).collect()] == [None]


def test_no_points_and_null_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, projected array<double>")
    assert cl.suggested_cell_size(empty) == 1.0
    assert cl.cluster_density(empty, 0.3, 3, 3, ["vec_id"]).count() == 0
    some = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [0.1, 0.0])], "vec_id bigint, projected array<double>")
    got = {r.vec_id: r.topic_id for r in cl.cluster_density(some, 0.3, 2, 2, ["vec_id"]).collect()}
    assert got == {1: 0, 2: -1, 3: 0}
    vectors = some.select("vec_id", F.col("projected").cast("array<float>").alias("embedding"))
    near = vc.knn(vectors, vectors.withColumnRenamed("vec_id", "query_id"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in near) == [(1, 1, 1), (1, 2, 3), (3, 1, 3), (3, 2, 1)]


def test_kmeans_topics_by_size(spark):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(0, 0.1, (10, 2)), rng.normal(5, 0.1, (30, 2))])
    got = [r.topic_id for r in cl.cluster_k(frame(spark, range(40), m), 2).orderBy("vec_id").collect()]
    assert got == [1] * 10 + [0] * 30


def greedy_tree(dist, n):
    """Average linkage, one pair at a time."""
    clusters = {i: (i,) for i in range(n)}
    ids = dict(clusters)
    out, nxt = [], n
    names = {(i,): i for i in range(n)}
    while len(clusters) > 1:
        best = None
        keys = sorted(clusters)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                d = np.mean([dist[min(x, y), max(x, y)] for x in clusters[a] for y in clusters[b]])
                best = min(best, (d, a, b)) if best else (d, a, b)
        d, a, b = best
        left, right = clusters[a], clusters.pop(b)
        merged = tuple(sorted(left + right))
        out.append((nxt, names[left], names[right], merged, round(float(d), 9)))
        clusters[a] = merged
        names[merged] = nxt
        nxt += 1
    del ids
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_equals_greedy_linkage(spark, seed):
    rng = np.random.default_rng(seed)
    n = 11
    dist = {(a, b): float(rng.random()) for a in range(n) for b in range(a + 1, n)}
    df = spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "topic_a int, topic_b int, distance double")
    tree = cl.topic_hierarchy(df)
    got = [(r.Parent, r.Left, r.Right, tuple(r.Topics), round(r.Distance, 9)) for r in tree.orderBy("Parent").collect()]
    assert got == greedy_tree(dist, n)

    rows = [("v", i, i % n if i % 5 else -1) for i in range(100)]
    assigned = spark.createDataFrame(rows, "video_id string, chunk_id bigint, topic_id int")
    reduced = {r.chunk_id: r.topic_id for r in cl.reduce_topics(assigned, tree, 4).collect()}
    groups = {frozenset(i for i, t in reduced.items() if t == k) for k in set(reduced.values()) - {-1}}
    whole = {(i,): {c for _, c, t in rows if t == i} for i in range(n)}
    for _, _, _, topics, _ in got[: n - 4]:
        whole = {k: s for k, s in whole.items() if not set(k) <= set(topics)} | {
            topics: set().union(*(s for k, s in whole.items() if set(k) <= set(topics)))
        }
    assert groups == {frozenset(s) for s in whole.values()}
    sizes = [sum(t == k for t in reduced.values()) for k in range(4)]
    assert sizes == sorted(sizes, reverse=True)
    assert all((reduced[c] == -1) == (t == -1) for _, c, t in rows)


def test_hierarchy_of_many_topics_that_share_little(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 560
    near = {}
    for a in range(n - 6):
        for b in {int(x) for x in rng.integers(0, n - 6, 3)} - {a}:
            near[min(a, b), max(a, b)] = float(rng.uniform(0.05, 0.99))
    # One pair at a time on the full matrix of similarities.
    s, sizes, names = np.zeros((n, n)), np.ones(n), list(range(n))
    for (a, b), d in near.items():
        s[a, b] = s[b, a] = 1 - d
    alive, want, members = np.ones(n, bool), [], [{i} for i in range(n)]
    for step in range(n - 1):
        d = 1 - s / np.outer(sizes, sizes)
        d[~alive], d[:, ~alive] = 9, 9
        d[np.tril_indices(n)] = 9
        a, b = divmod(int(d.argmin()), n)
        members[a] |= members[b]
        want.append((n + step, names[a], names[b], tuple(sorted(members[a])), round(d[a, b], 9)))
        s[a] += s[b]
        s[:, a] += s[:, b]
        s[a, a] = 0
        sizes[a] += sizes[b]
        alive[b], names[a] = False, n + step
    rounds = []
    with_leaves = cl._with_leaves
    monkeypatch.setattr(cl, "_with_leaves", lambda *x: rounds.append(1) or with_leaves(*x))
    df = spark.createDataFrame([(a, b, d) for (a, b), d in near.items()], "topic_a int, topic_b int, distance double")
    tree = cl.topic_hierarchy(df, spark.createDataFrame([(i,) for i in range(n)], "topic_id int")).orderBy("Parent").collect()
    assert [(r.Parent, r.Left, r.Right, tuple(r.Topics), round(r.Distance, 9)) for r in tree] == want
    # Rounds, not one step per merge.
    assert len(rounds) < 40


def test_hierarchy_of_one_topic_is_empty(spark):
    df = spark.createDataFrame([], "topic_a int, topic_b int, distance double")
    assert cl.topic_hierarchy(df).count() == 0
