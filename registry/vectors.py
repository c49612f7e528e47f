"""Registered queries: vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import vectors as vc
from registry import base as b
from registry.base import sql

Q: dict = {}
SQL: dict = {}


def query(name, oracle=None):
    def add(fn):
        Q[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn

    return add


DIMS = 64
b.CTES["cells"] = (
    ("chunk_words",),
    f"""SELECT video_id, chunk_id, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) % {DIMS} AS dim, count(*) AS n
        FROM chunk_words GROUP BY ALL""",
)
b.CTES["idf"] = (
    ("cells",),
    f"""SELECT dim, ln(((SELECT count(*) FROM chunks) + 1) / (count(c.dim) + 1)) + 1 AS w
        FROM (SELECT unnest(range({DIMS})) AS dim) a LEFT JOIN cells c USING (dim) GROUP BY dim""",
)
b.CTES["embedded"] = (
    ("cells", "idf"),
    """SELECT video_id, chunk_id, dim, CAST(n * w / sqrt(sum(n * w * n * w) OVER (PARTITION BY video_id, chunk_id)) AS FLOAT) AS v
       FROM cells JOIN idf USING (dim)""",
)


def embedded(spark, d, of=None):
    return vc.embed_hashed(b.chunks(spark, d) if of is None else of, DIMS)


@query(
    "embed_hashed",
    sql("embedded", "SELECT video_id, chunk_id, dim, round(CAST(v AS DOUBLE), 6) AS value FROM embedded"),
)
def _(spark, d):
    """Non-zero cells of the chunk vectors."""
    cells = b.stored(embedded(spark, d)).select("video_id", "chunk_id", F.posexplode("embedding").alias("dim", "value"))
    return cells.where("value <> 0").select(
        "video_id", "chunk_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


def shape_model():
    """A stand-in for a caller's embedding model."""
    import numpy as np

    def predict(texts):
        return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], dtype="float32")

    return predict


@query(
    "embed_with_model",
    sql(
        "chunks",
        """SELECT video_id, chunk_id, CAST(length(normalized_text) AS DOUBLE) AS v0,
                  CAST(length(normalized_text) - length(replace(normalized_text, ' ', '')) AS DOUBLE) AS v1,
                  CAST(length(normalized_text) - length(replace(normalized_text, 'e', '')) AS DOUBLE) AS v2 FROM chunks""",
    ),
)
def _(spark, d):
    found = vc.embed_with_model(b.chunks(spark, d), shape_model)
    return found.select("video_id", "chunk_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(3)])


#: The covariance is squared so often that only its largest axis is left.
SQUARINGS = 14


def axes_ctes(name: str, cells: str, rows: str, k: int) -> str:
    """Common table expressions that end in ``{name}_axes`` (t, i, v): the ``k`` principal axes of the vectors
    whose non-zero cells are ``cells`` (key, i, v), out of ``rows`` vectors; one axis after the other is taken
    out of the covariance. The largest coefficient of an axis is positive."""
    parts = [
        f"""{name}_c0 AS MATERIALIZED (
          SELECT i, j, (coalesce(s, 0) - n * a.m * b.m) / (n - 1) AS v
          FROM (SELECT i, sum(v) / any_value(r.n) AS m FROM {cells}, ({rows}) r GROUP BY i) a
          CROSS JOIN (SELECT i AS j, sum(v) / any_value(r.n) AS m FROM {cells}, ({rows}) r GROUP BY i) b
          CROSS JOIN ({rows}) r
          LEFT JOIN (SELECT x.i, y.i AS j, sum(x.v * y.v) AS s FROM {cells} x JOIN {cells} y USING (key) GROUP BY ALL) USING (i, j))"""
    ]
    for t in range(k):
        parts.append(
            f"""{name}_p{t} AS (
          SELECT 0 AS k, i, j, v / (SELECT sum(v) FROM {name}_c{t} WHERE i = j) AS v FROM {name}_c{t}
          UNION ALL
          SELECT k, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (
            SELECT a.k + 1 AS k, a.i, b.j, sum(a.v * b.v) AS v FROM {name}_p{t} a JOIN {name}_p{t} b ON a.j = b.i
            WHERE a.k < {SQUARINGS} GROUP BY a.k, a.i, b.j)),
        {name}_a{t} AS MATERIALIZED (
          SELECT i, v * sign(arg_max(v, abs(v)) OVER ()) / sqrt(sum(v * v) OVER ()) AS v FROM {name}_p{t}
          WHERE k = {SQUARINGS} AND j = (SELECT arg_max(i, v) FROM {name}_p{t} WHERE k = {SQUARINGS} AND i = j)),
        {name}_c{t + 1} AS MATERIALIZED (
          SELECT c.i, c.j, c.v - l.l * x.v * y.v AS v
          FROM {name}_c{t} c JOIN {name}_a{t} x ON x.i = c.i JOIN {name}_a{t} y ON y.i = c.j
          CROSS JOIN (SELECT sum(x.v * c.v * y.v) AS l FROM {name}_c{t} c JOIN {name}_a{t} x ON x.i = c.i JOIN {name}_a{t} y ON y.i = c.j) l)"""
        )
    every = " UNION ALL ".join(f"SELECT {t} AS t, i, v FROM {name}_a{t}" for t in range(k))
    parts.append(f"{name}_axes AS MATERIALIZED ({every})")
    return ",\n".join(parts)


def coordinates(name: str, cells: str) -> str:
    """(key, t, value): the coordinates of the vectors that have a cell other than zero."""
    return f"SELECT key, t, sum(c.v * a.v) AS value FROM {cells} c JOIN {name}_axes a USING (i) GROUP BY key, t"


b.CTES["chunk_axes_once"] = (
    ("embedded",),
    "chunk_cells AS MATERIALIZED (SELECT ROW(video_id, chunk_id) AS key, dim AS i, CAST(v AS DOUBLE) AS v FROM embedded), "
    + axes_ctes("chunk", "chunk_cells", "SELECT count(*) AS n FROM chunks", 5),
)
# A chunk without words has all coordinates zero.
b.CTES["flat"] = (
    ("chunk_axes_once",),
    f"""SELECT c.video_id, c.chunk_id, a.t, coalesce(value, 0) AS value FROM chunks c CROSS JOIN (SELECT unnest(range(5)) AS t) a
        LEFT JOIN ({coordinates("chunk", "chunk_cells")}) p ON p.key = ROW(c.video_id, c.chunk_id) AND p.t = a.t""",
)


@query(
    "project_2d",
    sql(
        "topic_chunks flat",
        """SELECT video_id, chunk_id, topic_id, start_time, normalized_text, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y
           FROM topic_chunks JOIN (SELECT video_id, chunk_id, sum(value) FILTER (t = 0) AS x, sum(value) FILTER (t = 1) AS y
                                   FROM flat GROUP BY ALL) USING (video_id, chunk_id)""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.chunks(spark, d))
    vectors = b.stored(embedded(spark, d, chunks.select("video_id", "chunk_id", "normalized_text")).drop("normalized_text"))
    placed = vc.project_2d(vectors)
    topics = b.assign(chunks, b.video_topics(spark, d))
    shown = vc.scatter_data(topics, placed)
    return shown.withColumns({c: F.round(c, 6) + 0.0 for c in ("x", "y")})


_CELLS = "SELECT vec_id AS key, unnest(range(len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings"
AXES = f"WITH RECURSIVE e_cells AS MATERIALIZED ({_CELLS}),\n" + axes_ctes("e", "e_cells", "SELECT count(*) AS n FROM embeddings", 5)


@query(
    "project_5d",
    f"""{AXES} SELECT key AS vec_id, CAST(t AS INTEGER) AS dim, round(value, 6) + 0.0 AS value FROM ({coordinates("e", "e_cells")})""",
)
def _(spark, d):
    placed = vc.project(b.table(spark, d, "embeddings"), 5)
    return placed.select("vec_id", F.posexplode("projected").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)


KNN_SQL = """SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(distance, 6) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
      SELECT query_id, vec_id, sum((x - y) * (x - y)) AS distance FROM (
        SELECT q.vec_id AS query_id, p.vec_id, unnest(CAST(q.embedding AS DOUBLE[])) AS x, unnest(CAST(p.embedding AS DOUBLE[])) AS y
        FROM embeddings q CROSS JOIN embeddings p) GROUP BY query_id, vec_id)) WHERE rank <= 5"""


@query("knn", KNN_SQL)
def _(spark, d):
    base = b.table(spark, d, "embeddings")
    found = vc.knn(base, base.withColumnRenamed("vec_id", "query_id"), k=5)
    return found.withColumn("distance", F.round("distance", 6))


@query("knn_cells", KNN_SQL)
def _(spark, d):
    """The same, as for more queries than can be broadcast."""
    base = b.table(spark, d, "embeddings")
    found = vc.knn(base, base.withColumnRenamed("vec_id", "query_id"), k=5, query_block=0)
    return found.withColumn("distance", F.round("distance", 6))


def labelled_vectors(spark, d):
    """Vectors with their label as topic; label 9 stands for the outliers."""
    topic = F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int")
    return b.table(spark, d, "embeddings").withColumn("topic_id", topic)


PROBS = """e AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS topic_id,
                        unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    c AS (SELECT topic_id, i, avg(x) AS m FROM e WHERE topic_id <> -1 GROUP BY topic_id, i),
    cl AS (SELECT topic_id, sqrt(sum(m * m)) AS len FROM c GROUP BY topic_id),
    s AS (SELECT vec_id, c.topic_id, greatest(sum(x * m) / any_value(cl.len) / sqrt(sum(x * x)), 0) AS v
          FROM e JOIN c USING (i) JOIN cl ON cl.topic_id = c.topic_id GROUP BY vec_id, c.topic_id),
    p AS (SELECT vec_id, topic_id, v / sum(v) OVER (PARTITION BY vec_id) AS prob FROM s)"""


@query("topic_probs", f"WITH {PROBS} SELECT vec_id, CAST(topic_id AS INTEGER) AS topic_id, round(prob, 6) AS prob FROM p")
def _(spark, d):
    v = labelled_vectors(spark, d)
    return vc.topic_probabilities(v, vc.centroids(v), ["vec_id"]).withColumn("prob", F.round("prob", 6))


@query(
    "topic_top_docs",
    f"""WITH {PROBS} SELECT * FROM (
          SELECT vec_id, CAST(topic_id AS INTEGER) AS topic_id, round(prob, 6) AS prob,
                 CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(prob, 9) DESC, vec_id) AS INTEGER) AS rank FROM p)
        WHERE rank <= 5""",
)
def _(spark, d):
    v = labelled_vectors(spark, d)
    probs = vc.topic_probabilities(v, vc.centroids(v), ["vec_id"])
    return vc.topic_top_docs(probs, 5, ["vec_id"]).withColumn("prob", F.round("prob", 6))
