"""Registered queries: clusters and topic merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import clusters as cl
from lectern.operators import terms as tm
from lectern.operators import vectors as vc
from registry import base as b
from registry import topics as tp
from registry import vectors as rv
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


@query(
    "cluster_density",
    rv.AXES
    + f""", p AS (SELECT key AS vec_id, CAST(floor(sum(value) FILTER (t = 0) / 0.1) AS BIGINT) AS x,
                       CAST(floor(sum(value) FILTER (t = 1) / 0.1) AS BIGINT) AS y FROM ({rv.coordinates("e", "e_cells")}) GROUP BY key),
       cells AS (SELECT x, y, count(*) AS n FROM p GROUP BY x, y),
       touch AS (SELECT a.x AS ax, a.y AS ay, a.n, b.x AS bx, b.y AS by_ FROM cells a JOIN cells b
                 ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)),
       dense AS (SELECT x, y FROM cells LEFT JOIN (SELECT bx, by_, sum(n) AS near FROM touch GROUP BY bx, by_) ON bx = x AND by_ = y
                 WHERE n + coalesce(near, 0) >= 25),
       walk AS (SELECT x, y, x AS cx, y AS cy FROM dense
                UNION
                SELECT t.bx, t.by_, w.cx, w.cy FROM walk w JOIN touch t ON t.ax = w.x AND t.ay = w.y
                JOIN dense d ON d.x = t.bx AND d.y = t.by_),
       comp AS (SELECT x, y, min(ROW(cx, cy)) AS c FROM walk GROUP BY x, y),
       border AS (SELECT bx AS x, by_ AS y, min(c) AS c FROM touch JOIN comp ON comp.x = ax AND comp.y = ay
                  WHERE (bx, by_) NOT IN (SELECT (x, y) FROM dense) GROUP BY bx, by_),
       placed AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
       ids AS (SELECT c, CAST(row_number() OVER (ORDER BY sum(n) DESC, c) - 1 AS INTEGER) AS topic_id
               FROM placed JOIN cells USING (x, y) GROUP BY c HAVING sum(n) >= 5)
       SELECT vec_id, coalesce(topic_id, -1) AS topic_id FROM p LEFT JOIN placed USING (x, y) LEFT JOIN ids USING (c)""",
)
def _(spark, d):
    """Whole vectors on their two widest axes, clustered at one level of density."""
    return cl.cluster_density(b.stored(vc.project(b.table(spark, d, "embeddings"), 2)), 0.1, min_points=25, keys=["vec_id"])


#: Share of all points that a cluster holds at least, and the number of points.
SHARE, LEAST = 0.005, 5

# The tree of parts level by level, chains of parts that do not split as one cluster, persistence from
# the leaves up, choice from the root down. A part is level * 1000000 + its smallest cell.
b.CTES["tree_once"] = (
    ("flat",),
    f"""side AS MATERIALIZED (SELECT round(x, 2 - CAST(floor(log10(x)) AS INTEGER)) AS side
      FROM (SELECT 0.2 * max(s) AS x FROM (SELECT stddev_pop(value) AS s FROM flat GROUP BY t))),
    spots AS MATERIALIZED (SELECT video_id, chunk_id, list(CAST(floor(value / side) AS BIGINT) ORDER BY t) AS cell
      FROM flat, side GROUP BY video_id, chunk_id),
    spot_cells AS MATERIALIZED (SELECT cell, count(*) AS n, row_number() OVER (ORDER BY cell) AS id FROM spots GROUP BY cell),
    touch AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.n FROM spot_cells a JOIN spot_cells b
      ON {" AND ".join(f"abs(a.cell[{i}] - b.cell[{i}]) <= 1" for i in range(1, 6))} AND a.id <> b.id),
    dense AS MATERIALIZED (SELECT id, cell, n, n + coalesce(near, 0) AS density
      FROM spot_cells LEFT JOIN (SELECT b AS id, sum(n) AS near FROM touch GROUP BY b) USING (id)),
    levels AS MATERIALIZED (SELECT id, cell, n,
        len(list_filter(range(127), lambda k: CAST(density AS DOUBLE) * density * pow(2, k) < CAST(top AS DOUBLE) * top)) AS level
      FROM dense, (SELECT max(density) AS top FROM dense)),
    nodes AS MATERIALIZED (SELECT id, n, unnest(range(level, (SELECT max(level) + 1 FROM levels))) AS k FROM levels),
    links AS MATERIALIZED (SELECT a, b, greatest(x.level, y.level) AS level FROM touch JOIN levels x ON x.id = a JOIN levels y ON y.id = b),
    reach(k, id, part) USING KEY (k, id) AS (
      SELECT k, id, id FROM nodes
      UNION
      SELECT w.k, l.b, min(w.part) FROM reach w JOIN links l ON l.a = w.id AND l.level <= w.k
      JOIN recurring.reach r ON r.k = w.k AND r.id = l.b WHERE w.part < r.part GROUP BY w.k, l.b),
    parts AS MATERIALIZED (SELECT k, id, part FROM reach),
    real AS MATERIALIZED (
      SELECT p.k, p.part, any_value(up.part) AS above, sum(n) AS size
      FROM parts p JOIN spot_cells USING (id) LEFT JOIN parts up ON up.k = p.k + 1 AND up.id = p.part
      GROUP BY p.k, p.part HAVING sum(n) >= greatest({LEAST}, ceil({SHARE} * (SELECT count(*) FROM spots)))),
    births AS MATERIALIZED (
      SELECT *, above IS NULL OR count(*) OVER (PARTITION BY k, above) > 1 AS birth FROM real),
    chain AS (
      SELECT k, part, k * 1000000 + part AS cluster FROM births WHERE birth
      UNION ALL
      SELECT r.k, r.part, c.cluster FROM chain c JOIN births r ON r.k = c.k - 1 AND r.above = c.part WHERE NOT birth),
    own AS MATERIALIZED (SELECT cluster, sum(size * (pow(2, -k / 10.0) - pow(2, -(k + 1) / 10.0))) AS own
      FROM chain JOIN real USING (k, part) GROUP BY cluster),
    family AS MATERIALIZED (SELECT c.cluster, p.cluster AS parent FROM chain c JOIN births s ON s.k = c.k AND s.part = c.part AND birth
      LEFT JOIN chain p ON p.k = s.k + 1 AND p.part = s.above),
    best(cluster, val, below) USING KEY (cluster) AS (
      SELECT cluster, own, 0.0 FROM own WHERE cluster NOT IN (SELECT parent FROM family WHERE parent IS NOT NULL)
      UNION
      SELECT f.parent, greatest(any_value(o.own), sum(r.val)), sum(r.val)
      FROM family f JOIN recurring.best r ON r.cluster = f.cluster JOIN own o ON o.cluster = f.parent
      WHERE EXISTS (SELECT 1 FROM best) AND f.parent NOT IN (SELECT cluster FROM recurring.best)
      GROUP BY f.parent HAVING count(*) = (SELECT count(*) FROM family x WHERE x.parent = f.parent)),
    value AS MATERIALIZED (SELECT cluster, own, val, below FROM best JOIN own USING (cluster)),
    tops AS MATERIALIZED (SELECT cluster FROM family WHERE parent IS NULL),
    walk AS (
      SELECT cluster FROM tops
      WHERE (SELECT count(*) FROM tops) > 1 OR cluster NOT IN (SELECT parent FROM family WHERE parent IS NOT NULL)
      UNION ALL
      SELECT f.cluster FROM family f WHERE (SELECT count(*) FROM tops) = 1 AND f.parent IN (SELECT cluster FROM tops)
      UNION ALL
      SELECT f.cluster FROM walk w JOIN value v USING (cluster) JOIN family f ON f.parent = w.cluster WHERE own < below),
    taken AS MATERIALIZED (SELECT cluster FROM walk JOIN value USING (cluster) WHERE own >= below),
    named AS MATERIALIZED (SELECT cluster, cell, n FROM taken JOIN parts ON k * 1000000 + part = cluster JOIN spot_cells USING (id)),
    ranked AS MATERIALIZED (SELECT cluster, CAST(row_number() OVER (ORDER BY sum(n) DESC, min(cell)) - 1 AS INTEGER) AS topic_id
      FROM named GROUP BY cluster)""",
)


@query(
    "cluster_projected",
    sql(
        "tree_once",
        """SELECT video_id, chunk_id, coalesce(topic_id, -1) AS topic_id
           FROM spots LEFT JOIN named USING (cell) LEFT JOIN ranked USING (cluster)""",
    ),
)
def _(spark, d):
    """Chunks embedded, projected and clustered by the tree of densities."""
    vectors = b.stored(rv.embedded(spark, d))
    flat = b.stored(vc.project(vectors, 5).select("video_id", "chunk_id", "projected"))
    return cl.density_tree(flat, cl.suggested_cell_size(flat), min_share=SHARE, min_size=LEAST)


@query("cluster_k")
def _(spark, d):
    return cl.cluster_k(b.table(spark, d, "embeddings"), 10).select("vec_id", "topic_id")


def tree(chunks, **kw):
    weights = b.stored(tp.weights(chunks))
    return cl.topic_hierarchy(tm.related_topics(weights), weights.where("topic_id <> -1"), **kw)


# The merge tree in SQL, one pair at a time: every step is a few CTEs. The topics of the test chunks
# are 0 to 19, so 19 steps are all there can be.
STEPS = 19


def _tree_ctes() -> str:
    parts = [
        """, wv AS (SELECT topic_id, term, score FROM weights WHERE topic_id <> -1),
           nv AS (SELECT topic_id, sqrt(sum(score * score)) AS norm FROM wv GROUP BY topic_id),
           e0 AS MATERIALIZED (SELECT x.topic_id AS a, y.topic_id AS b, 1 - coalesce(dot, 0) / (x.norm * y.norm) AS s, 1 AS c
                FROM nv x JOIN nv y ON x.topic_id < y.topic_id
                LEFT JOIN (SELECT p.topic_id AS pa, q.topic_id AS pb, sum(p.score * q.score) AS dot
                           FROM wv p JOIN wv q ON p.term = q.term AND p.topic_id < q.topic_id GROUP BY ALL)
                  ON pa = x.topic_id AND pb = y.topic_id),
           m0 AS MATERIALIZED (SELECT topic_id AS leaf, topic_id AS rep, topic_id AS node FROM nv)"""
    ]
    for i in range(1, STEPS + 1):
        parts.append(
            f"""best{i} AS MATERIALIZED (SELECT a, b, s / c AS d FROM e{i - 1} ORDER BY s / c, a, b LIMIT 1),
            e{i} AS MATERIALIZED (SELECT least(x, y) AS a, greatest(x, y) AS b, sum(s) AS s, sum(c) AS c
                 FROM (SELECT CASE WHEN e.a = t.b THEN t.a ELSE e.a END AS x, CASE WHEN e.b = t.b THEN t.a ELSE e.b END AS y, s, c
                       FROM e{i - 1} e, best{i} t) WHERE x <> y GROUP BY 1, 2),
            m{i} AS MATERIALIZED (SELECT leaf, CASE WHEN rep = t.b THEN t.a ELSE rep END AS rep,
                        CASE WHEN rep IN (t.a, t.b) THEN (SELECT max(leaf) FROM m0) + {i} ELSE node END AS node
                 FROM m{i - 1}, best{i} t)"""
        )
    return ", ".join(parts)


def _tree_row(i: int) -> str:
    return f"""SELECT CAST((SELECT max(leaf) FROM m0) + {i} AS INTEGER) AS "Parent",
        (SELECT any_value(node) FROM m{i - 1} WHERE rep = t.a) AS "Left", (SELECT any_value(node) FROM m{i - 1} WHERE rep = t.b) AS "Right",
        (SELECT string_agg(leaf, ',' ORDER BY leaf) FROM m{i - 1} WHERE rep IN (t.a, t.b)) AS "Topics", round(t.d, 6) AS "Distance" FROM best{i} t"""


@query("topic_hierarchy", sql("weights", _tree_ctes() + " " + " UNION ALL ".join(_tree_row(i) for i in range(1, STEPS + 1))))
def _(spark, d):
    return tree(b.topic_chunks(spark, d)).select(
        "Parent", "Left", "Right", F.concat_ws(",", "Topics").alias("Topics"), F.round("Distance", 6).alias("Distance")
    )


@query(
    "reduce_topics",
    sql(
        "weights topic_chunks",
        _tree_ctes()
        + """, steps AS ("""
        + " UNION ALL ".join(f"SELECT {i} AS step, leaf, node FROM m{i}" for i in range(STEPS + 1))
        + """), cut AS (SELECT leaf, node FROM steps WHERE step = (SELECT count(*) - 8 FROM m0)),
            ranked AS (SELECT node, row_number() OVER (ORDER BY count(*) DESC, node) - 1 AS new_id
                       FROM topic_chunks JOIN cut ON leaf = topic_id GROUP BY node)
            SELECT video_id, chunk_id, CAST(coalesce(new_id, -1) AS INTEGER) AS topic_id
            FROM topic_chunks LEFT JOIN cut ON leaf = topic_id LEFT JOIN ranked USING (node)""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    return cl.reduce_topics(chunks, tree(chunks, leaves=False), 8)


@query("topic_map")
def _(spark, d):
    chunks = b.stored(b.chunks(spark, d))
    vectors = b.stored(rv.embedded(spark, d, chunks).select("video_id", "chunk_id", "embedding"))
    topics = b.assign(chunks, b.video_topics(spark, d)).select("video_id", "chunk_id", "topic_id")
    both = b.stored(topics.join(vectors, ["video_id", "chunk_id"]))
    return cl.topic_map(both, vc.centroids(both))
