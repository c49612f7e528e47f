"""Registered queries: topic words, topic tables, coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.text import STOP_WORDS
from lectern.operators import coherence as co
from lectern.operators import terms as tm
from lectern.sources import reports
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


def counts(chunks):
    return tm.term_counts(chunks, stop_words=STOP_WORDS)


def weights(chunks):
    # Worked out from the stored counts wherever they are read.
    return tm.ctfidf(counts(chunks))


def keywords(chunks):
    return tm.topic_keywords(weights(chunks))


def unigram_keywords(chunks):
    return tm.topic_keywords(tm.ctfidf(tm.term_counts(chunks, stop_words=STOP_WORDS, max_n=1)))


_words = f"list_filter({b.tokens_sql('normalized_text')}, lambda w: w NOT IN ({b._STOP}))"
b.CTES["doc_terms"] = (
    ("topic_chunks",),
    f"""SELECT video_id, chunk_id, topic_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM (SELECT video_id, chunk_id, topic_id, {_words} AS w FROM topic_chunks)""",
)
b.CTES["counts"] = (
    ("doc_terms",),
    """SELECT * FROM (SELECT topic_id, term, count(*) AS tf, count(*) OVER (PARTITION BY term) AS topics,
                              CAST(sum(count(*)) OVER (PARTITION BY term) AS BIGINT) AS total
                       FROM doc_terms GROUP BY topic_id, term) WHERE topics >= 2""",
)
b.CTES["weights"] = (
    ("counts",),
    """SELECT c.topic_id, term, tf, total, ln(1 + mean / total) AS idf, tf / n * ln(1 + mean / total) AS score
       FROM counts c JOIN (SELECT topic_id, sum(tf) AS n FROM counts GROUP BY topic_id) USING (topic_id)
       CROSS JOIN (SELECT floor(avg(n)) AS mean FROM (SELECT sum(tf) AS n FROM counts GROUP BY topic_id))""",
)
b.CTES["keywords"] = (
    ("weights",),
    """SELECT * FROM (SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 12) DESC, term) AS rank,
                              term AS word, score FROM weights) WHERE rank <= 10""",
)
b.CTES["uni_counts"] = (
    ("topic_chunks",),
    f"""SELECT * FROM (SELECT topic_id, term, count(*) AS tf, count(*) OVER (PARTITION BY term) AS topics,
                              sum(count(*)) OVER (PARTITION BY term) AS total
                       FROM (SELECT topic_id, unnest({_words}) AS term FROM topic_chunks) GROUP BY topic_id, term)
        WHERE topics >= 2""",
)
b.CTES["uni_keywords"] = (
    ("uni_counts",),
    """SELECT * FROM (SELECT c.topic_id, term AS word,
                row_number() OVER (PARTITION BY c.topic_id ORDER BY round(tf / n * ln(1 + mean / total), 12) DESC, term) AS rank
              FROM uni_counts c JOIN (SELECT topic_id, sum(tf) AS n FROM uni_counts GROUP BY topic_id) USING (topic_id)
              CROSS JOIN (SELECT floor(avg(n)) AS mean FROM (SELECT sum(tf) AS n FROM uni_counts GROUP BY topic_id)))
       WHERE rank <= 10 AND topic_id <> -1""",
)
b.CTES["rep_docs"] = (
    ("doc_terms", "weights"),
    """SELECT * FROM (
         SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(similarity, 9) DESC, video_id, chunk_id) AS rank
         FROM (SELECT video_id, chunk_id, d.topic_id, sum(n * idf * score) / (sqrt(sum(n * idf * n * idf)) * any_value(norm)) AS similarity
               FROM (SELECT video_id, chunk_id, topic_id, term, count(*) AS n FROM doc_terms GROUP BY ALL) d
               JOIN weights w ON w.topic_id = d.topic_id AND w.term = d.term
               JOIN (SELECT topic_id, sqrt(sum(score * score)) AS norm FROM weights GROUP BY topic_id) z ON z.topic_id = d.topic_id
               GROUP BY video_id, chunk_id, d.topic_id))
       WHERE rank <= 3""",
)


@query("term_counts", sql("counts", "SELECT topic_id, term, tf, topics, total FROM counts"))
def _(spark, d):
    return counts(b.topic_chunks(spark, d))


@query(
    "ctfidf",
    sql("weights", "SELECT topic_id, term, tf, round(idf, 6) AS idf, round(score, 9) AS score FROM weights"),
)
def _(spark, d):
    return weights(b.topic_chunks(spark, d)).select(
        "topic_id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("score", 9).alias("score")
    )


@query(
    "topic_keywords",
    sql("keywords", "SELECT topic_id, CAST(rank AS INTEGER) AS rank, word, round(score, 9) AS score FROM keywords"),
)
def _(spark, d):
    return keywords(b.topic_chunks(spark, d)).withColumn("score", F.round("score", 9))


REPORT_SQL = """SELECT s.topic_id AS "Topic", n AS "Count", s.topic_id || '_' || array_to_string(ws[1:4], '_') AS "Name",
       array_to_string(ws, ', ') AS "Representation", docs AS "Representative_Docs"
  FROM (SELECT topic_id, count(*) AS n FROM topic_chunks GROUP BY topic_id) s
  JOIN (SELECT topic_id, array_agg(word ORDER BY rank) AS ws FROM keywords GROUP BY topic_id) k USING (topic_id)"""


@query(
    "topic_info",
    sql("topic_chunks keywords", REPORT_SQL.replace(', docs AS "Representative_Docs"', "")),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    info = tm.topic_info(chunks, keywords(chunks))
    return reports.flat(info).drop("Representative_Docs")


@query(
    "representative_docs",
    sql(
        "rep_docs topic_chunks",
        """SELECT r.topic_id, CAST(rank AS INTEGER) AS rank, video_id, chunk_id, round(similarity, 6) AS similarity, normalized_text
           FROM rep_docs r JOIN topic_chunks USING (video_id, chunk_id)""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    docs = tm.representative_docs(chunks, weights(chunks), stop_words=STOP_WORDS)
    return docs.withColumn("similarity", F.round("similarity", 6))


@query(
    "report_flat",
    sql(
        "topic_chunks keywords rep_docs",
        REPORT_SQL
        + """ JOIN (SELECT r.topic_id, string_agg(normalized_text, chr(10) || '---' || chr(10) ORDER BY rank) AS docs
                    FROM rep_docs r JOIN topic_chunks USING (video_id, chunk_id) GROUP BY r.topic_id) USING (topic_id)""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    w = weights(chunks)
    docs = tm.representative_docs(chunks, w, stop_words=STOP_WORDS)
    return reports.flat(tm.topic_info(chunks, tm.topic_keywords(w), docs))


@query(
    "topic_distances",
    sql(
        "weights",
        """, w AS (SELECT topic_id, term, score FROM weights WHERE topic_id <> -1),
           n AS (SELECT topic_id, sqrt(sum(score * score)) AS norm FROM w GROUP BY topic_id)
           SELECT x.topic_id AS topic_a, y.topic_id AS topic_b, round(1 - coalesce(dot, 0) / (x.norm * y.norm), 9) AS distance
           FROM n x JOIN n y ON x.topic_id < y.topic_id
           LEFT JOIN (SELECT p.topic_id AS a, q.topic_id AS b, sum(p.score * q.score) AS dot
                      FROM w p JOIN w q ON p.term = q.term AND p.topic_id < q.topic_id GROUP BY ALL)
             ON a = x.topic_id AND b = y.topic_id""",
    ),
)
def _(spark, d):
    return tm.topic_distances(weights(b.topic_chunks(spark, d))).withColumn("distance", F.round("distance", 9))


@query(
    "related_documents",
    sql(
        "norm",
        f""", seen AS MATERIALIZED (SELECT CAST(video_id AS INTEGER) AS doc, word, count(*) AS n
               FROM (SELECT video_id, unnest({b.tokens_sql("normalized_text")}) AS word FROM norm) GROUP BY ALL),
             df AS MATERIALIZED (SELECT word, count(*) AS docs FROM seen GROUP BY word HAVING count(*) BETWEEN 2 AND 100),
             w AS MATERIALIZED (SELECT doc, word, n * (1 + ln((SELECT count(DISTINCT doc) FROM seen) / docs)) AS score FROM seen JOIN df USING (word)),
             n AS (SELECT doc, sqrt(sum(score * score)) AS norm FROM w GROUP BY doc)
             SELECT topic_a, topic_b, round(1 - dot / (x.norm * y.norm), 6) + 0.0 AS distance
             FROM (SELECT p.doc AS topic_a, q.doc AS topic_b, sum(p.score * q.score) AS dot
                   FROM w p JOIN w q ON p.word = q.word AND p.doc < q.doc GROUP BY ALL)
             JOIN n x ON x.doc = topic_a JOIN n y ON y.doc = topic_b""",
    ),
)
def _(spark, d):
    """Every document as a topic of its own, by the words that 2 to 100 documents share."""
    seen = (
        b.norm(spark, d).select(F.col("video_id").cast("int").alias("topic_id"), F.explode(tx.tokens(F.col("normalized_text"))).alias("term"))
        .groupBy("topic_id", "term").agg(F.count("*").alias("n"))
    )
    seen = b.stored(seen)
    df = seen.groupBy("term").agg(F.count("*").alias("docs")).where("docs between 2 and 100")
    total = seen.agg(F.count_distinct("topic_id")).first()[0]
    score = F.col("n") * (1 + F.log(F.lit(total) / F.col("docs")))
    found = tm.related_topics(b.stored(seen.join(df, "term").select("topic_id", "term", score.alias("score"))))
    return found.withColumn("distance", F.round("distance", 6) + 0.0)


@query(
    "topic_diversity",
    sql(
        "keywords",
        "SELECT round(count(DISTINCT word) / count(word), 9) AS diversity FROM keywords WHERE topic_id <> -1",
    ),
)
def _(spark, d):
    return tm.topic_diversity(keywords(b.topic_chunks(spark, d))).select(F.round("diversity", 9).alias("diversity"))


@query(
    "coherence_umass",
    sql(
        "chunk_words uni_keywords",
        """, hits AS (SELECT DISTINCT video_id, chunk_id, c.word FROM chunk_words c WHERE word IN (SELECT word FROM uni_keywords)),
           d1 AS (SELECT word, count(*) AS n FROM hits GROUP BY word),
           p AS (SELECT a.topic_id, a.word AS wi, b.word AS wj FROM uni_keywords a JOIN uni_keywords b
                 ON a.topic_id = b.topic_id AND a.rank < b.rank),
           d2 AS (SELECT a.word AS wi, b.word AS wj, count(*) AS n FROM hits a JOIN hits b
                  ON a.video_id = b.video_id AND a.chunk_id = b.chunk_id GROUP BY ALL)
           SELECT topic_id, round(avg(ln((coalesce(d2.n, 0) + 1) / d1.n)), 6) AS u_mass
           FROM p JOIN d1 ON d1.word = wi LEFT JOIN d2 ON d2.wi = p.wi AND d2.wj = p.wj GROUP BY topic_id""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    found = co.coherence_umass(chunks, unigram_keywords(chunks))
    return found.withColumn("u_mass", F.round("u_mass", 6))


def windows_sql(size: int, pair: str) -> str:
    return f"""
      , toks AS (SELECT video_id, chunk_id, unnest(w) AS word, unnest(range(len(w))) AS pos, greatest(len(w) - {size - 1}, 1) AS wins
                 FROM (SELECT video_id, chunk_id, {b.tokens_sql('normalized_text')} AS w FROM chunks)),
        total AS (SELECT sum(wins) AS n FROM (SELECT any_value(wins) AS wins FROM toks GROUP BY video_id, chunk_id)),
        hits AS (SELECT DISTINCT video_id, chunk_id, word,
                        unnest(range(greatest(pos - {size - 1}, 0), least(pos, wins - 1) + 1)) AS win
                 FROM toks WHERE word IN (SELECT word FROM uni_keywords)),
        n1 AS (SELECT word, count(*) AS n FROM hits GROUP BY word),
        p AS (SELECT a.topic_id, a.word AS wi, b.word AS wj FROM uni_keywords a JOIN uni_keywords b
              ON a.topic_id = b.topic_id AND {pair}),
        n2 AS (SELECT wi, wj, count(*) AS n FROM (SELECT DISTINCT wi, wj FROM p) q
               JOIN hits a ON a.word = wi JOIN hits b ON b.word = wj AND a.video_id = b.video_id
                    AND a.chunk_id = b.chunk_id AND a.win = b.win GROUP BY ALL),
        npmi AS (SELECT topic_id, p.wi, p.wj,
                        ln((coalesce(n2.n, 0) / t.n + 1e-12) / ((x.n / t.n) * (y.n / t.n))) / -ln(coalesce(n2.n, 0) / t.n + 1e-12) AS v
                 FROM p JOIN n1 x ON x.word = p.wi JOIN n1 y ON y.word = p.wj
                 LEFT JOIN n2 ON n2.wi = p.wi AND n2.wj = p.wj CROSS JOIN total t)"""


@query(
    "coherence_npmi",
    sql(
        "chunks uni_keywords",
        windows_sql(10, "a.rank < b.rank") + " SELECT topic_id, round(avg(v), 6) AS c_npmi FROM npmi GROUP BY topic_id",
    ),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    found = co.coherence_npmi(chunks, unigram_keywords(chunks))
    return found.withColumn("c_npmi", F.round("c_npmi", 6))


@query(
    "coherence_cv",
    sql(
        "chunks uni_keywords",
        windows_sql(110, "TRUE")
        + """, s AS (SELECT topic_id, wj, sum(v) AS s FROM npmi GROUP BY topic_id, wj)
             SELECT topic_id, round(avg(c), 6) AS c_v
             FROM (SELECT n.topic_id, wi, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS c
                   FROM npmi n JOIN s ON s.topic_id = n.topic_id AND s.wj = n.wj GROUP BY n.topic_id, wi) GROUP BY topic_id""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    found = co.coherence_cv(chunks, unigram_keywords(chunks))
    return found.withColumn("c_v", F.round("c_v", 6))
