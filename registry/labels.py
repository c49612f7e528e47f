"""Registered queries: topics over time and topic labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import STOP_WORDS
from lectern.operators import labels as lb
from lectern.operators import overtime as ot
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


def bin_sql(t: str) -> str:
    return f"CAST(least(greatest(ceil(({t} - lo) * 20 / (hi - lo)) - 1, 0), 19) AS INTEGER)"


@query(
    "topic_frequency",
    f"""WITH e AS (SELECT event_type, epoch_us(ts) / 1e6 AS t FROM events),
             r AS (SELECT min(t) AS lo, max(t) AS hi FROM e)
        SELECT event_type, bin, round(lo + bin * (hi - lo) / 20, 3) AS bin_start, count(*) AS frequency
        FROM (SELECT event_type, {bin_sql('t')} AS bin, lo, hi FROM e, r) GROUP BY event_type, bin, lo, hi""",
)
def _(spark, d):
    events = b.table(spark, d, "events").select(
        "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    )
    found = ot.topic_frequency(events, "t", topic_col="event_type")
    return found.withColumn("bin_start", F.round("bin_start", 3))


def timed(chunks, spark, d):
    """Chunks with the time of the event that has the number of their document."""
    times = b.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("video_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
    )
    return chunks.join(times, "video_id")


@query(
    "topics_over_time",
    sql(
        "topic_chunks weights doc_terms",
        f""", ev AS (SELECT CAST(event_id AS VARCHAR) AS video_id, epoch_us(ts) / 1e6 AS t FROM events),
            r AS (SELECT min(t) AS lo, max(t) AS hi FROM topic_chunks JOIN ev USING (video_id)),
            binned AS (SELECT c.video_id, c.chunk_id, c.topic_id, {bin_sql('t')} AS bin, lo, hi FROM topic_chunks c JOIN ev USING (video_id), r),
            freq AS (SELECT topic_id, bin, round(any_value(lo + bin * (hi - lo) / 20), 3) AS bin_start, count(*) AS frequency FROM binned GROUP BY topic_id, bin),
            periods AS (SELECT bin, row_number() OVER (ORDER BY bin) - 1 AS period FROM (SELECT DISTINCT bin FROM binned)),
            tf AS (SELECT d.topic_id, period, d.term, count(*) * any_value(idf) AS w
                   FROM doc_terms d JOIN binned USING (video_id, chunk_id) JOIN periods USING (bin)
                   JOIN weights g ON g.topic_id = d.topic_id AND g.term = d.term GROUP BY d.topic_id, period, d.term),
            tot AS (SELECT f.topic_id, p.period, coalesce(sum(w), 0) AS total FROM freq f JOIN periods p USING (bin)
                    LEFT JOIN tf ON tf.topic_id = f.topic_id AND tf.period = p.period GROUP BY f.topic_id, p.period),
            gl AS (SELECT topic_id, term, score / sum(score) OVER (PARTITION BY topic_id) AS g FROM weights),
            dense AS (SELECT gl.topic_id, gl.term, tot.period, g, CASE WHEN total > 0 THEN coalesce(w, 0) / total ELSE 0 END AS c
                      FROM gl JOIN tot ON tot.topic_id = gl.topic_id
                      LEFT JOIN tf ON tf.topic_id = gl.topic_id AND tf.term = gl.term AND tf.period = tot.period),
            first_x AS (SELECT topic_id, term, period, (c + g) / 2 AS x FROM dense d
                        WHERE NOT EXISTS (SELECT 1 FROM tot t WHERE t.topic_id = d.topic_id AND t.period = d.period - 1)),
            xs AS (SELECT d.topic_id, d.term, d.period,
                          sum(pow(0.25, d.period - e.period) * CASE WHEN e.is_first THEN (e.c + e.g) / 2 ELSE e.g / 2 + e.c / 4 END) AS x
                   FROM (SELECT topic_id, term, period, period - dense_rank() OVER (PARTITION BY topic_id ORDER BY period) AS run FROM dense) d
                   JOIN (SELECT dense.topic_id, dense.term, dense.period, c, g,
                                dense.period - dense_rank() OVER (PARTITION BY dense.topic_id ORDER BY dense.period) AS run,
                                f.x IS NOT NULL AS is_first
                         FROM dense LEFT JOIN first_x f ON f.topic_id = dense.topic_id AND f.term = dense.term AND f.period = dense.period) e
                     ON e.topic_id = d.topic_id AND e.term = d.term AND e.run = d.run AND e.period <= d.period
                   GROUP BY d.topic_id, d.term, d.period),
            best AS (SELECT *, row_number() OVER (PARTITION BY topic_id, period ORDER BY round(x, 12) DESC, term) AS rank FROM xs WHERE x > 0)
            SELECT freq.topic_id, freq.bin, bin_start, frequency, coalesce(words, '') AS words
            FROM freq JOIN periods USING (bin)
            LEFT JOIN (SELECT topic_id, period, string_agg(term, ', ' ORDER BY rank) AS words FROM best WHERE rank <= 5 GROUP BY topic_id, period) w
              ON w.topic_id = freq.topic_id AND w.period = periods.period""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    found = ot.topics_over_time(timed(chunks, spark, d), tp.weights(chunks), "t", stop_words=STOP_WORDS)
    return found.withColumn("bin_start", F.round("bin_start", 3))


b.CTES["phrases"] = (
    ("doc_terms", "idf", "topic_chunks", "chunk_words"),
    f"""SELECT topic_id, phrase, score, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, phrase) AS rank FROM (
          SELECT p.topic_id, p.term AS phrase, sum(cnt * i.w * coalesce(t.v, 0)) / (sqrt(sum(cnt * i.w * cnt * i.w)) * any_value(l.len)) AS score
          FROM (SELECT topic_id, term, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % {rv.DIMS} AS dim, count(*) AS cnt
                FROM (SELECT topic_id, term, unnest(string_split(term, ' ')) AS w
                      FROM (SELECT DISTINCT topic_id, term FROM doc_terms WHERE topic_id <> -1)) GROUP BY ALL) p
          JOIN idf i ON i.dim = p.dim
          LEFT JOIN (SELECT topic_id, dim, sum(n) * any_value(w) AS v FROM cells JOIN topic_chunks USING (video_id, chunk_id) JOIN idf USING (dim)
                     GROUP BY topic_id, dim) t ON t.topic_id = p.topic_id AND t.dim = p.dim
          JOIN (SELECT topic_id, sqrt(sum(v * v)) AS len FROM (
                  SELECT topic_id, dim, sum(n) * any_value(w) AS v FROM cells JOIN topic_chunks USING (video_id, chunk_id) JOIN idf USING (dim)
                  GROUP BY topic_id, dim) GROUP BY topic_id) l ON l.topic_id = p.topic_id
          GROUP BY p.topic_id, p.term)""",
)
b.CTES["stat_words"] = (
    ("topic_chunks",),
    f"SELECT video_id, topic_id, chunk_id, {tp._words} AS w FROM topic_chunks WHERE topic_id <> -1",
)
b.CTES["stat_pairs"] = (
    ("stat_words",),
    """SELECT topic_id, w1, w2, count(*) AS tf
       FROM (SELECT topic_id, unnest(w[1:len(w) - 1]) AS w1, unnest(w[2:len(w)]) AS w2 FROM stat_words)
       WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY ALL""",
)
b.CTES["stat_scores"] = (
    ("stat_pairs",),
    """SELECT topic_id, word, tf, rel * ln(ln(3 + middle)) / (tf / scale / rel + sf / chunks / rel) AS s
       FROM (SELECT f.*, m.chunks, avg(tf) OVER t + stddev_pop(tf) OVER t AS scale,
                    1 + (coalesce(dl, 0) + coalesce(dr, 0)) * tf / max(tf) OVER t AS rel
             FROM (SELECT topic_id, word, sum(n) AS tf, count(*) AS sf, quantile_disc(chunk_id, 0.5) AS middle
                   FROM (SELECT topic_id, video_id, chunk_id, word, count(*) AS n
                         FROM (SELECT topic_id, video_id, chunk_id, unnest(w) AS word FROM stat_words) GROUP BY ALL)
                   GROUP BY topic_id, word) f
             JOIN (SELECT topic_id, count(*) AS chunks FROM stat_words GROUP BY topic_id) m USING (topic_id)
             LEFT JOIN (SELECT topic_id, w2 AS word, count(*) / sum(tf) AS dl FROM stat_pairs GROUP BY topic_id, w2) USING (topic_id, word)
             LEFT JOIN (SELECT topic_id, w1 AS word, count(*) / sum(tf) AS dr FROM stat_pairs GROUP BY topic_id, w1) USING (topic_id, word)
             WINDOW t AS (PARTITION BY topic_id))""",
)
b.CTES["stat_phrases"] = (
    ("stat_scores",),
    """SELECT topic_id, word AS phrase, s / (tf * (1 + s)) AS score FROM stat_scores
       UNION ALL
       SELECT p.topic_id, w1 || ' ' || w2, a.s * b.s / (p.tf * (1 + a.s + b.s))
       FROM stat_pairs p JOIN stat_scores a ON a.topic_id = p.topic_id AND a.word = w1
       JOIN stat_scores b ON b.topic_id = p.topic_id AND b.word = w2""",
)


@query(
    "keyphrases",
    sql("phrases", "SELECT topic_id, CAST(rank AS INTEGER) AS rank, phrase, round(score, 6) AS score FROM phrases WHERE rank <= 5"),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    return lb.keyphrases(chunks, dims=rv.DIMS, stop_words=STOP_WORDS).withColumn("score", F.round("score", 6))


@query("keywords_scores", sql("stat_phrases", "SELECT topic_id, phrase, round(score, 6) AS score FROM stat_phrases"))
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    return lb.statistical_scores(chunks, STOP_WORDS).withColumn("score", F.round("score", 6))


def _picks_sql(n: int = 5) -> str:
    """The best phrase left, n times; after each the phrases too similar to it are dropped."""
    parts = [", l1 AS MATERIALIZED (SELECT topic_id, phrase, score, round(score, 9) AS o FROM stat_phrases)"]
    for i in range(1, n + 1):
        parts.append(
            f"b{i} AS MATERIALIZED (SELECT topic_id, {i} AS rank, arg_min(phrase, (o, phrase)) AS phrase, arg_min(score, (o, phrase)) AS score "
            f"FROM l{i} GROUP BY topic_id)"
        )
        parts.append(
            f"l{i + 1} AS MATERIALIZED (SELECT l.* FROM l{i} l JOIN b{i} t ON t.topic_id = l.topic_id "
            f"WHERE 1 - levenshtein(l.phrase, t.phrase) / greatest(length(l.phrase), length(t.phrase)) <= 0.9)"
        )
    rows = " UNION ALL ".join(f"SELECT topic_id, rank, phrase, round(score, 6) AS score FROM b{i}" for i in range(1, n + 1))
    return ", ".join(parts) + " " + rows


@query("keywords_stat", sql("stat_phrases", _picks_sql()))
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    found = lb.keywords_statistical(lb.statistical_scores(chunks, STOP_WORDS))
    return found.withColumn("score", F.round("score", 6))


@query(
    "merge_labels",
    sql(
        "keywords phrases topic_names",
        """SELECT n.topic_id, n.name AS default_name, coalesce(k.l, '') AS keyphrases, coalesce(s.l, '') AS keywords,
                  CASE WHEN n.topic_id % 2 = 0 THEN upper(n.name) END AS extra
           FROM topic_names n
           LEFT JOIN (SELECT topic_id, string_agg(phrase, '|' ORDER BY rank) AS l FROM phrases WHERE rank <= 5 GROUP BY topic_id) k USING (topic_id)
           LEFT JOIN (SELECT topic_id, string_agg(word, '|' ORDER BY rank) AS l FROM keywords GROUP BY topic_id) s USING (topic_id)""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.topic_chunks(spark, d))
    names = b.topic_names(spark, d)
    phrases = lb.keyphrases(chunks, dims=rv.DIMS, stop_words=STOP_WORDS)
    words = tp.keywords(chunks).withColumnRenamed("word", "phrase")
    # Only some topics have a label of their own, as when people named a few by hand.
    by_hand = names.where("topic_id % 2 = 0").select("topic_id", F.upper("name").alias("label"))
    merged = lb.merge_labels(names, phrases, words, by_hand)
    return merged.select(
        "topic_id", "default_name", F.array_join("keyphrases", "|").alias("keyphrases"),
        F.array_join("keywords", "|").alias("keywords"), "extra",
    )
