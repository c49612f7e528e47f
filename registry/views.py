"""Registered queries: text, chunks, joins, aggregates and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.repeats import collapse_repeats
from lectern.operators import chunking as ch
from lectern.operators import sentiment as sn
from lectern.plans import views as v
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


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def r6s(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ------------------------------------------------------------ text


@query("strip_markup", f"SELECT page_id, regexp_replace(html, '{tx.MARKUP}', ' ', 'g') AS text FROM pages")
def _(spark, d):
    return b.table(spark, d, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("text"))


@query("normalize", sql("norm", "SELECT video_id, start, normalized_text FROM norm"))
def _(spark, d):
    return b.norm(spark, d).select("video_id", "start", "normalized_text")


@query("normalize_full", sql("norm", "SELECT video_id, start, normalized_text FROM norm"))
def _(spark, d):
    return tx.normalize(b.segments(spark, d)).select("video_id", "start", "normalized_text")


@query(
    "clean_text",
    sql("segments", f"SELECT video_id, start, {b.stop_sql(b.clean_sql('text'))} AS normalized_text FROM segments"),
)
def _(spark, d):
    """The steps after repeated phrases, on raw text: all of them in the JVM."""
    cleaned = tx.remove_stop_words(tx.clean_text(F.col("text")))
    return b.segments(spark, d).select("video_id", "start", cleaned.alias("normalized_text"))


@query(
    "collapse_repeats",
    sql(
        "segments_once turns_once",
        "SELECT video_id, start, text FROM segments_once UNION ALL SELECT video_id, start, text FROM turns_once",
    ),
)
def _(spark, d):
    turns = b.turns(spark, d).select("video_id", "start", "text")
    lines = b.segments(spark, d).select("video_id", "start", "text")
    return turns.unionByName(lines).withColumn("text", collapse_repeats(F.col("text")))


@query(
    "collapse_words",
    sql(
        "segments",
        """SELECT video_id, start, string_agg(w, ' ' ORDER BY pos) AS text
           FROM (SELECT *, lag(lower(w)) OVER (PARTITION BY video_id, start ORDER BY pos) AS prev
                 FROM (SELECT video_id, start, unnest(string_split(text, ' ')) AS w,
                              unnest(range(len(string_split(text, ' ')))) AS pos FROM segments))
           WHERE prev IS NULL OR prev <> lower(w) GROUP BY video_id, start""",
    ),
)
def _(spark, d):
    return b.segments(spark, d).select(
        "video_id", "start", tx.collapse_repeated_words(F.col("text")).alias("text")
    )


@query(
    "remove_stopwords",
    sql("turns", f"SELECT video_id, start, {b.stop_sql('lower(text)')} AS text FROM turns"),
)
def _(spark, d):
    return b.turns(spark, d).select(
        "video_id", "start", tx.remove_stop_words(F.lower("text")).alias("text")
    )


@query(
    "stopword_anti",
    sql(
        "segments",
        """SELECT w AS word, count(*) AS n
           FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM segments)
           WHERE w NOT IN (SELECT unnest(string_split(lower(text), ' ')) FROM benchmark) GROUP BY w""",
    ),
)
def _(spark, d):
    """Words of the segments outside a word list that is itself a table."""
    words = b.segments(spark, d).select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    listed = b.table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(listed, "word", "left_anti")


@query(
    "text_search",
    sql(
        "chunks",
        "SELECT video_id, chunk_id FROM chunks WHERE regexp_matches(normalized_text, '(^| )th[a-z]*er( |$)')",
    ),
)
def _(spark, d):
    return v.search(b.chunks(spark, d), "(^| )th[a-z]*er( |$)").select("video_id", "chunk_id")


# ------------------------------------------------------------ chunks


@query(
    "join_segments",
    sql(
        "norm",
        """SELECT video_id, block_id, piece, CAST(char_offset AS BIGINT) AS char_offset, total_chars, start_time
           FROM (SELECT video_id, block_id, start_time,
                        CASE WHEN block_id < last_block THEN p || ' ' ELSE p END AS piece,
                        coalesce(sum(length(p) + 1) OVER (PARTITION BY video_id ORDER BY block_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset,
                        CAST(sum(length(p) + 1) OVER (PARTITION BY video_id) - 1 AS BIGINT) AS total_chars
                 FROM (SELECT video_id, CAST(floor(start / 256) AS BIGINT) AS block_id,
                              string_agg(normalized_text, ' ' ORDER BY start) AS p,
                              min(min(start)) OVER (PARTITION BY video_id) AS start_time,
                              max(CAST(floor(start / 256) AS BIGINT)) OVER (PARTITION BY video_id) AS last_block
                       FROM norm GROUP BY video_id, CAST(floor(start / 256) AS BIGINT)))""",
    ),
)
def _(spark, d):
    return ch.join_segments(b.norm(spark, d)).select(
        "video_id", "block_id", "piece", "char_offset", "total_chars", "start_time"
    )


@query("chunk", sql("chunks", "SELECT * FROM chunks"))
def _(spark, d):
    return b.chunks(spark, d)


@query(
    "chunk_turns",
    """WITH j AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, string_agg(text, ' ' ORDER BY turn) AS t,
                         CAST(min(turn) AS DOUBLE) AS start_time FROM conversations GROUP BY conv_id)
       SELECT video_id, k AS chunk_id, substr(t, k * 900 + 1, 1000) AS normalized_text, start_time
       FROM (SELECT *, unnest(range(0, CAST(ceil(length(t) / 900.0) AS BIGINT))) AS k FROM j)""",
)
def _(spark, d):
    return ch.chunk(b.turns(spark, d), text_col="text")


GAP_SQL = """
    ev AS (SELECT CAST(user_id AS VARCHAR) AS video_id, epoch_us(ts) / 1e6 AS start, value AS duration FROM events),
    flagged AS (SELECT *, CASE WHEN start - lag(start + duration) OVER w < 600 THEN 0 ELSE 1 END AS opens
                FROM ev WINDOW w AS (PARTITION BY video_id ORDER BY start, duration)),
    merged AS (SELECT video_id, start, duration,
                      CAST(sum(opens) OVER (PARTITION BY video_id ORDER BY start, duration) - 1 AS BIGINT) AS group_id
               FROM flagged)"""


def _events_as_segments(spark, d):
    return b.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("video_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"),
        F.col("value").alias("duration"),
    )


@query("merge_by_gap", f"WITH {GAP_SQL} SELECT video_id, start, duration, group_id FROM merged")
def _(spark, d):
    return ch.merge_by_gap(_events_as_segments(spark, d), gap=600.0, block_span=86400.0).select(
        "video_id", "start", "duration", "group_id"
    )


@query(
    "gap_spans",
    f"""WITH {GAP_SQL} SELECT video_id, group_id, min(start) AS start,
               round(max(start + duration) - min(start), 4) AS duration, count(*) AS num_segments
        FROM merged GROUP BY video_id, group_id""",
)
def _(spark, d):
    merged = ch.merge_by_gap(_events_as_segments(spark, d), gap=600.0, block_span=86400.0)
    return ch.gap_spans(merged).withColumn("duration", F.round("duration", 4))


@query(
    "chunk_spans",
    sql(
        "norm",
        """, placed AS (SELECT video_id, start, duration, length(normalized_text) AS len,
                  coalesce(sum(length(normalized_text) + 1) OVER (PARTITION BY video_id ORDER BY start
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM norm),
           sizes AS (SELECT video_id, sum(length(normalized_text) + 1) - 1 AS total FROM norm GROUP BY video_id),
           ks AS (SELECT video_id, unnest(range(0, CAST(ceil(total / 900.0) AS BIGINT))) AS chunk_id FROM sizes)
           SELECT k.video_id, chunk_id, min(start) AS start, max(start + duration) - min(start) AS duration,
                  count(*) AS num_segments
           FROM ks k JOIN placed p ON p.video_id = k.video_id AND p.len > 0
                AND p.o < chunk_id * 900 + 1000 AND p.o + p.len > chunk_id * 900
           GROUP BY k.video_id, chunk_id""",
    ),
)
def _(spark, d):
    return ch.chunk_spans(b.norm(spark, d))


@query(
    "label_pivot",
    """SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(quality AS DOUBLE) AS polarity_quality,
              CAST(toxic AS DOUBLE) AS polarity_toxic FROM labels""",
)
def _(spark, d):
    long = (
        b.table(spark, d, "labels")
        .unpivot(["doc_id"], ["quality", "toxic"], "label", "score")
        .select(F.col("doc_id").cast("string").alias("video_id"), "label", F.col("score").cast("double"))
    )
    return sn.label_pivot(long, ["video_id"], ["quality", "toxic"])


# ------------------------------------------------------------ joins


@query(
    "chunks_titled",
    sql("chunks metadata", "SELECT c.*, m.title FROM chunks c LEFT JOIN metadata m USING (video_id)"),
)
def _(spark, d):
    return v.with_titles(b.chunks(spark, d), b.metadata(spark, d))


b.CTES["emo_counts"] = (
    ("labelled",),
    f"""SELECT word, count(*) FILTER (approval) AS ya, count(*) FILTER (NOT approval) AS na,
               count(*) FILTER (annoyance) AS yn, count(*) FILTER (NOT annoyance) AS nn
        FROM (SELECT approval, annoyance, unnest({b.tokens_sql('normalized_text')}) AS word FROM labelled)
        GROUP BY word""",
)
b.CTES["emo_weights"] = (
    ("emo_counts",),
    """SELECT word, ln((ya + 1) / (sum(ya) OVER () + count(*) OVER ())) - ln((na + 1) / (sum(na) OVER () + count(*) OVER ())) AS wa,
              ln((yn + 1) / (sum(yn) OVER () + count(*) OVER ())) - ln((nn + 1) / (sum(nn) OVER () + count(*) OVER ())) AS wn
       FROM emo_counts""",
)
b.CTES["emotions"] = (
    ("emo_weights", "chunk_words"),
    """SELECT c.video_id, c.chunk_id,
              1 / (1 + exp(-(any_value(pa) + coalesce(sum(wa), 0) / greatest(count(w.word), 1)))) AS emotion_approval,
              1 / (1 + exp(-(any_value(pn) + coalesce(sum(wn), 0) / greatest(count(w.word), 1)))) AS emotion_annoyance
       FROM chunks c
       CROSS JOIN (SELECT ln((count(*) FILTER (approval) + 1) / (count(*) FILTER (NOT approval) + 1)) AS pa,
                          ln((count(*) FILTER (annoyance) + 1) / (count(*) FILTER (NOT annoyance) + 1)) AS pn FROM labelled)
       LEFT JOIN chunk_words w ON w.video_id = c.video_id AND w.chunk_id = c.chunk_id
       LEFT JOIN emo_weights e ON e.word = w.word
       GROUP BY c.video_id, c.chunk_id""",
)


@query(
    "enrich_chunks",
    sql(
        "topic_chunks polarity emotions",
        f"""SELECT t.video_id, t.chunk_id, t.normalized_text, t.start_time, t.topic_id,
                   {r6s('polarity_negative', 'polarity_neutral', 'polarity_positive', 'sentiment')},
                   {r6s('emotion_approval', 'emotion_annoyance')}
            FROM topic_chunks t LEFT JOIN polarity p USING (video_id, chunk_id) LEFT JOIN emotions e USING (video_id, chunk_id)""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.chunks(spark, d))
    topics = b.assign(chunks, b.video_topics(spark, d)).select("video_id", "chunk_id", "topic_id")
    labelled = b.stored(b.labelled_norm(spark, d))
    scores = (score(spark, d, chunks, labelled) for score in (b.polarity, b.emotions))
    return v.enrich(chunks, topics, *scores).select(
        "video_id", "chunk_id", "normalized_text", "start_time", "topic_id",
        *r6("polarity_negative", "polarity_neutral", "polarity_positive", "sentiment"),
        *r6("emotion_approval", "emotion_annoyance"),
    )


# ------------------------------------------------------------ sentiment


@query(
    "polarity",
    sql(
        "polarity",
        f"""SELECT video_id, chunk_id, {r6s('polarity_negative', 'polarity_neutral', 'polarity_positive', 'sentiment')}
            FROM polarity""",
    ),
)
def _(spark, d):
    return b.polarity(spark, d).select(
        "video_id", "chunk_id", *r6("polarity_negative", "polarity_neutral", "polarity_positive", "sentiment")
    )


@query(
    "emotions",
    sql("emotions", f"SELECT video_id, chunk_id, {r6s('emotion_approval', 'emotion_annoyance')} FROM emotions"),
)
def _(spark, d):
    return b.emotions(spark, d).select("video_id", "chunk_id", *r6("emotion_approval", "emotion_annoyance"))


def length_model():
    """A stand-in for a caller's model: letters and spaces of a text as two scores."""
    import numpy as np

    def predict(texts):
        return np.array([[len(t) - t.count(" "), t.count(" ")] for t in texts], dtype="float64")

    return predict


@query(
    "score_with_model",
    sql(
        "chunks",
        """SELECT video_id, chunk_id, CAST(length(replace(normalized_text, ' ', '')) AS DOUBLE) AS emotion_letters,
                  CAST(length(normalized_text) - length(replace(normalized_text, ' ', '')) AS DOUBLE) AS emotion_spaces
           FROM chunks""",
    ),
)
def _(spark, d):
    scored = sn.score_with_model(b.chunks(spark, d), length_model, ["letters", "spaces"], "emotion_")
    return scored.select("video_id", "chunk_id", "emotion_letters", "emotion_spaces")


MEANS = """round(avg(polarity_negative), 6) AS polarity_negative_mean,
           round(avg(polarity_neutral), 6) AS polarity_neutral_mean,
           round(avg(polarity_positive), 6) AS polarity_positive_mean"""
MEAN_COLS = ("polarity_negative_mean", "polarity_neutral_mean", "polarity_positive_mean")


@query("sentiment_by_topic", sql("scored", f"SELECT topic_id, {MEANS} FROM scored GROUP BY topic_id"))
def _(spark, d):
    return sn.sentiment_by_topic(b.scored(spark, d)).select("topic_id", *r6(*MEAN_COLS))


@query("distinct_topics", sql("topic_chunks", "SELECT DISTINCT topic_id FROM topic_chunks"))
def _(spark, d):
    return sn.sentiment_by_topic(b.topic_chunks(spark, d))


@query(
    "sentiment_long",
    sql(
        "scored",
        f"""SELECT topic_id, sentiment, score FROM (SELECT topic_id, {MEANS} FROM scored GROUP BY topic_id)
            UNPIVOT (score FOR sentiment IN ({', '.join(MEAN_COLS)}))""",
    ),
)
def _(spark, d):
    means = sn.sentiment_by_topic(b.scored(spark, d)).select("topic_id", *r6(*MEAN_COLS))
    return sn.sentiment_long(means)


# ------------------------------------------------------------ views


@query(
    "overview",
    sql(
        "topic_chunks",
        """SELECT count(*) AS total_chunks, count(DISTINCT video_id) AS total_videos,
                  count(DISTINCT topic_id) FILTER (topic_id <> -1) AS topics_discovered FROM topic_chunks""",
    ),
)
def _(spark, d):
    return v.overview(b.topic_chunks(spark, d))


WATCH = "'https://www.youtube.com/watch?v=' || video_id"


@query(
    "chunk_explorer",
    sql(
        "scored topic_names",
        f"""SELECT {WATCH} AS video_url, title, name AS topic, normalized_text AS text, round(sentiment, 6) AS sentiment
            FROM scored LEFT JOIN topic_names USING (topic_id) WHERE regexp_matches(normalized_text, 'tion')""",
    ),
)
def _(spark, d):
    found = v.explore(b.scored(spark, d), b.topic_names(spark, d), pattern="tion")
    return found.withColumn("sentiment", F.round("sentiment", 6))


@query(
    "topic_options",
    sql("topic_names", "SELECT topic_id, 'Topic ' || topic_id || ': ' || name AS label FROM topic_names"),
)
def _(spark, d):
    return v.topic_options(b.topic_names(spark, d))


@query("video_ids", sql("chunks", "SELECT DISTINCT video_id FROM chunks"))
def _(spark, d):
    return v.video_ids(b.chunks(spark, d))


LONG_TITLE = "repeat(title || ' | ', 8)"


@query(
    "video_options",
    sql(
        "chunks metadata",
        f"""SELECT DISTINCT video_id, {LONG_TITLE} AS title,
                   CASE WHEN length({LONG_TITLE}) > 80 THEN substr({LONG_TITLE}, 1, 80) || '...'
                        ELSE {LONG_TITLE} END AS label
            FROM chunks JOIN metadata USING (video_id)""",
    ),
)
def _(spark, d):
    titled = v.with_titles(b.chunks(spark, d), b.metadata(spark, d))
    return v.video_options(titled.withColumn("title", F.repeat(F.concat("title", F.lit(" | ")), 8)))


@query(
    "video_stats",
    sql(
        "scored",
        """SELECT video_id, total_chunks, round(m, 6) AS avg_sentiment,
                  CASE WHEN m > 0.1 THEN 'Positive' WHEN m < -0.1 THEN 'Negative' ELSE 'Neutral' END AS bucket
           FROM (SELECT video_id, count(*) AS total_chunks, avg(sentiment) AS m FROM scored GROUP BY video_id)""",
    ),
)
def _(spark, d):
    return v.video_stats(b.scored(spark, d)).withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query(
    "video_topic_counts",
    sql("topic_chunks", "SELECT video_id, topic_id, count(*) AS n FROM topic_chunks WHERE topic_id <> -1 GROUP BY ALL"),
)
def _(spark, d):
    return v.video_topic_counts(b.topic_chunks(spark, d))


@query(
    "video_topic_dist",
    sql(
        "topic_chunks topic_names",
        """SELECT video_id, topic_id, name, count(*) AS n FROM topic_chunks LEFT JOIN topic_names USING (topic_id)
           WHERE topic_id <> -1 GROUP BY ALL""",
    ),
)
def _(spark, d):
    dist = v.video_topic_distribution(b.topic_chunks(spark, d), b.topic_names(spark, d))
    return dist.select("video_id", "topic_id", "name", "n")


b.CTES["dominant"] = (
    ("topic_chunks",),
    """SELECT video_id, topic_id, n, n / total * 100 AS share
       FROM (SELECT video_id, topic_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY video_id) AS total,
                    row_number() OVER (PARTITION BY video_id ORDER BY topic_id = -1, count(*) DESC, topic_id) AS r
             FROM topic_chunks GROUP BY video_id, topic_id) WHERE r = 1 AND topic_id <> -1""",
)


@query("dominant_topic", sql("dominant", "SELECT video_id, topic_id, n, round(share, 6) AS share FROM dominant"))
def _(spark, d):
    return v.dominant_topic(b.topic_chunks(spark, d)).withColumn("share", F.round("share", 6))


VIDEO_SENTIMENT_SQL = sql(
    "scored dominant topic_names",
    f"""SELECT title, {WATCH} AS url, name AS dominant_topic, round(m, 6) AS avg_sentiment
        FROM (SELECT video_id, avg(sentiment) AS m, min_by(title, chunk_id) AS title FROM scored GROUP BY video_id)
        LEFT JOIN (SELECT video_id, topic_id FROM dominant) USING (video_id) LEFT JOIN topic_names USING (topic_id)""",
)


@query("video_sentiment", VIDEO_SENTIMENT_SQL)
def video_sentiment(spark, d):
    found = v.video_sentiment(b.scored(spark, d), b.topic_names(spark, d))
    return found.withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query(
    "topic_sentiment_named",
    sql(
        "scored topic_names",
        """SELECT topic_id, name AS topic, round(avg(sentiment), 6) AS avg_sentiment
           FROM scored JOIN topic_names USING (topic_id) WHERE topic_id <> -1 GROUP BY topic_id, name""",
    ),
)
def _(spark, d):
    found = v.topic_sentiment(b.scored(spark, d), b.topic_names(spark, d))
    return found.withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query(
    "sentiment_timeline",
    sql(
        "polarity chunks",
        """SELECT video_id, chunk_id, row_number() OVER (PARTITION BY video_id ORDER BY start_time, chunk_id) - 1 AS x,
                  round(sentiment, 6) AS sentiment
           FROM chunks JOIN polarity USING (video_id, chunk_id)""",
    ),
)
def _(spark, d):
    chunks = b.stored(b.chunks(spark, d))
    scored = chunks.join(b.polarity(spark, d, of=chunks), ["video_id", "chunk_id"])
    return v.sentiment_timeline(scored).withColumn("sentiment", F.round("sentiment", 6))


@query(
    "video_chunks",
    sql(
        "scored topic_names",
        """SELECT video_id, chunk_id AS chunk, name AS topic, normalized_text AS text, round(sentiment, 6) AS sentiment
           FROM scored LEFT JOIN topic_names USING (topic_id)""",
    ),
)
def _(spark, d):
    found = v.video_chunks(b.scored(spark, d), b.topic_names(spark, d))
    return found.withColumn("sentiment", F.round("sentiment", 6))


@query(
    "topic_text",
    sql(
        "topic_chunks",
        """SELECT topic_id, video_id, string_agg(normalized_text, ' ' ORDER BY chunk_id) AS piece
           FROM topic_chunks GROUP BY topic_id, video_id""",
    ),
)
def _(spark, d):
    """Text per topic, one piece per video: a topic's whole text may be too large for a row."""
    pieces = ch.join_segments(b.topic_chunks(spark, d), ["topic_id", "video_id"], order_col="chunk_id")
    return pieces.select("topic_id", "video_id", "piece")


@query("first_n", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 10")
def _(spark, d):
    return v.first_n(b.table(spark, d, "documents").select("doc_id", "source"), 10, ["doc_id"])


@query(
    "sample_n",
    sql(
        "chunks",
        """SELECT video_id, chunk_id FROM chunks ORDER BY md5('42:' || video_id || ':' || chunk_id), video_id, chunk_id
           LIMIT 100""",
    ),
)
def _(spark, d):
    return v.sample_n(b.chunks(spark, d).select("video_id", "chunk_id"), 100)
