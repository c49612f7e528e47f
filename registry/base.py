"""Inputs of the registered queries, derived from the given tables, in Spark and in SQL.

Documents stand for videos: their lines are the segments. Conversations stand for transcripts.
A chunk's topic is its document's source number shifted by the chunk number, or -1 for documents
without a label, so that a video has several topics and there are outliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import sentiment as sn
from lectern.operators.chunking import chunk
from lectern.session import cut_lineage

EMOTIONS = ("approval", "annoyance")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan with fewer tasks than cores over all cores; a scan with enough tasks stays as it is.

    The test tables are one small file each, which would put all text work into one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def segments(spark, d, of: DataFrame | None = None) -> DataFrame:
    docs = spread((table(spark, d, "documents") if of is None else of).select("doc_id", "text"), "doc_id")
    return (
        docs.select(F.col("doc_id").cast("string").alias("video_id"), F.posexplode(F.split("text", "\n")))
        .where(F.trim("col") != "")
        .select(
            "video_id",
            F.col("col").alias("text"),
            F.col("pos").cast("double").alias("start"),
            F.lit(1.0).alias("duration"),
            F.lit("en").alias("lang"),
        )
    )


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"),
        "text",
        F.col("turn").cast("double").alias("start"),
        F.lit(1.0).alias("duration"),
        F.lit("en").alias("lang"),
    )


def norm(spark, d, of: DataFrame | None = None) -> DataFrame:
    return tx.normalize(segments(spark, d, of))


def chunks(spark, d) -> DataFrame:
    return chunk(norm(spark, d))


def metadata(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.concat_ws(" ", "source", "doc_id").alias("title"),
        F.col("source").alias("channel_name"),
    )


def video_topics(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    labelled = table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled"))
    return docs.join(labelled, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.when(F.col("labelled"), F.substring("source", 4, 9).cast("int")).otherwise(-1).alias("base_topic"),
    )


def assign(chunks_df: DataFrame, topics: DataFrame) -> DataFrame:
    shifted = F.when(F.col("base_topic") < 0, -1).otherwise(
        (F.col("base_topic") + F.col("chunk_id")) % 20
    )
    return chunks_df.join(topics, "video_id").withColumn("topic_id", shifted.cast("int")).drop("base_topic")


def topic_chunks(spark, d) -> DataFrame:
    """video_id, chunk_id, normalized_text, start_time, topic_id"""
    return assign(chunks(spark, d), video_topics(spark, d))


def topic_names(spark, d) -> DataFrame:
    return (
        table(spark, d, "documents")
        .select(F.substring("source", 4, 9).cast("int").alias("topic_id"), F.col("source").alias("name"))
        .distinct()
    )


def labelled_norm(spark, d) -> DataFrame:
    """Normalised segments of labelled documents with their polarity class and emotions."""
    labels = table(spark, d, "labels")
    kinds = labels.select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .otherwise("neutral")
        .alias("label"),
        (F.col("quality") == 1).alias("approval"),
        (F.col("toxic") == 1).alias("annoyance"),
    )
    docs = table(spark, d, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    return norm(spark, d, docs).join(kinds, "video_id")


def polarity(spark, d, of: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    weights, bias = map(stored, sn.learn_polarity(labelled_norm(spark, d) if labelled is None else labelled))
    return sn.score_polarity(stored(chunks(spark, d)) if of is None else of, weights, bias)


def emotions(spark, d, of: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    weights, bias = map(stored, sn.learn_emotions(labelled_norm(spark, d) if labelled is None else labelled, EMOTIONS))
    return sn.score_emotions(stored(chunks(spark, d)) if of is None else of, weights, bias, EMOTIONS)


def scored(spark, d) -> DataFrame:
    """Chunks with topic, title and polarity."""
    topical = stored(topic_chunks(spark, d))
    return (
        topical
        .join(metadata(spark, d).select("video_id", "title"), "video_id", "left")
        .join(polarity(spark, d, topical), ["video_id", "chunk_id"], "left")
    )


def stored(df: DataFrame) -> DataFrame:
    """A table as one stage hands it to the next: written and read back."""
    return cut_lineage(df)


# ---------------------------------------------------------------- SQL side

_SPACE = tx.SPACE
_STOP = ", ".join(f"'{w}'" for w in (*tx.STOP_WORDS, ""))


def clean_sql(col: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({col}, '{tx.MARKUP}', ' ', 'g'), "
        f"'{tx.COLOUR_CODE}', '', 'g')), '[^a-z{_SPACE}]', '', 'g'), '[{_SPACE}]+', ' ', 'g'))"
    )


def stop_sql(col: str) -> str:
    return f"array_to_string(list_filter(string_split({col}, ' '), lambda w: w NOT IN ({_STOP})), ' ')"


def tokens_sql(col: str) -> str:
    return f"list_filter(string_split({col}, ' '), lambda w: length(w) >= 2)"


#: Passes that the SQL of repeated phrases can take; a phrase said n times in a row needs log2(n) + 1.
PASSES = 12
WORD = r"[\p{L}\p{N}_]+"


def collapse_ctes(source: str, keys: str) -> str:
    """Common table expressions on ``source`` that end in ``{source}_once`` (keys, text): pass by pass, the
    adjacent copies that begin at each word, those that a scan from the left comes to, and the words left."""
    s, gap = source, WORD.replace("[", "[^", 1)
    parts = [
        f"""{s}_cells AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, {keys}, text, regexp_extract_all(text, '{WORD}') AS words,
                 regexp_extract(text, '^{gap}') AS head,
                 regexp_extract_all(regexp_replace(text, '^{gap}', ''), '{gap}') AS gaps FROM {source}),
        {s}_t0 AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) AS i,
                 coalesce(sum(CASE WHEN NOT regexp_full_match(g, '[ \\x09-\\x0D\\x1C-\\x1F{tx.WIDE_SPACE}]+') THEN 1 ELSE 0 END)
                   OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch
          FROM (SELECT rid, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS raw, unnest(list_transform(words, lambda x: lower(x))) AS w,
                       unnest(list_transform(range(1, len(words) + 1), lambda j: coalesce(gaps[j], ''))) AS g FROM {s}_cells))"""
    ]
    for p in range(PASSES):
        parts.append(
            f"""{s}_copies{p} AS MATERIALIZED (
          SELECT rid, i, max(l) AS l FROM (
            SELECT rid, l, i, max(i) OVER (PARTITION BY rid, l, island) AS last FROM (
              SELECT *, sum(cut) OVER (PARTITION BY rid, l ORDER BY i) AS island FROM (
                SELECT *, CASE WHEN lag(i) OVER n = i - 1 AND lag(same) OVER n THEN 0 ELSE 1 END AS cut
                FROM (SELECT a.rid, a.i, b.i - a.i AS l, a.g = b.g AS same FROM {s}_t{p} a JOIN {s}_t{p} b
                      ON a.rid = b.rid AND a.stretch = b.stretch AND a.w = b.w AND a.i < b.i)
                WINDOW n AS (PARTITION BY rid, l ORDER BY i))))
          WHERE last >= i + l - 1 GROUP BY rid, i),
        {s}_scan{p} AS (
          SELECT rid, min(i) AS i, arg_min(l, i) AS l FROM {s}_copies{p} GROUP BY rid
          UNION ALL
          SELECT c.rid, min(b.i), arg_min(b.l, b.i) FROM {s}_scan{p} c JOIN {s}_copies{p} b ON b.rid = c.rid AND b.i >= c.i + 2 * c.l
          GROUP BY c.rid),
        {s}_taken{p} AS MATERIALIZED (SELECT * FROM {s}_scan{p}),
        {s}_t{p + 1} AS MATERIALIZED (
          SELECT t.rid, t.k, t.raw, t.w, coalesce(after.g, t.g) AS g, row_number() OVER (PARTITION BY t.rid ORDER BY t.k) AS i, t.stretch
          FROM {s}_t{p} t
          LEFT JOIN (SELECT c.rid, c.i + c.l - 1 AS i, t.g FROM {s}_taken{p} c JOIN {s}_t{p} t ON t.rid = c.rid AND t.i = c.i + 2 * c.l - 1) after
            ON after.rid = t.rid AND after.i = t.i
          LEFT JOIN (SELECT rid, unnest(range(i + l, i + 2 * l)) AS i FROM {s}_taken{p}) gone ON gone.rid = t.rid AND gone.i = t.i
          WHERE gone.i IS NULL AND t.rid IN (SELECT rid FROM {s}_taken{p}))"""
        )
    last = " UNION ALL ".join(
        f"SELECT rid, {p} AS pass, raw, g, i FROM {s}_t{p}" for p in range(1, PASSES + 1)
    )
    parts.append(
        f"""{s}_once AS MATERIALIZED (
          SELECT {keys}, coalesce(head || told, text) AS text FROM {s}_cells LEFT JOIN (
            SELECT rid, arg_max(told, pass) AS told FROM (
              SELECT rid, pass, string_agg(raw || g, '' ORDER BY i) AS told FROM ({last}) GROUP BY rid, pass) GROUP BY rid) USING (rid))"""
    )
    return ",\n".join(parts)


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "segments": (
        (),
        """SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(pos - 1 AS DOUBLE) AS start,
                  CAST(1 AS DOUBLE) AS duration, 'en' AS lang, line AS text
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
                 FROM documents)
           WHERE trim(line) <> ''""",
    ),
    "turns": (
        (),
        """SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(turn AS DOUBLE) AS start,
                  CAST(1 AS DOUBLE) AS duration, 'en' AS lang, text FROM conversations""",
    ),
    "segments_once": (("segments",), collapse_ctes("segments", "video_id, start, duration, lang")),
    "turns_once": (("turns",), collapse_ctes("turns", "video_id, start, duration, lang")),
    "norm": (("segments_once",), f"SELECT *, {stop_sql(clean_sql('text'))} AS normalized_text FROM segments_once"),
    "joined": (
        ("norm",),
        """SELECT video_id, string_agg(normalized_text, ' ' ORDER BY start) AS full_text,
                  min(start) AS start_time FROM norm GROUP BY video_id""",
    ),
    "chunks": (
        ("joined",),
        """SELECT video_id, chunk_id, substr(full_text, chunk_id * 900 + 1, 1000) AS normalized_text, start_time
           FROM (SELECT *, unnest(range(0, CAST(ceil(length(full_text) / 900.0) AS BIGINT))) AS chunk_id
                 FROM joined)""",
    ),
    "metadata": (
        (),
        """SELECT CAST(doc_id AS VARCHAR) AS video_id, source || ' ' || doc_id AS title, source AS channel_name
           FROM documents""",
    ),
    "topic_chunks": (
        ("chunks",),
        """SELECT c.video_id, chunk_id, normalized_text, start_time,
                  CAST(CASE WHEN l.doc_id IS NULL THEN -1
                            ELSE (CAST(substr(source, 4) AS INTEGER) + chunk_id) % 20 END AS INTEGER) AS topic_id
           FROM chunks c JOIN documents d ON c.video_id = CAST(d.doc_id AS VARCHAR)
           LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "topic_names": (
        (),
        "SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS topic_id, source AS name FROM documents",
    ),
    "labelled": (
        ("norm",),
        """SELECT n.video_id, n.normalized_text,
                  CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
                  quality = 1 AS approval, toxic = 1 AS annoyance
           FROM norm n JOIN labels l ON n.video_id = CAST(l.doc_id AS VARCHAR)""",
    ),
    "chunk_words": (
        ("chunks",),
        f"""SELECT video_id, chunk_id, unnest({tokens_sql('normalized_text')}) AS word FROM chunks""",
    ),
    "pol_counts": (
        ("labelled",),
        f"""SELECT word, count(*) FILTER (label = 'negative') AS c_neg, count(*) FILTER (label = 'neutral') AS c_neu,
                   count(*) FILTER (label = 'positive') AS c_pos
            FROM (SELECT label, unnest({tokens_sql('normalized_text')}) AS word FROM labelled) GROUP BY word""",
    ),
    "pol_bias": (
        ("pol_counts",),
        """SELECT ln((count(*) FILTER (label = 'negative') + 1) / (count(*) + 3)) AS p_neg,
                  ln((count(*) FILTER (label = 'neutral') + 1) / (count(*) + 3)) AS p_neu,
                  ln((count(*) FILTER (label = 'positive') + 1) / (count(*) + 3)) AS p_pos,
                  (SELECT count(*) FROM pol_counts) AS vocab,
                  (SELECT sum(c_neg) FROM pol_counts) AS t_neg,
                  (SELECT sum(c_neu) FROM pol_counts) AS t_neu,
                  (SELECT sum(c_pos) FROM pol_counts) AS t_pos
           FROM labelled""",
    ),
    "pol_raw": (
        ("pol_bias", "chunk_words"),
        """SELECT c.video_id, c.chunk_id,
                  any_value(p_neg) + coalesce(avg(ln((coalesce(c_neg, 0) + 1) / (t_neg + vocab))) FILTER (w.word IS NOT NULL), 0) AS s_neg,
                  any_value(p_neu) + coalesce(avg(ln((coalesce(c_neu, 0) + 1) / (t_neu + vocab))) FILTER (w.word IS NOT NULL), 0) AS s_neu,
                  any_value(p_pos) + coalesce(avg(ln((coalesce(c_pos, 0) + 1) / (t_pos + vocab))) FILTER (w.word IS NOT NULL), 0) AS s_pos
           FROM chunks c CROSS JOIN pol_bias
           LEFT JOIN chunk_words w ON w.video_id = c.video_id AND w.chunk_id = c.chunk_id
           LEFT JOIN pol_counts p ON p.word = w.word
           GROUP BY c.video_id, c.chunk_id""",
    ),
    "polarity": (
        ("pol_raw",),
        """SELECT video_id, chunk_id, exp(s_neg) / z AS polarity_negative, exp(s_neu) / z AS polarity_neutral,
                  exp(s_pos) / z AS polarity_positive, (exp(s_pos) - exp(s_neg)) / z AS sentiment
           FROM (SELECT *, exp(s_neg) + exp(s_neu) + exp(s_pos) AS z FROM pol_raw)""",
    ),
    "scored": (
        ("topic_chunks", "metadata", "polarity"),
        """SELECT t.*, m.title, p.polarity_negative, p.polarity_neutral, p.polarity_positive, p.sentiment
           FROM topic_chunks t LEFT JOIN metadata m USING (video_id) LEFT JOIN polarity p USING (video_id, chunk_id)""",
    ),
}


def sql(needs: str, body: str) -> str:
    """``body`` with the named common table expressions, and those they need, in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    # Some names stand for a chain of expressions of their own.
    whole = lambda name: CTES[name][1] if name.endswith("_once") else f"{name} AS MATERIALIZED ({CTES[name][1]})"
    parts = ",\n".join(map(whole, order))
    return f"WITH RECURSIVE {parts}\n{body}"
