"""From the raw tables to processed chunks, topics and the topic report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import OUTLIER_TOPIC, Settings
from lectern.functions.text import normalize
from lectern.operators import clusters as cl
from lectern.operators import sentiment as sn
from lectern.operators import terms as tm
from lectern.operators import vectors as vc
from lectern.operators.chunking import chunk
from lectern.operators.coherence import coherence_cv, coherence_npmi, coherence_umass
from lectern.operators.overtime import topics_over_time
from lectern.plans.views import enrich, sample_n, with_titles
from lectern.session import cut_lineage
from lectern.sources.models import TopicModel, load_topic_model, save_topic_model
from lectern.sources.reports import write_report_csv
from lectern.sources.tables import read_tables, save_vectors, write_tables

KEY = ["video_id", "chunk_id"]


def process(
    spark: SparkSession,
    base: str,
    polarity_model: tuple[DataFrame, DataFrame],
    emotion_model: tuple[DataFrame, DataFrame, list[str]] | None = None,
    settings: Settings = Settings(),
    sample: int | None = None,
    time_col: str | None = None,
    embedder: Callable | None = None,
) -> TopicModel:
    """Normalise, chunk, embed, cluster, score; write ``processed/chunks`` and the topic model.

    ``polarity_model`` and ``emotion_model`` are learned word weights (see
    ``operators.sentiment``); ``embedder`` is a model factory and replaces the hashed embedding.
    Topics over time go by ``time_col``, a number; without one by the day of publication, of the chunks
    that have it, and by the start of the video where the metadata has no days at all.
    Stages meet at written tables, so that each is worked out once and a lost executor costs no
    more than its own tasks.
    """
    raw = read_tables(spark, base, "raw")
    if not {"transcripts", "metadata"} <= set(raw):
        raise FileNotFoundError(f"no raw transcripts and metadata under {base}; run ingest first")
    topic_cfg = settings.topics
    normal = normalize(raw["transcripts"])
    cut = cut_lineage(chunk(normal, settings.chunks.max_chars, settings.chunks.overlap))
    chunks = cut_lineage(sample_n(with_titles(cut, raw["metadata"]), sample, settings.seed))

    if embedder is None:
        embedded = vc.embed_hashed(chunks.select(*KEY, "normalized_text"), topic_cfg.dims)
    else:
        embedded = vc.embed_with_model(chunks.select(*KEY, "normalized_text"), embedder, batch_size=settings.embed_batch)
    vectors = cut_lineage(embedded.select(*KEY, "embedding"))

    with_vector = vectors.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    if with_vector.isEmpty():
        # Nothing to learn axes from: a model without stages, and no coordinates.
        projection = PipelineModel([])
        flat = vectors.select(*KEY, F.lit(None).cast("array<double>").alias("projected"))
    else:
        projection = Pipeline(stages=[PCA(k=topic_cfg.project_dims, inputCol="v", outputCol="p")]).fit(with_vector)
        flat = cut_lineage(projection.transform(with_vector).select(*KEY, vector_to_array("p").alias("projected")))

    side = topic_cfg.cell_size or cl.suggested_cell_size(flat)
    assigned = cut_lineage(cl.density_tree(flat, side, topic_cfg.min_share, topic_cfg.min_cluster_size))
    if topic_cfg.num_topics is not None:
        # The topics that were found are merged along their tree; outliers stay outliers.
        weighted = cut_lineage(tm.ctfidf(tm.term_counts(chunks.join(assigned, KEY), topic_cfg.min_df)))
        tree = cl.topic_hierarchy(tm.related_topics(weighted), _topics(weighted), leaves=False)
        assigned = cut_lineage(cl.reduce_topics(assigned, tree, topic_cfg.num_topics))
    topical = cut_lineage(chunks.join(assigned, KEY))

    weights = cut_lineage(tm.ctfidf(tm.term_counts(topical, topic_cfg.min_df)))
    words = tm.topic_keywords(weights, topic_cfg.top_words)
    docs = tm.representative_docs(topical, weights, topic_cfg.representative_docs)
    tables = {
        "topic_info": tm.topic_info(topical, words, docs),
        "weights": weights,
        "topics_over_time": topics_over_time(_timed(topical, time_col), weights, "_time", topic_cfg.time_bins),
        "hierarchy": cl.topic_hierarchy(tm.related_topics(weights), _topics(weights)),
    }
    members = vectors.join(assigned, KEY)
    centers = cut_lineage(vc.centroids(members))
    tables["centroids"] = centers
    save_vectors(vectors, base, "embeddings")
    save_vectors(vc.topic_probabilities(vectors, centers), base, "probabilities")

    # The first two coordinates are those a two-dimensional projection would give.
    xy = flat.select(
        *KEY,
        F.col("projected")[0].alias("embedding_umap_x"),
        F.get("projected", F.lit(1)).alias("embedding_umap_y"),
    )
    weights_, bias = map(cut_lineage, polarity_model)
    parts = [xy, sn.score_polarity(chunks, weights_, bias)]
    if emotion_model is not None:
        weights_, bias = map(cut_lineage, emotion_model[:2])
        parts.append(sn.score_emotions(chunks, weights_, bias, emotion_model[2]))
    write_tables({"chunks": enrich(topical, *parts)}, base, "processed")

    model = TopicModel(projection, tables)
    save_topic_model(model, f"{base}/model")
    return model


def _topics(weights: DataFrame) -> DataFrame:
    return weights.where(F.col("topic_id") != OUTLIER_TOPIC).select("topic_id")


def _timed(topical: DataFrame, time_col: str | None) -> DataFrame:
    if time_col is None:
        dated = "publish_date" in topical.columns
        time = F.unix_date(F.col("publish_date").cast("date")) if dated else F.col("start_time")
    else:
        time = F.col(time_col)
    return topical.withColumn("_time", time.cast("double")).where("_time is not null")


def evaluate(spark: SparkSession, base: str, report: str, top_words: int = 10) -> DataFrame:
    """Write the topic table of the saved model with its coherence scores as CSV report and return it."""
    model = load_topic_model(spark, f"{base}/model")
    chunks = read_tables(spark, base, "processed")["chunks"]
    words = cut_lineage(tm.topic_keywords(model.tables["weights"], top_words))
    info = model.topic_info
    for score in (coherence_cv, coherence_npmi, coherence_umass):
        info = info.join(score(chunks, words).withColumnRenamed("topic_id", "Topic"), "Topic", "left")
    # One row: the share of distinct words among all top words.
    info = cut_lineage(info.crossJoin(F.broadcast(tm.topic_diversity(words))))
    write_report_csv(info, report)
    return info
