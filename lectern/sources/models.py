"""A fitted topic model on disk: the projection and the topic tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from lectern.sources.tables import path_exists, read_tables, write_tables

TOPIC_TABLES = ("topic_info", "weights", "centroids", "topics_over_time", "hierarchy")


@dataclass(frozen=True)
class TopicModel:
    """What ``process`` fits: the projection as ML pipeline, and one table per topic product."""

    projection: PipelineModel
    tables: dict[str, DataFrame]

    @property
    def topic_info(self) -> DataFrame:
        return self.tables["topic_info"]


def save_topic_model(model: TopicModel, base: str) -> None:
    model.projection.write().overwrite().save(f"{base}/projection")
    write_tables(model.tables, base, "topics")


def load_topic_model(spark: SparkSession, base: str) -> TopicModel:
    if not path_exists(spark, f"{base}/projection"):
        raise FileNotFoundError(f"{base}/projection")
    return TopicModel(PipelineModel.load(f"{base}/projection"), read_tables(spark, base, "topics"))
