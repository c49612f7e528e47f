"""The topic report as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import cut_lineage

COHERENCE_COLUMNS = ("c_v", "c_npmi", "u_mass")


def flat(info: DataFrame) -> DataFrame:
    """Topic table with its list columns joined to text."""
    return info.withColumn("Representation", F.array_join("Representation", ", ")).withColumn(
        "Representative_Docs", F.array_join("Representative_Docs", "\n---\n")
    )


def write_report_csv(info: DataFrame, path: str) -> None:
    """One row per topic. Quotes inside texts are doubled, the usual CSV way.

    The rows are stored first, so that only the writing of the one file is a single task.
    """
    cut_lineage(flat(info)).coalesce(1).orderBy("Topic").write.mode("overwrite").option("header", True).option(
        "quote", '"'
    ).option("escape", '"').csv(path)


def read_report_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The report and the names of the coherence columns it has."""
    head = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    report = head.csv(path)
    typed = {"Topic": "int", "Count": "bigint", **{c: "double" for c in COHERENCE_COLUMNS}}
    for name, kind in typed.items():
        if name in report.columns:
            report = report.withColumn(name, F.col(name).cast(kind))
    return report, [c for c in COHERENCE_COLUMNS if c in report.columns]
