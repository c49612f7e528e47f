"""Groups of Parquet tables, SQL views on them, and parameterised SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The view names saved queries rely on.
VIEWS = {
    "raw_transcripts": ("raw", "transcripts"),
    "raw_metadata": ("raw", "metadata"),
    "processed_chunks": ("processed", "chunks"),
}


def table_path(base: str, group: str, name: str) -> str:
    return f"{base.rstrip('/')}/{group}/{name}.parquet"


def write_tables(tables: dict[str, DataFrame], base: str, group: str) -> None:
    """One Parquet directory per table, replacing what is there; a failed write raises."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(table_path(base, group, name))


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, fs = _file_system(spark, path)
    return fs.exists(where)


def read_tables(spark: SparkSession, base: str, group: str) -> dict[str, DataFrame]:
    """Every table of the group by name; an empty dict if the group is not there."""
    where, fs = _file_system(spark, f"{base.rstrip('/')}/{group}")
    if not fs.exists(where):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    return {
        n.removesuffix(".parquet"): spark.read.parquet(f"{where}/{n}") for n in names if n.endswith(".parquet")
    }


def register_views(spark: SparkSession, base: str) -> list[str]:
    """Temporary views on the tables that are there; returns their names."""
    made = []
    for view, (group, name) in VIEWS.items():
        path = table_path(base, group, name)
        if path_exists(spark, path):
            spark.read.parquet(path).createOrReplaceTempView(view)
            made.append(view)
    return made


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """SQL with named parameters, written ``:name`` in the text."""
    return spark.sql(sql, args=params)


def describe_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column names and types of a Parquet table, from its footer."""
    return spark.read.parquet(path).schema


def save_vectors(df: DataFrame, base: str, name: str) -> None:
    """Vectors (or membership rows) with their key, by name."""
    df.write.mode("overwrite").parquet(table_path(base, "vectors", name))


def load_vectors(spark: SparkSession, base: str, name: str) -> DataFrame:
    path = table_path(base, "vectors", name)
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)
