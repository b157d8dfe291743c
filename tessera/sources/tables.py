"""Named Parquet tables of a data folder, read through Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: a Parquet file or a folder of them, by any path Spark reads."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False) -> DataFrame:
    """CSV with doubled quotes; empty cells and ``null`` are null, short rows are padded; all strings without a schema."""
    reader = spark.read.option("escape", '"').option("nullValue", "null").option("header", header)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    """CSV that ``read_csv`` reads back; nulls are written as ``null``."""
    df.write.mode(mode).option("escape", '"').option("nullValue", "null").option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), compression: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet, in folders by ``partition_by``."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    (writer.option("compression", compression) if compression else writer).parquet(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """A temporary view of ``df``, read back by name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
