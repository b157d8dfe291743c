"""Relational helpers where the library's contract differs from a bare DataFrame call."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import fresh_path


def join_keep_order(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """USING join whose keys keep their places in the left frame (Spark puts them first)."""
    keys = [on] if isinstance(on, str) else list(on)
    joined = left.join(right, keys, how)
    if how.replace("_", "") in ("leftsemi", "leftanti", "semi", "anti"):
        return joined.select(*left.columns)
    rest = [c for c in right.columns if c not in keys]
    if set(left.columns) & set(rest):  # names alone don't tell the sides apart
        own = [joined[k] if k in keys else left[k] for k in left.columns]
        return joined.select(*own, *[right[c] for c in rest])
    return joined.select(*left.columns, *rest)


def with_columns(df: DataFrame, *columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace the columns of several mappings; every expression sees the input's columns only."""
    return df.withColumns({name: c for each in columns for name, c in each.items()})


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute ``df`` now and cut its lineage: as Parquet under ``folder``, by default that in ``tessera.cache_path`` or the shared folder."""
    spark = df.sparkSession
    folder = folder or spark.conf.get("tessera.cache_path", None)
    path = f"{folder.rstrip('/')}/cache-{uuid.uuid4().hex}" if folder else fresh_path(spark, "cache")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_duplicates(df: DataFrame, subset: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each value of ``subset``: the first by ``order``, so that the survivor doesn't depend on the plan.

    Spark cuts each task's rows to the first of a value before the shuffle (WindowGroupLimit), so a
    value that many rows hold sends one row a task.
    """
    number = "row_" + "_".join(df.columns)
    row = F.row_number().over(Window.partitionBy(*subset).orderBy(*order))
    return df.withColumn(number, row).where(F.col(f"`{number}`") == 1).drop(number)


def union_by_name(left: DataFrame, right: DataFrame, missing: bool = False) -> DataFrame:
    """UNION ALL by column name: the left order, then what only the right has; types widen."""
    return left.unionByName(right, allowMissingColumns=missing)
