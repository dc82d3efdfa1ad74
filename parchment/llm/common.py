"""What the operators share: tables in the cluster's shared folder, batch sizes and tables read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchment.store import discard, materialise, shared_dir, small_batches, spread

__all__ = ["discard", "materialise", "read", "shared_dir", "small_batches", "spread"]


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table
