"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import BROADCAST_ROWS, forget, materialize, shared_dir, small

__all__ = ["BROADCAST_ROWS", "forget", "materialize", "read", "shared_dir", "small"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
