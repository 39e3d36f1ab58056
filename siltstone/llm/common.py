"""Shared plumbing: staged tables and table reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.functions.staging import SHUFFLE_CLEANUP, Scratch, scratch_root, shuffles_removed

__all__ = ["SHUFFLE_CLEANUP", "Scratch", "partitions", "scratch_root", "shuffles_removed", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
