"""Driver tables as the generic relations that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a session, ordered by (ts, event_id)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", F.col("event_type").alias("item"))


def conversation_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: a conversation is a session, ordered by turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.col("role").alias("item"))
