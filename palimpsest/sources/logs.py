"""Standard tables as mutation logs (key, seq, kind, value). Keys are strings of fixed width, so byte order is number order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _digits(name: str, width: int) -> Column:
    """A number padded with zeros; one of more digits keeps them all, where lpad alone would cut it."""
    text = F.col(name).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events overwrite each other; an error deletes the user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    error = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("u"), _digits("user_id", 8)).alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(error, 0).otherwise(1).alias("kind"), F.when(~error, F.concat(F.col("event_type"), F.lit(":"), F.col("props"))).alias("value")
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is put once, in key order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.concat(F.lit("o"), _digits("o_orderkey", 12)).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.lit(1).alias("kind"), F.col("o_orderstatus").alias("value"))
