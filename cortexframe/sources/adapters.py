"""Canonical tables made from the star-schema tables, all partitioned by recording.

A supplier's line items are a recording of four channels, a user's events one of a
single channel with a status line, and an embedding is one trial of an epoched
recording.  Sample numbers are ranks within a recording, so nothing is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_RATE = 256.0
EVENT_RATE = 64.0
EPOCH_RATE = 64.0
LINE_CHANNELS = [(1, "Cz", "l_quantity"), (2, "Pz", "l_extendedprice"), (3, "Oz", "l_discount"), (4, "EXG1", "l_tax")]
#: status codes of event types; the last has a bit above the low 16
CODES = {"view": 0, "click": 1, "purchase": 2, "signup": 255, "error": 65536 + 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").withColumn("sample_idx", F.row_number().over(order).cast("long"))
    each = F.array(*[F.struct(F.lit(i).alias("ch_idx"), F.lit(c).alias("channel"), F.col(x).cast("double").alias("value")) for i, c, x in LINE_CHANNELS])
    return rows.select(F.col("l_suppkey").cast("string").alias("recording_id"), "sample_idx", F.explode(each).alias("c")).select(
        "recording_id", "c.ch_idx", "c.channel", "sample_idx", ((F.col("sample_idx") - 1) / F.lit(LINE_RATE)).alias("t"), "c.value"
    )


def channels_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordings = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("recording_id")).distinct()
    each = F.array(*[F.struct(F.lit(i).alias("ch_idx"), F.lit(c).alias("channel")) for i, c, _ in LINE_CHANNELS])
    return recordings.select("recording_id", F.explode(each).alias("c")).select("recording_id", "c.*")


def _user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return rows.withColumn("sample_idx", F.row_number().over(order).cast("long")).withColumn("recording_id", F.col("user_id").cast("string"))


def signal_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_events(spark, sf_dir).select(
        "recording_id", F.lit(1).alias("ch_idx"), F.lit("Cz").alias("channel"), "sample_idx",
        ((F.col("sample_idx") - 1) / F.lit(EVENT_RATE)).alias("t"), F.col("value").cast("double").alias("value"),
    )


def status_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("event_type")]
    return _user_events(spark, sf_dir).select("recording_id", "sample_idx", F.coalesce(code, F.lit(0)).cast("long").alias("raw"))


def lengths(signal: DataFrame) -> DataFrame:
    return signal.groupBy("recording_id").agg(F.max("sample_idx").alias("n_samples"))


def epochs_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("rel_idx", "value"))
    return rows.select(
        F.lit("emb").alias("recording_id"), F.col("vec_id").alias("epoch_id"), F.col("label").alias("type"), F.lit("emb").alias("channel"), F.lit(1).alias("ch_idx"),
        "rel_idx", (F.col("rel_idx") / F.lit(EPOCH_RATE)).alias("t"), F.col("value").cast("double").alias("value"),
    )
