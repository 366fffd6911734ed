"""The data behind plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .channels import region_of
from .quality import demean, time_slice


def butterfly(epochs: DataFrame) -> DataFrame:
    """Mean over trials of each channel: ``recording_id, channel, rel_idx, value``."""
    return epochs.groupBy("recording_id", "channel", "rel_idx").agg(F.avg("value").alias("value"))


def trial_image(epochs: DataFrame) -> DataFrame:
    """Mean over channels of each trial: ``recording_id, epoch_id, rel_idx, value``."""
    return epochs.groupBy("recording_id", "epoch_id", "rel_idx").agg(F.avg("value").alias("value"))


def first_trials(epochs: DataFrame, n: int) -> DataFrame:
    return epochs.where(F.col("epoch_id") <= n)


def sampled_trials(epochs: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` trials of each recording, the same at every run of a seed: those whose ``<trial>:<seed>`` has the least MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.col("epoch_id").cast("string"), F.lit(str(seed))))
    order = Window.partitionBy("recording_id").orderBy(digest, "epoch_id")
    ids = epochs.select("recording_id", "epoch_id").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    return epochs.join(ids, ["recording_id", "epoch_id"])


def signal_view(signal: DataFrame, events: DataFrame, channel: str, start_ms: float, stop_ms: float) -> tuple[DataFrame, DataFrame]:
    """One channel between two times without its mean, and the events in it."""
    cut = demean(time_slice(signal.where(F.col("channel") == channel), start_ms, stop_ms))
    return cut, events.where(F.col("onset_time").between(start_ms / 1000, stop_ms / 1000))


def stacked_sources(sources: DataFrame, spread: float = 2.2) -> DataFrame:
    """Sources at unit deviation, one above the other: adds ``offset`` and ``y``."""
    by = sources.groupBy("recording_id", "component").agg(F.stddev_samp("value").alias("_sd"))
    unit = sources.join(by, ["recording_id", "component"]).withColumn("value", F.when(F.col("_sd") > 0, F.col("value") / F.col("_sd")).otherwise(F.col("value"))).drop("_sd")
    top = unit.groupBy("recording_id").agg(F.max(F.abs("value")).alias("_top"))
    number = F.regexp_extract("component", r"(\d+)", 1).cast("int")
    return unit.join(top, "recording_id").withColumn("offset", -(number - 1) * F.col("_top") * spread).withColumn("y", F.col("value") + F.col("offset")).drop("_top")


def overlay(before: DataFrame, after: DataFrame) -> DataFrame:
    """Values of both signals side by side."""
    keys = ["recording_id", "channel", "sample_idx"]
    return before.select(*keys, F.col("value").alias("before")).join(after.select(*keys, F.col("value").alias("after")), keys)


def electrode_view(montage: DataFrame, highlight: list[str]) -> DataFrame:
    """Positions with the region their names tell and a mark on chosen channels."""
    return montage.withColumn("region", region_of(F.col("channel"))).withColumn("highlighted", F.col("channel").isin(highlight))
