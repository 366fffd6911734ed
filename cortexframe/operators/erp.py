"""Event-related averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_epochs(epochs: DataFrame, by: str = "event_type", method: str = "mean", return_se: bool = True) -> DataFrame:
    """Per condition, channel and sample: ``value, se, n_trials`` over trials, nulls and NaNs left out.

    ``by="all"`` makes one condition.  Of epochs with a ``repeat`` column trials are counted by the samples that are
    no repeats, which needs no shuffle of samples; of others by their ids.  The standard error is that of the mean, for a median too.
    """
    condition = F.lit("all") if by == "all" else F.col("type").cast("string")
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    centre = {"mean": F.avg, "median": F.median}[method]
    trials = F.count_if(~F.col("repeat")) if "repeat" in epochs.columns else F.countDistinct("epoch_id")
    out = epochs.groupBy("recording_id", condition.alias("condition"), "channel", "rel_idx").agg(
        F.min("t").alias("t"), centre(value).alias("value"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), trials.alias("n_trials")
    )
    return out if return_se else out.drop("se")


def confidence_band(evoked: DataFrame, z: float = 1.96) -> DataFrame:
    return evoked.withColumn("low", F.col("value") - z * F.col("se")).withColumn("high", F.col("value") + z * F.col("se"))
