"""Statistics and flags of channels and recordings, and slices of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def channel_stats(signal: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per recording and channel: minimum, maximum, mean and standard deviation (of a sample), rounded half to even."""
    by = signal.groupBy("recording_id", "ch_idx", "channel").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    if digits is None:
        return by
    for c in ("min", "max", "mean", "sd"):
        by = by.withColumn(c, F.bround(c, digits))
    return by


def pooled_sd(signal: DataFrame) -> DataFrame:
    return signal.groupBy("recording_id").agg(F.stddev_samp("value").alias("pooled_sd"))


def channel_flags(signal: DataFrame, flat: float = 0.5, amplitude: float = 500.0, outlier: float = 3.0) -> DataFrame:
    """``recording_id, ch_idx, channel, flag`` from the rounded statistics: flat, excessive amplitude, outlying variance."""
    stats = channel_stats(signal)
    medians = stats.groupBy("recording_id").agg(F.median("sd").alias("median_sd"))
    joined = stats.join(medians, "recording_id")
    flags = F.array(
        F.when(F.col("sd") < flat, F.lit("flat")),
        F.when(F.greatest(F.abs("min"), F.abs("max")) > amplitude, F.lit("excessive_amplitude")),
        F.when(F.col("sd") > outlier * F.col("median_sd"), F.lit("outlier_variance")),
    )
    return joined.select("recording_id", "ch_idx", "channel", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("flag"))


def recording_overview(signal: DataFrame, channels: DataFrame, sampling_rate: float) -> DataFrame:
    """Per recording: channels by type, samples, seconds, and pooled statistics of EEG channels."""
    kinds = channels.groupBy("recording_id").agg(
        F.count("*").alias("n_channels"), *[F.sum((F.col("channel_type") == k).cast("long")).alias(f"n_{k}") for k in ("eeg", "external", "status")]
    )
    eeg = signal.join(channels.where("channel_type = 'eeg'").select("recording_id", "ch_idx"), ["recording_id", "ch_idx"])
    pooled = eeg.groupBy("recording_id").agg(
        F.max("sample_idx").alias("n_samples"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    return kinds.join(pooled, "recording_id").withColumn("duration_sec", F.col("n_samples") / F.lit(float(sampling_rate)))


def bad_channels(signal: DataFrame) -> DataFrame:
    """Per channel: does it hold a null, NaN or infinite value."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return signal.groupBy("recording_id", "ch_idx", "channel").agg(F.bool_or(bad).alias("bad"))


def time_slice(signal: DataFrame, start_ms: float, stop_ms: float) -> DataFrame:
    """Samples between those nearest to the two times; of two equally near the earlier.

    Times outside a recording are clipped to it.  The two samples come from one grouping
    that combines before its shuffle, a row a recording; channels repeat the grid and don't
    change it.
    """
    near = lambda ms: F.min_by("sample_idx", F.struct(F.abs(F.col("t") * 1000 - F.lit(float(ms))), F.col("sample_idx")))
    ends = signal.groupBy("recording_id").agg(near(start_ms).alias("_a"), near(stop_ms).alias("_b"))
    return signal.join(ends, "recording_id").where("sample_idx between _a and _b").drop("_a", "_b")


def demean(signal: DataFrame) -> DataFrame:
    """``value`` less its channel's mean over the rows given."""
    from pyspark.sql import Window

    return signal.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("recording_id", "ch_idx")))
