"""Short descriptions of tables, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ica import ICA


def describe_spectrum(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: bins, range and spacing of frequencies, and where the power is greatest."""
    by = spectrum.groupBy(*keys).agg(
        F.count("*").alias("n_bins"), F.min("frequency").alias("low"), F.max("frequency").alias("high"),
        F.max_by("frequency", F.struct(F.col("power"), -F.col("frequency"))).alias("peak_frequency"), F.max("power").alias("peak_power"),
    )
    return by.withColumn("resolution", F.when(F.col("n_bins") > 1, (F.col("high") - F.col("low")) / (F.col("n_bins") - 1)))


def describe_montage(montage: DataFrame) -> DataFrame:
    return montage.agg(F.count("*").alias("n_channels"), *[f(F.col(c)).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def describe_ica(spark: SparkSession, ica: ICA) -> DataFrame:
    row = (len(ica.channels), ica.n_components, ica.n_iter, ",".join(f"IC{k}" for k in ica.exclude), ica.unmixing is not None)
    return spark.createDataFrame([row], "n_channels int, n_components int, n_iter int, excluded string, fitted boolean")
