"""Re-referencing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rereference(signal: DataFrame, ref: str | list[str] = "average", exclude: list[str] | None = None, drop_ref: bool = False) -> DataFrame:
    """Subtract the mean of the reference channels, sample by sample.

    ``"average"`` takes all channels not excluded.  Excluded channels are neither taken nor
    changed.  Nulls are left out of the mean.  ``drop_ref`` drops named reference channels.
    A single window over (recording, sample) holds one row a channel.
    """
    exclude = exclude or []
    names = [ref] if isinstance(ref, str) else list(ref)
    average = names == ["average"]
    taken = ~F.col("channel").isin(exclude) if average else F.col("channel").isin(names)
    if drop_ref and average:
        import warnings

        warnings.warn("an average reference has no channels to drop", stacklevel=2)
    mean = F.avg(F.when(taken, F.col("value"))).over(Window.partitionBy("recording_id", "sample_idx"))
    changed = F.when(F.col("channel").isin(exclude), F.col("value")).otherwise(F.col("value") - mean) if exclude else F.col("value") - mean
    out = signal.withColumn("value", changed)
    return out.where(~F.col("channel").isin(names)) if drop_ref and not average else out


def reference_label(ref: str | list[str]) -> str:
    return "Common Average" if ref == "average" else ref if isinstance(ref, str) else "+".join(ref)
