"""Downsampling of signals and events."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Section, butter_lowpass, filtfilt, settling


def factor_for(sampling_rate: float, target: float) -> int:
    """Whole factor nearest to the ratio; under 1.5 is an error, a ratio that isn't whole a warning."""
    ratio = sampling_rate / target
    if ratio < 1.5:
        raise ValueError(f"cannot downsample {sampling_rate} Hz to {target} Hz")
    factor = round(ratio)
    if abs(ratio - factor) > 0.01:
        warnings.warn(f"{target} Hz isn't reachable from {sampling_rate} Hz; using {sampling_rate / factor} Hz", stacklevel=2)
    return factor


def check_bands(bands: dict[str, tuple[float, float]], target: float, cutoff_ratio: float = 0.9) -> list[str]:
    """Names of bands that a low-pass for ``target`` would cut; warns of them."""
    limit = cutoff_ratio * target / 2
    cut = [name for name, (_, high) in bands.items() if high > limit]
    if cut:
        warnings.warn(f"bands {cut} reach above {limit} Hz and will be weakened", stacklevel=2)
    return cut


def keep_every(signal: DataFrame, factor: int, sampling_rate: float) -> DataFrame:
    """Samples 1, 1 + factor, ... renumbered, with their new times."""
    kept = signal.where((F.col("sample_idx") - 1) % factor == 0)
    new = F.floor((F.col("sample_idx") - 1) / F.lit(factor)) + 1
    return kept.withColumn("sample_idx", new).withColumn("t", (F.col("sample_idx") - 1) / F.lit(sampling_rate / factor))


def decimate(signal: DataFrame, factor: int, sampling_rate: float, order: int = 8, cutoff_ratio: float = 0.9, block: int = 65_536) -> DataFrame:
    """Low-pass each channel forward and backward, then keep every ``factor``-th sample.

    A channel is filtered in blocks of ``block`` samples, each with as many samples on
    either side as the filter takes to forget where it began (to 1e-18), so that a channel
    of any length spreads over tasks.  Missing or infinite values are an error.
    """
    design = butter_lowpass(order, cutoff_ratio / factor)
    sections, reach = [Section(b, a) for b, a in design], 2 * settling(design)
    block = max(block, reach)
    first = F.col("sample_idx") - 1
    low, high = F.floor((first - reach) / F.lit(block)), F.floor((first + reach) / F.lit(block))
    smooth = signal.select("recording_id", "ch_idx", "channel", "sample_idx", "t", "value")
    dealt = smooth.withColumn("_block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_idx")
        value = part["value"].to_numpy(np.float64)
        if not np.isfinite(value).all():
            raise ValueError("signals with missing or infinite values can't be filtered")
        own = part["sample_idx"].sub(1).floordiv(block).eq(part["_block"]) & part["sample_idx"].sub(1).mod(factor).eq(0)
        return part.assign(value=filtfilt(sections, value))[own].drop(columns="_block")

    return keep_every(dealt.groupBy("recording_id", "ch_idx", "_block").applyInPandas(one, smooth.schema), factor, sampling_rate)


def remap_events(events: DataFrame, factor: int, sampling_rate: float, n_samples: DataFrame, strategy: str = "round", remove_outside: bool = True) -> DataFrame:
    """Onsets divided by the factor under a strategy (round half to even, nearest, floor, ceiling).

    Onsets outside ``n_samples(recording_id, n_samples)`` of the new grid are removed or clamped.
    Onsets stay 1-based while they are divided, as the compatible behaviour is.
    """
    ratio = F.col("onset") / F.lit(float(factor))
    new = {"round": F.rint(ratio), "nearest": F.rint(ratio), "floor": F.floor(ratio), "ceiling": F.ceil(ratio)}[strategy].cast("long")
    joined = events.join(n_samples.select("recording_id", F.col("n_samples").alias("_n")), "recording_id").withColumn("onset", new)
    joined = joined.where("onset between 1 and _n") if remove_outside else joined.withColumn("onset", F.greatest(F.lit(1), F.least("onset", "_n")).cast("long"))
    return joined.withColumn("onset_time", (F.col("onset") - 1) / F.lit(sampling_rate / factor)).drop("_n")
