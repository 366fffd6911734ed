"""Trigger decoding and hopping power over streams of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.triggers import TRIGGER_BITS


def decode_stream(status: DataFrame, sampling_rate: float) -> DataFrame:
    """Events of a stream of ``status(recording_id, sample_idx, raw)`` as they arrive.

    The last code of each recording is the state.  Samples must reach a recording in order
    from one micro-batch to the next; inside one they are sorted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("sample_idx")
        code = (rows["raw"].astype("int64") & TRIGGER_BITS).astype("int64")
        before = code.shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        hit = before.notna() & (code != before) & (code != 0)
        state.update((int(code.iloc[-1]),))
        onset = rows["sample_idx"][hit].astype("int64")
        yield pd.DataFrame({"recording_id": key[0], "onset": onset, "onset_time": (onset - 1) / sampling_rate, "type": code[hit].astype("int32")})

    return status.groupBy("recording_id").applyInPandasWithState(
        step, "recording_id string, onset bigint, onset_time double, type int", "last bigint", "append", "NoTimeout"
    )


def windowed_power(signal: DataFrame, ts: str, window: str = "2 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Mean square of each channel in sliding event-time windows; rows later than ``late`` are left out."""
    w = F.window(F.col(ts), window, slide)
    return (
        signal.withWatermark(ts, late).groupBy("recording_id", "channel", w.alias("w")).agg(F.avg(F.col("value") * F.col("value")).alias("power"), F.count("*").alias("n"))
        .select("recording_id", "channel", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "power", "n")
    )
