"""Welch segments over streams of samples: segments hop by counts of samples, whatever the micro-batches are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.spectra import one_sided_power

SEGMENTS = "recording_id string, channel string, segment bigint, freq_idx int, frequency double, power double"


def ready_segments(at: int, idx: np.ndarray, values: np.ndarray, size: int, step: int, lag: int) -> tuple[int, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """What a channel's held samples let go: ``next segment, idx and values still held, segments, their samples``.

    ``idx`` are positions from 0 in order of arrival; of repeated ones the first counts.
    Segment ``k`` is positions ``k * step`` to ``k * step + size - 1``; it goes once it is whole, or once the
    newest sample is ``lag`` or more behind its end, then with NaN where samples are missing.
    Segments without any sample are passed over.  Only positions that an open segment needs are held.
    """
    idx, first = np.unique(idx, return_index=True)
    values = values[first]
    newest = int(idx[-1]) if len(idx) else -1
    segments, rows = [], []
    low = int(np.searchsorted(idx, at * step))
    while low < len(idx):
        held = int(idx[low])
        if held >= at * step + size:  # nothing of this segment has come: it and the next ones are passed over once they are late
            to = min((held - size) // step + 1, (newest - lag - size) // step + 1)
            if to <= at:
                break
            at, low = to, int(np.searchsorted(idx, to * step))
            continue
        high = int(np.searchsorted(idx, at * step + size))
        if high - low < size and newest < at * step + size + lag:
            break
        row = np.full(size, np.nan)
        row[idx[low:high] - at * step] = values[low:high]
        segments.append(at), rows.append(row)
        at += 1
        low = int(np.searchsorted(idx, at * step))
    keep = idx >= at * step
    return at, idx[keep], values[keep], segments, np.array(rows).reshape(-1, size)


def welch_segments(signal: DataFrame, rate: float, window_length: float = 2.0, overlap: float = 0.5, window: str = "hann", n_fft: int | None = None, remove_dc: bool = True, late: float = 10.0) -> DataFrame:
    """Power density of each segment of a stream of ``signal(recording_id, channel, sample_idx, value)``, once.

    Samples (counted from 1) may arrive in any order and in any micro-batches; a segment
    with samples still missing is given up once a sample ``late`` seconds behind its end has come, and its
    powers are null, as are those of segments with null or infinite values.  A sample of segments that are gone is left out.
    The state of a channel is the samples of its open segments: a segment and ``late`` seconds at most,
    beside what one micro-batch brings.  The mean over segments is :func:`..operators.spectra.welch_psd`'s.
    """
    if not 0 <= overlap < 1 or rate <= 0 or late < 0:
        raise ValueError("overlap must be at least 0 and below 1, the rate positive and late not negative")
    size = round(window_length * rate)
    if size < 1:
        raise ValueError("the window is shorter than a sample")
    step, points, lag = max(1, round(size * (1 - overlap))), max(n_fft or size, size), round(late * rate)
    power = one_sided_power(rate, size, points, window, remove_dc)
    frequency = np.arange(points // 2 + 1) * (rate / points)

    def hop(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, idx, values = 0, np.zeros(0, np.int64), np.zeros(0)
        if state.exists:
            at, held, old = state.get
            idx, values = np.frombuffer(bytes(held), np.int64), np.frombuffer(bytes(old))
        for batch in batches:
            idx = np.concatenate([idx, batch["sample_idx"].to_numpy(np.int64) - 1])
            values = np.concatenate([values, batch["value"].to_numpy(np.float64)])
        at, idx, values, segments, x = ready_segments(at, idx, values, size, step, lag)
        state.update((at, idx.tobytes(), values.tobytes()))
        if segments:
            bad = ~np.isfinite(x).all(1)
            p = power(np.where(bad[:, None], 0.0, x))
            p[bad] = np.nan
            n = len(frequency)
            out = pd.DataFrame({"recording_id": key[0], "channel": key[1], "segment": np.repeat(segments, n), "freq_idx": np.tile(np.arange(n, dtype=np.int32), len(segments)), "frequency": np.tile(frequency, len(segments))})
            yield out.assign(power=p.ravel())  # NaN reaches the JVM as null

    narrow = signal.select("recording_id", "channel", "sample_idx", "value")
    return narrow.groupBy("recording_id", "channel").applyInPandasWithState(hop, SEGMENTS, "at bigint, idx binary, value binary", "append", "NoTimeout")
