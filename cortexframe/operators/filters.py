"""FIR filters: band-pass, high-pass, low-pass, notch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels


def bandpass_taps(rate: float, low: float | None, high: float | None, low_width="auto", high_width="auto", length: int | str = "auto", window: str = "hamming") -> np.ndarray:
    """Kernel of a band-, high- or low-pass; widths and length by rule unless given."""
    nyq = rate / 2
    if low is None and high is None:
        raise ValueError("give a low or a high edge")
    if any(x is not None and not 0 < x < nyq for x in (low, high)) or low is not None and high is not None and low >= high:
        raise ValueError("edges must lie between 0 and Nyquist, low below high")
    left, right = kernels.transition_widths(low, high, rate)
    left = left if low_width == "auto" or low is None else float(low_width)
    right = right if high_width == "auto" or high is None else float(high_width)
    n = kernels.filter_length(left, right, rate, window) if length == "auto" else int(length) + 1 - int(length) % 2
    return kernels.fir_taps(n, *kernels.band_edges(low, high, rate, left, right), window)


def notch_taps(rate: float, freqs: list[float], widths: list[float] | None = None, transition: float = 1.0, length: int | str = "auto", window: str = "hamming") -> np.ndarray:
    """One kernel for all notches."""
    freqs = [float(f) for f in (freqs if isinstance(freqs, list | tuple) else [freqs])]
    widths = widths or [f / 200 for f in freqs]
    n = kernels.filter_length(transition / 2, transition / 2, rate, window) if length == "auto" else int(length) + 1 - int(length) % 2
    return kernels.fir_taps(n, *kernels.notch_edges(freqs, list(widths), rate, transition), window)


#: samples of a block, unless the kernel is longer
BLOCK = 65_536
#: bytes of an Arrow batch to Python, unless the session sets its own bound, and samples of one back, by whole blocks
BATCH_BYTES, BATCH_SAMPLES = 16 << 20, 262_144


def pieces(batch: pa.RecordBatch, column: int, most: int = BATCH_SAMPLES) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` in turn, whose lists of ``column`` hold about ``most`` values a piece, one row at least."""
    ends = batch.column(column).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def fir_filter(signal: DataFrame, taps: np.ndarray, channels: list[str] | None = None, zero_phase: bool = True, block: int | str | None = "auto") -> DataFrame:
    """Filter chosen channels, leave the others; each channel's samples run from 1 without gaps.

    A channel is filtered in blocks of ``block`` samples, each with the samples around it
    that its outputs need, so that a channel of any length spreads over tasks; "auto" takes
    ``BLOCK`` or four kernels, None whole channels.  All give the same values.
    """
    block = max(BLOCK, 4 * len(taps)) if block == "auto" else block
    chosen = F.col("channel").isin(channels) if channels is not None else F.lit(True)
    names = ["recording_id", "ch_idx", "channel", "sample_idx", "t", "value"]
    picked = signal.where(chosen).select(names)
    rest = signal.where(~chosen).select(names) if channels is not None else None

    def whole(trace: pd.DataFrame) -> pd.DataFrame:
        trace = trace.sort_values("sample_idx")
        return trace.assign(value=kernels.fir_apply(trace["value"].to_numpy(np.float64), taps, zero_phase))

    if block is None:
        done = picked.groupBy("recording_id", "ch_idx").applyInPandas(whole, picked.schema)
    else:
        done = _in_blocks(picked, taps, zero_phase, block)
    return done.unionByName(rest) if rest is not None else done


def _in_blocks(picked: DataFrame, taps: np.ndarray, zero_phase: bool, block: int) -> DataFrame:
    """Samples go to their block, those at its edges also to the neighbours whose outputs they reach.

    A block that lacks samples on one side is at that end of its channel, so no length has to be looked up.
    """
    n = len(taps)
    half = (n - 1) // 2
    before, after = (half, half) if zero_phase else (n - 1, 0)
    if block < max(before, after) + 1:
        raise ValueError("a block must be longer than the kernel's reach")
    zero = F.col("sample_idx") - 1
    low, high = F.greatest(F.floor((zero - after) / F.lit(block)), F.lit(0)), F.floor((zero + before) / F.lit(block))
    dealt = picked.withColumn("_block", F.explode(F.sequence(low, high)))
    keys = ["recording_id", "ch_idx", "channel"]
    sample = F.struct(F.col("sample_idx").cast("long").alias("i"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("v"))
    gathered = dealt.groupBy(*keys, "_block").agg(F.collect_list(sample).alias("x"))

    def filtered(first: int, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Outputs from sample ``first`` on, of samples ``idx`` in order."""
        last, size = min(first + block - 1, int(idx[-1])), int(idx[-1])
        wanted = np.arange(first - before, last + after + 1)
        edge = max(min(n, size) - 1, 0)
        y = x[np.clip(wanted, idx[0], size) - idx[0]]
        for side, end in ((wanted < 1, 1), (wanted > size, size)):
            if side.any():
                mirror = 2 * end - wanted[side]
                ok = (np.abs(end - wanted[side]) <= edge) & (mirror >= 1) & (mirror <= size)
                if (ok & (mirror < idx[0])).any():
                    raise ValueError("a block lacks samples that its edge reflects")
                y[side] = np.where(ok, 2 * x[end - idx[0]] - x[np.clip(mirror - idx[0], 0, len(x) - 1)], 0.0)
        return kernels.convolve_valid(y, taps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, 4)):
            lists = batch.column(4)
            cuts, flat = lists.offsets.to_numpy(), lists.values
            flat, cuts = flat.slice(cuts[0], cuts[-1] - cuts[0]), cuts - cuts[0]
            idx, t, x = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            sizes, outs = [], []
            for b, low, high in zip(batch.column(3).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                order = np.argsort(idx[low:high])
                i, first = idx[low:high][order], b * block + 1
                own = (i >= first) & (i < first + block)
                if own.any():  # else the channel ends before the block
                    y = filtered(first, i, x[low:high][order].astype(np.float64))
                    outs.append((i[own], t[low:high][order][own], y[i[own] - first]))
                sizes.append(int(own.sum()))
            i, t, y = (np.concatenate(c) for c in zip(*outs, strict=True)) if outs else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            rows = pa.StructArray.from_arrays([pa.array(i), pa.array(t), pa.array(y)], names=["sample_idx", "t", "value"])
            done = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], done], names=[*keys, "y"])

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if picked.sparkSession.conf.get(bound, None) is None:  # not set by anyone
        picked.sparkSession.conf.set(bound, str(BATCH_BYTES))
    kinds = [f"{k} {picked.schema[k].dataType.simpleString()}" for k in keys]
    done = gathered.select(*keys, "_block", "x").mapInArrow(run, ", ".join(kinds) + ", y array<struct<sample_idx:bigint,t:double,value:double>>")
    return done.select(*keys, F.inline("y")).select(*[F.col(c).cast(picked.schema[c].dataType) for c in picked.columns])


def bandpass(
    signal: DataFrame, rate: float, low: float | None = None, high: float | None = None, channels: list[str] | None = None, zero_phase: bool = True, block: int | str | None = "auto", **design
) -> DataFrame:
    return fir_filter(signal, bandpass_taps(rate, low, high, **design), channels, zero_phase, block)


def notch(signal: DataFrame, rate: float, freqs: list[float], channels: list[str] | None = None, zero_phase: bool = True, block: int | str | None = "auto", **design) -> DataFrame:
    return fir_filter(signal, notch_taps(rate, freqs, **design), channels, zero_phase, block)
