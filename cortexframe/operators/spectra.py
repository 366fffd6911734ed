"""Spectra of traces: FFT, Welch, multitaper, band power.

A trace is all samples of one recording, channel and (for epochs) trial or condition.
Traces are gathered to arrays in one grouping, transformed as matrices in Arrow
batches, and laid out to rows again on the JVM.  Averages over segments (Welch,
multitaper) gather chunks of consecutive segments instead, so that a trace of any
length spreads over tasks; chunks' sums, or for medians all segments' spectra, meet by trace.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import dpss, median_bias, taper

BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 100.0)}


def frequency_range(fmin: float, fmax: float | None, rate: float) -> tuple[float, float]:
    top = rate / 2
    if fmax is not None and fmax > top:
        warnings.warn(f"fmax is above Nyquist; using {top}", stacklevel=2)
    high = top if fmax is None else min(fmax, top)
    if fmin < 0 or fmin >= high:
        raise ValueError("fmin must lie between 0 and fmax")
    return fmin, high


def traces(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """``keys, x``: values in order of ``index``; null values become NaN."""
    value = F.coalesce(F.col("value"), F.lit(float("nan")))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), value.alias("v")))), lambda s: s["v"]).alias("x"))


#: samples of a chunk of segments
CHUNK = 65_536


def hopping_chunks(rows: DataFrame, keys: list[str], index: str, size: int, step: int, per_chunk: int = 1, start: int | None = None) -> DataFrame:
    """``keys, chunk, x``: the samples of ``per_chunk`` consecutive segments of ``size`` samples, one every ``step``; with 1, a row a segment.

    A sample goes to each chunk that it is part of.  Segments count from the index ``start``,
    or from each trace's least.  Samples after the last whole segment may form a chunk shorter than a segment.
    """
    if start is None:
        least = rows.groupBy(*keys).agg(F.min(index).alias("_start"))  # a row a trace
        least = least.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_start")
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        rows = rows.join(least, same).drop(*[f"_of_{k}" for k in keys])
    hop = per_chunk * step
    reach = size + (per_chunk - 1) * step
    at = F.col("_at")
    first = F.greatest(F.floor((at - reach) / F.lit(hop)) + 1, F.lit(0).cast("long"))
    placed = rows.withColumn("_at", F.col(index).cast("long") - (F.col("_start") if start is None else F.lit(start)))
    dealt = placed.select(*keys, index, "value", "_at", F.explode(F.sequence(first, F.greatest(first, F.floor(at / F.lit(hop))))).alias("chunk"))
    # where segments leave gaps, a sample can be in none
    return traces(dealt.where((at - F.col("chunk") * hop).between(0, reach - 1)), [*keys, "chunk"], index)


def segment_spectra(
    rows: DataFrame, keys: list[str], index: str, n: int, size: int, step: int, periodograms: Callable[[np.ndarray], np.ndarray], average: str = "mean", start: int | None = None, chunk: int | None = None,
) -> DataFrame:
    """``keys, freq_idx, power``: mean or median over segments of what ``periodograms`` makes of matrices of segments (a row each).

    Traces of ``n`` samples that fit a chunk are transformed whole, longer ones in chunks of
    ``chunk`` samples; both give the same.  Segments with a missing or infinite value make
    their trace's powers null; samples after the last whole segment don't count.
    """
    chunk = chunk or CHUNK
    whole = n <= max(chunk, size)
    per = max(1, (chunk - size) // step + 1)

    def spectra_of(x: np.ndarray) -> np.ndarray:
        parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::step]
        parts = parts if whole else parts[:, :per]
        flat = periodograms(parts.reshape(-1, size))
        return flat.reshape(*parts.shape[:2], -1)

    def settled(p: np.ndarray) -> np.ndarray:
        return p.mean(1) if average == "mean" else np.median(p, axis=1) / median_bias(p.shape[1])

    covered = lambda length: (length - size) // step * step + size if length >= size else 0
    if whole:
        return transform_traces(traces(rows, keys, index), keys, lambda x: {"power": settled(spectra_of(x))}, ["power"], covered)
    table, by = hopping_chunks(rows, keys, index, size, step, per, start), [*keys, "chunk"]
    lost = F.count("*") > F.count("power")  # a chunk with a missing value
    if average == "mean":
        sums = transform_traces(table, by, lambda x: {"power": (p := spectra_of(x)).sum(1), "segments": np.full((len(p), p.shape[2]), float(p.shape[1]))}, ["power", "segments"], covered)
        return sums.groupBy(*keys, "freq_idx").agg(F.when(~lost, F.sum("power") / F.sum("segments")).alias("power"))
    # exact medians need every segment's power: rows of one segment each
    each = transform_traces(hopping_chunks(rows, keys, index, size, step, 1, start), by, lambda x: {"power": periodograms(x[:, :size])}, ["power"], lambda length: size if length >= size else 0)
    bias = F.lit(1.0) + F.coalesce(F.aggregate(F.when(F.count("*") >= 3, F.sequence(F.lit(1), F.floor((F.count("*") - 1) / 2).cast("int"))), F.lit(0.0), lambda t, i: t + 1.0 / (2 * i + 1) - 1.0 / (2 * i)), F.lit(0.0))
    return each.groupBy(*keys, "freq_idx").agg(F.when(~lost, F.median("power") / bias).alias("power"))


def transform_traces(table: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: list[str], covered: Callable[[int], int] | None = None) -> DataFrame:
    """Rows ``keys, freq_idx, outputs`` from a kernel over matrices of equally long traces.

    Traces with a missing or infinite value among their first ``covered`` values (of their
    length; all without it) give nulls; traces of which nothing is covered give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, part in batch.groupby(batch["x"].str.len()):
                count = length if covered is None else covered(length)
                if covered is not None and not count:
                    continue
                x = np.stack(part["x"].to_list()).astype(np.float64)
                x[:, count:] = 0.0
                bad = ~np.isfinite(x).all(1)
                got = kernel(np.where(bad[:, None], 0.0, x))
                out = part[keys].copy()
                for name in outputs:
                    values = got[name].copy()
                    values[bad] = np.nan
                    out[name] = list(values)
                yield out

    fields = [f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys]
    arrays = table.mapInPandas(run, ", ".join(fields + [f"{o} array<double>" for o in outputs]))
    laid = arrays.select(*keys, F.posexplode(F.arrays_zip(*outputs)).alias("freq_idx", "o"))
    number = lambda o: F.nanvl(F.col(f"o.{o}"), F.lit(None).cast("double")).alias(o)
    return laid.select(*keys, "freq_idx", *[number(o) for o in outputs])


def _one_sided(x: np.ndarray, n_fft: int) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum and weights that count the bins left out."""
    s = np.fft.rfft(x, n_fft, axis=-1)
    weight = np.full(s.shape[-1], 2.0)
    weight[0] = 1.0
    if n_fft % 2 == 0:
        weight[-1] = 1.0
    return s, weight


def _with_frequency(rows: DataFrame, n_fft: Callable[[], int] | int, rate: float, fmin: float, fmax: float | None) -> DataFrame:
    low, high = frequency_range(fmin, fmax, rate)
    out = rows.withColumn("frequency", F.col("freq_idx") * F.lit(rate / n_fft))
    return out.where(F.col("frequency").between(low, high))


def fft_spectrum(rows: DataFrame, keys: list[str], index: str, rate: float, n: int, n_fft: int | None = None, window: str = "hann", fmin: float = 0.0, fmax: float | None = None, remove_dc: bool = True) -> DataFrame:
    """Amplitude, power and phase of traces of ``n`` samples, padded or cut to ``n_fft``."""
    size = n_fft or n
    w = taper(n, window)

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        x = (x - x.mean(1, keepdims=True) if remove_dc else x) * w
        s, weight = _one_sided(x[:, :size], size)
        amplitude = np.abs(s) / size * weight
        return {"amplitude": amplitude, "power": amplitude**2, "phase": np.angle(s)}

    out = transform_traces(traces(rows, keys, index), keys, kernel, ["amplitude", "power", "phase"])
    return _with_frequency(out, size, rate, fmin, fmax)


def epochs_fft(epochs: DataFrame, rate: float, n: int, per_epoch: bool = False, **options) -> DataFrame:
    """Spectrum of the average over trials, or with ``per_epoch`` mean power and mean amplitude over trials' spectra."""
    if not per_epoch:
        mean = epochs.groupBy("recording_id", "channel", "rel_idx").agg(F.avg("value").alias("value"))
        return fft_spectrum(mean, ["recording_id", "channel"], "rel_idx", rate, n, **options)
    each = fft_spectrum(epochs, ["recording_id", "epoch_id", "channel"], "rel_idx", rate, n, **options)
    return each.groupBy("recording_id", "channel", "freq_idx", "frequency").agg(F.avg("power").alias("power"), F.avg("amplitude").alias("amplitude"))


def welch_setup(rate: float, n: int, window_length: float, overlap: float, n_fft: int | None) -> tuple[int, int, int]:
    """Segment length, step and FFT length."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    size = round(window_length * rate)
    if size > n:
        warnings.warn("the window is longer than the data; using all of it", stacklevel=2)
        size = n
    return size, max(1, round(size * (1 - overlap))), max(n_fft or size, size)


def one_sided_power(rate: float, size: int, points: int, window: str = "hann", remove_dc: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    """Power density per Hz of segments of ``size`` samples, a row each, by transforms of ``points``."""
    w = taper(size, window)

    def periodograms(parts: np.ndarray) -> np.ndarray:
        s, weight = _one_sided((parts - parts.mean(1, keepdims=True) if remove_dc else parts) * w, points)
        return np.abs(s) ** 2 / (rate * (w**2).sum()) * weight

    return periodograms


def welch_psd(
    rows: DataFrame, keys: list[str], index: str, rate: float, n: int, window_length: float = 2.0, overlap: float = 0.5, window: str = "hann",
    n_fft: int | None = None, fmin: float = 0.0, fmax: float | None = None, remove_dc: bool = True, average: str = "mean", start: int | None = None, chunk: int | None = None,
) -> DataFrame:
    """Power density per Hz averaged over overlapping segments; a median is corrected for its bias.  ``start`` and ``chunk`` as in :func:`segment_spectra`."""
    size, step, points = welch_setup(rate, n, window_length, overlap, n_fft)
    periodograms = one_sided_power(rate, size, points, window, remove_dc)
    if average not in ("mean", "median"):
        raise ValueError(f"unknown average {average!r}")
    out = segment_spectra(rows, keys, index, n, size, step, periodograms, average, start, chunk)
    return _with_frequency(out, points, rate, fmin, fmax)


def chosen_tapers(n: int, time_bandwidth: float = 4.0, n_tapers: int | None = None, low_bias: bool = True) -> np.ndarray:
    """Slepian tapers, those concentrated to 0.9 or more if asked (the best one if none is)."""
    v, concentration = dpss(n, time_bandwidth, n_tapers or max(1, int(2 * time_bandwidth - 1)))
    if low_bias:
        keep = concentration >= 0.9
        v = v[keep] if keep.any() else v[[int(np.argmax(concentration))]]
    return v


def multitaper_psd(
    rows: DataFrame, keys: list[str], index: str, rate: float, n: int, time_bandwidth: float = 4.0, n_tapers: int | None = None, low_bias: bool = True,
    segment_length: float | None = None, overlap: float = 0.5, fmin: float = 0.0, fmax: float | None = None, remove_dc: bool = True, compat: bool = False, start: int | None = None, chunk: int | None = None,
) -> DataFrame:
    """Power density per Hz averaged over tapers (and segments); ``compat`` divides by the segment's length once more."""
    size, step, _ = welch_setup(rate, n, segment_length, overlap, None) if segment_length else (n, n, n)
    v = chosen_tapers(size, time_bandwidth, n_tapers, low_bias)
    scale = 1 / rate / (size if compat else 1)

    def periodograms(parts: np.ndarray) -> np.ndarray:
        parts = parts - parts.mean(1, keepdims=True) if remove_dc else parts
        total = np.zeros((len(parts), size // 2 + 1))
        for one in v:
            s, weight = _one_sided(parts * one, size)
            total += np.abs(s) ** 2 * weight * scale
        return total / len(v)

    return _with_frequency(segment_spectra(rows, keys, index, n, size, step, periodograms, "mean", start, chunk), size, rate, fmin, fmax)


def mean_over_epochs(spectrum: DataFrame) -> DataFrame:
    return spectrum.groupBy("recording_id", "channel", "freq_idx", "frequency").agg(F.avg("power").alias("power"))


def band_power(spectrum: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]] | None = None, relative: bool = False) -> DataFrame:
    """``keys, band, power``: trapezoids over the bins from low to high, both inside; null with fewer than two.

    ``relative`` divides by the sum over bands.
    """
    bands = bands or BANDS
    for name, (low, high) in bands.items():
        if not 0 <= low < high:
            raise ValueError(f"band {name}: {low} to {high}")
    table = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in bands.items()])
    # a band without a bin still gets a row
    spread = spectrum.select(*keys, "frequency", "power", F.explode(table).alias("b")).select(*keys, "b.*", "frequency", "power")
    inside = F.col("frequency").between(F.col("low"), F.col("high"))
    spread = spread.withColumn("f", F.when(inside, F.col("frequency"))).withColumn("p", F.when(inside, F.col("power")))
    order = Window.partitionBy(*keys, "band").orderBy(F.col("f").asc_nulls_last())
    area = (F.lead("f").over(order) - F.col("f")) * (F.col("p") + F.lead("p").over(order)) / 2
    out = spread.withColumn("area", area).groupBy(*keys, "band").agg(F.when(F.count("f") >= 2, F.sum("area")).alias("power"))
    return out.withColumn("power", F.col("power") / F.sum("power").over(Window.partitionBy(*keys))) if relative else out


def band_table(bands: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One column a band."""
    return bands.groupBy(*keys).pivot("band", names).agg(F.first("power"))
