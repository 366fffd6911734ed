"""Event-locked epochs: extraction, detrending, baseline, rejection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .triggers import dedupe_onsets, mask_triggers, select_types


@dataclass(frozen=True)
class Geometry:
    """Sample offsets and times of an epoch."""

    sampling_rate: float
    tmin: float
    tmax: float

    def __post_init__(self):
        if self.tmin >= self.tmax:
            raise ValueError("tmin must be below tmax")

    @property
    def first(self) -> int:
        return round(self.tmin * self.sampling_rate)

    @property
    def last(self) -> int:
        return round(self.tmax * self.sampling_rate)

    @property
    def size(self) -> int:
        return self.last - self.first + 1

    @property
    def step(self) -> float:
        return (self.tmax - self.tmin) / (self.size - 1)

    def time(self, j: int) -> float:
        return self.tmin + j * self.step

    def nearest(self, t: float) -> int:
        return min(range(self.size), key=lambda j: (abs(self.time(j) - t), j))

    def span(self, window: tuple[float | None, float | None]) -> tuple[int, int]:
        """Indexes of the samples nearest to a window's ends; None is the epoch's end."""
        a, b = window
        return (0 if a is None else self.nearest(a)), (self.size - 1 if b is None else self.nearest(b))


def candidates(events: DataFrame, n_samples: DataFrame, geometry: Geometry) -> DataFrame:
    """Events numbered in order as ``epoch_id``, with ``inside``: does the epoch fit in the recording."""
    order = Window.partitionBy("recording_id").orderBy("event_seq")
    joined = events.join(n_samples.select("recording_id", F.col("n_samples").alias("_n")), "recording_id")
    fits = (F.col("onset") + geometry.first >= 1) & (F.col("onset") + geometry.last <= F.col("_n"))
    return joined.withColumn("epoch_id", F.row_number().over(order).cast("long")).withColumn("inside", fits).drop("_n")


#: samples of a block at least; a block is four epochs long if these are longer
BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _block(geometry: Geometry, sample: Column) -> Column:
    return F.floor(sample / F.lit(max(BLOCK, 4 * geometry.size)))


def sample_blocks(signal: DataFrame, geometry: Geometry) -> DataFrame:
    """``recording_id, _block, traces``: of each channel the samples that epochs starting in a block reach.

    Samples ``x`` of a trace are in order; ``repeat`` marks one whose index came before, ``gapless`` a
    trace whose samples follow each other by one.
    """
    i = F.col("sample_idx")
    blocks = F.sequence(F.greatest(_block(geometry, i - (geometry.size - 1)), F.lit(0)), _block(geometry, i))
    dealt = signal.select("recording_id", F.explode(blocks).alias("_block"), "ch_idx", "channel", i.cast("long").alias("i"), F.col("value").cast("double").alias("value"))
    # dealt out once, by what both groupings share
    by = dealt.repartition("recording_id", "_block").groupBy("recording_id", "_block", "ch_idx", "channel").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("x"))
    marked = F.transform("x", lambda e, k: F.struct(e["i"].alias("i"), e["value"].alias("value"), F.coalesce(F.get("x", k - 1)["i"] == e["i"], F.lit(False)).alias("repeat")))
    gapless = F.forall(F.transform("x", lambda e, k: e["i"] - k), lambda d: d == F.col("x")[0]["i"])
    return by.groupBy("recording_id", "_block").agg(F.collect_list(F.struct("ch_idx", "channel", gapless.alias("gapless"), marked.alias("x"))).alias("traces"))


def extract(blocks: DataFrame, trials: DataFrame, geometry: Geometry) -> DataFrame:
    """``recording_id, epoch_id, type, onset, traces`` of trials that fit, cut from :func:`sample_blocks`.

    No filter looks at ``traces`` here or later: Spark would push it down and work out what made them once more.
    """
    start, stop = F.col("onset") + geometry.first, F.col("onset") + geometry.last
    wanted = trials.select("recording_id", "epoch_id", "type", "onset", _block(geometry, start).alias("_block"))

    def cut(trace: Column) -> Column:
        x = trace["x"]
        first, last = x[0]["i"], x[F.size(x) - 1]["i"]
        low = F.greatest(start, first)
        near = F.slice(x, (low - first + 1).cast("int"), F.greatest(F.least(stop, last) - low + 1, F.lit(0)).cast("int"))
        found = F.when(trace["gapless"], near).otherwise(F.filter(x, lambda e: e["i"].between(start, stop)))
        return F.struct(trace["ch_idx"].alias("ch_idx"), trace["channel"].alias("channel"), found.alias("x"))

    return wanted.join(blocks, ["recording_id", "_block"]).select("recording_id", "epoch_id", "type", "onset", F.transform("traces", cut).alias("traces"))


def _rel(geometry: Geometry, sample: Column) -> Column:
    return (sample - F.col("onset") - geometry.first).cast("int")


def _values(x: Column, geometry: Geometry, span: tuple[int, int] | None = None) -> Column:
    """Values of samples in ``span`` of ``rel_idx`` that aren't null, in order."""
    known = F.filter(x, lambda e: e["value"].isNotNull() if span is None else e["value"].isNotNull() & _rel(geometry, e["i"]).between(*span))
    return F.transform(known, lambda e: e["value"])


def _mean(values: Column) -> Column:
    """Added up in order, so that reruns agree to the last bit."""
    return _let(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v)))


def _median(values: Column) -> Column:
    def middle(v: Column) -> Column:
        n = F.size(v)
        return F.when(n > 0, v[F.floor((n - 1) / 2).cast("int")] * 0.5 + v[F.floor(n / 2).cast("int")] * 0.5)

    return _let(F.sort_array(values), middle)


def _on_traces(epochs: DataFrame, change) -> DataFrame:
    """``epochs`` with ``change(x)`` as the samples of each trace."""
    return epochs.withColumn("traces", F.transform("traces", lambda t: F.struct(t["ch_idx"].alias("ch_idx"), t["channel"].alias("channel"), change(t["x"]).alias("x"))))


def _less(x: Column, amount) -> Column:
    return F.transform(x, lambda e: F.struct(e["i"].alias("i"), (e["value"] - amount(e)).alias("value"), e["repeat"].alias("repeat")))


def detrend(epochs: DataFrame, order: int, geometry: Geometry) -> DataFrame:
    """Remove each trace's mean (0) or least-squares line (1)."""
    if order == 0:
        return _on_traces(epochs, lambda x: _let(_mean(_values(x, geometry)), lambda level: _less(x, lambda e: level)))
    if order != 1:
        raise ValueError("order must be 0 or 1")

    def total(x: Column, term) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, e: a + term(e))

    def straight(x: Column) -> Column:
        known = F.filter(x, lambda e: e["value"].isNotNull())
        rel = lambda e: _rel(geometry, e["i"])
        middle = _let(known, lambda k: F.struct(k.alias("k"), (total(k, rel) / F.nullif(F.size(k), F.lit(0))).alias("r"), _mean(F.transform(k, lambda e: e["value"])).alias("v")))
        slope = _let(middle, lambda m: F.struct(
            m["r"].alias("r"), m["v"].alias("v"),
            (total(m["k"], lambda e: (rel(e) - m["r"]) * (e["value"] - m["v"])) / F.nullif(total(m["k"], lambda e: (rel(e) - m["r"]) * (rel(e) - m["r"])), F.lit(0.0))).alias("slope"),
        ))
        return _let(slope, lambda m: _less(x, lambda e: m["slope"] * rel(e) + (m["v"] - m["slope"] * m["r"])))

    return _on_traces(epochs, straight)


def baseline(epochs: DataFrame, span: tuple[int, int], geometry: Geometry, method: str = "mean") -> DataFrame:
    """Subtract each trace's mean or median over ``span`` of ``rel_idx``."""
    if method == "none":
        return epochs
    level_of = {"mean": _mean, "median": _median}[method]
    return _on_traces(epochs, lambda x: _let(level_of(_values(x, geometry, span)), lambda level: _less(x, lambda e: level)))


def amplitude_rejections(
    epochs: DataFrame, span: tuple[int, int], geometry: Geometry, reject: float | None = None, flat: float | None = None, picks: list[str] | None = None
) -> DataFrame:
    """``recording_id, epoch_id, channel, code, p2p`` of the first channel of each epoch that fails.

    Peak to peak above ``reject`` is looked at before one under ``flat``.
    """

    def verdict(t: Column) -> Column:
        p2p = _let(_values(t["x"], geometry, span), lambda v: F.array_max(v) - F.array_min(v))

        def code(p: Column) -> Column:
            high = p > F.lit(reject) if reject is not None else F.lit(False)
            low = p < F.lit(flat) if flat is not None else F.lit(False)
            return F.struct(t["ch_idx"].alias("ch_idx"), t["channel"].alias("channel"), F.when(high, "amplitude").when(low, "flat").alias("code"), p.alias("p2p"))

        return _let(p2p, code)

    looked = F.filter("traces", lambda t: t["channel"].isin(picks)) if picks else F.col("traces")
    failed = F.array_min(F.filter(F.transform(looked, verdict), lambda f: f["code"].isNotNull()))
    return epochs.select("recording_id", "epoch_id", F.inline_outer(F.array(failed))).where("code is not null").select("recording_id", "epoch_id", "channel", "code", "p2p")


def lay_out(epochs: DataFrame, geometry: Geometry) -> DataFrame:
    """A row for each sample; ``repeat`` is true for further samples of one trial, channel and index."""
    traces = epochs.select("recording_id", "epoch_id", "type", "onset", F.inline_outer("traces")).select("recording_id", "epoch_id", "type", "onset", "ch_idx", "channel", F.inline_outer("x")).where("i is not null")
    rel = _rel(geometry, F.col("i"))
    return traces.select(
        "recording_id", "epoch_id", "type", "onset", "channel", "ch_idx", rel.alias("rel_idx"), (F.lit(geometry.tmin) + rel * geometry.step).alias("t"), "value", "repeat"
    )


def rejection_log(trials: DataFrame, failed: DataFrame | None) -> DataFrame:
    """Why each rejected trial was rejected; ``epoch_id`` counts before rejection."""
    edge = trials.where(~F.col("inside")).select(
        "recording_id", "epoch_id", F.col("type").alias("event_type"), F.col("onset_time").alias("event_time"),
        F.lit(None).cast("string").alias("channel"), F.lit("boundary").alias("code"), F.lit("Extends beyond data boundaries").alias("reason"),
    )
    if failed is None:
        return edge
    text = F.when(
        F.col("code") == "amplitude", F.format_string("Peak-to-peak amplitude exceeds threshold (%.1f microV)", "p2p")
    ).otherwise(F.format_string("Flat signal detected (%.2f microV peak-to-peak)", "p2p"))
    bad = failed.join(trials, ["recording_id", "epoch_id"]).select(
        "recording_id", "epoch_id", F.col("type").alias("event_type"), F.col("onset_time").alias("event_time"), "channel", "code", text.alias("reason")
    )
    return edge.unionByName(bad)


@dataclass
class Epochs:
    data: DataFrame | None
    events: DataFrame
    log: DataFrame
    geometry: Geometry


def epoch_recording(
    signal: DataFrame, events: DataFrame, n_samples: DataFrame, geometry: Geometry, types="all", baseline_window=(-0.2, 0.0), baseline_method: str = "mean",
    reject_threshold: float | None = None, flat_threshold: float | None = None, reject_window=(None, None), detrend_order: int | None = None,
    event_repeated: str = "drop", on_missing: str = "ignore", preload: bool = True,
) -> Epochs:
    """Mask, select, dedupe, check boundaries, detrend, correct, reject and renumber, in this order.

    ``preload=False`` stops before any sample is read and gives the events that fit.
    """
    chosen = dedupe_onsets(select_types(mask_triggers(events), types, on_missing), event_repeated)
    trials = candidates(chosen, n_samples, geometry)
    if not preload:
        return Epochs(None, _renumber(trials.where("inside")), rejection_log(trials, None), geometry)
    blocks = sample_blocks(signal, geometry)

    def corrected(some: DataFrame) -> DataFrame:
        cut = extract(blocks, some, geometry)
        if detrend_order is not None:
            cut = detrend(cut, detrend_order, geometry)
        return cut if baseline_window is None else baseline(cut, geometry.span(baseline_window), geometry, baseline_method)

    failed = None
    kept = trials.where("inside")
    if reject_threshold is not None or flat_threshold is not None:
        # trials are cut twice, to be judged and to be kept, so that only verdicts and numbers are shuffled
        failed = amplitude_rejections(corrected(kept), geometry.span(reject_window), geometry, reject_threshold, flat_threshold)
        kept = kept.join(failed.select("recording_id", "epoch_id"), ["recording_id", "epoch_id"], "left_anti")
    numbered = _renumber(kept)
    return Epochs(lay_out(corrected(numbered), geometry), numbered, rejection_log(trials, failed), geometry)


def condition_order(events: DataFrame) -> DataFrame:
    """``recording_id, type, position``: types numbered from 1 in the order in which they first occur."""
    firsts = events.groupBy("recording_id", "type").agg(F.min(F.struct("onset", "event_seq")).alias("_first"))
    order = Window.partitionBy("recording_id").orderBy("_first")
    return firsts.select("recording_id", "type", F.row_number().over(order).alias("position"))


def _renumber(trials: DataFrame) -> DataFrame:
    order = Window.partitionBy("recording_id").orderBy("event_seq")
    return trials.withColumnRenamed("epoch_id", "candidate_id").withColumn("epoch_id", F.row_number().over(order).cast("long")).drop("inside")
