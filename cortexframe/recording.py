"""A recording (or many): the canonical tables and what has been done to them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import channels as channels_
from .operators import epochs as epochs_
from .operators import filters, quality, reference, resample, triggers


@dataclass(frozen=True)
class Recording:
    """Handles to the tables ``signal``, ``channels``, ``events``; every step gives a new one."""

    signal: DataFrame
    channels: DataFrame
    events: DataFrame | None
    sampling_rate: float
    montage: DataFrame | None = None
    reference: str = "original"
    metadata: dict[str, str] = field(default_factory=dict)
    history: tuple[str, ...] = ()

    @classmethod
    def from_signal(cls, signal: DataFrame, sampling_rate: float, events: DataFrame | None = None, **more) -> Recording:
        """From ``signal(recording_id, ch_idx, channel, sample_idx, value)``; types of channels follow from their names."""
        if sampling_rate <= 0:
            raise ValueError("the sampling rate must be positive")
        missing = {"recording_id", "ch_idx", "channel", "sample_idx", "value"} - set(signal.columns)
        if missing:
            raise ValueError(f"the signal lacks columns {sorted(missing)}")
        if "t" not in signal.columns:
            signal = signal.withColumn("t", (F.col("sample_idx") - 1) / F.lit(float(sampling_rate)))
        names = signal.select("recording_id", "ch_idx", "channel").distinct()
        return cls(signal, channels_.classify_channels(names), events, float(sampling_rate), **more)

    @classmethod
    def from_matrix(cls, spark: SparkSession, data, channels: list[str], sampling_rate: float, recording_id: str = "recording", **more) -> Recording:
        """From an array of channels by samples, a row a channel."""
        if len(data) != len(channels):
            raise ValueError(f"{len(data)} rows of data for {len(channels)} channels")
        rows = [(recording_id, i + 1, c, [float(v) for v in x]) for i, (c, x) in enumerate(zip(channels, data, strict=True))]
        wide = spark.createDataFrame(rows, "recording_id string, ch_idx int, channel string, x array<double>")
        laid = wide.select("recording_id", "ch_idx", "channel", F.posexplode("x").alias("_i", "value"))
        return cls.from_signal(laid.select("recording_id", "ch_idx", "channel", (F.col("_i") + 1).cast("long").alias("sample_idx"), "value"), sampling_rate, **more)

    @classmethod
    def from_bdf(cls, spark: SparkSession, path: str, channels: list[str] | None = None) -> Recording:
        """Files of one sampling rate; events come from each file's status line, whatever ``channels`` are read.

        Files with different rates are an error: read them with :meth:`from_bdf_by_rate`.
        """
        found = cls.from_bdf_by_rate(spark, path, channels)
        if len(found) != 1:
            raise ValueError(f"the files have sampling rates {sorted(found)}; from_bdf_by_rate gives a recording for each")
        return next(iter(found.values()))

    @classmethod
    def from_bdf_by_rate(cls, spark: SparkSession, path: str, channels: list[str] | None = None) -> dict[float, Recording]:
        """A handle for the recordings of each sampling rate (that of a file's fastest channel but the status line)."""
        from .sources.bdf import read_bdf, read_bdf_header, read_status, status_channels

        header = read_bdf_header(spark, path)
        status = status_channels(header)
        rates = header.join(status, ["recording_id", "ch_idx"], "left_anti").groupBy("recording_id").agg(F.max("sampling_rate").alias("_rate"))
        signal = read_bdf(spark, path, channels).join(status, ["recording_id", "ch_idx"], "left_anti")
        events = triggers.decode_triggers(read_status(spark, path))
        out = {}
        for (rate,) in sorted(rates.select("_rate").distinct().collect()):  # as many as kinds of devices
            own = rates.where(F.col("_rate") == rate).select("recording_id")
            found = {"metadata": {"file_path": path}, "reference": "CMS/DRL", "history": ("imported",)}
            out[rate] = cls.from_signal(signal.join(own, "recording_id"), rate, events.join(own, "recording_id"), **found)
        return out

    def _then(self, note: str, **changes) -> Recording:
        return replace(self, history=(*self.history, note), **changes)

    def lengths(self) -> DataFrame:
        return self.signal.groupBy("recording_id").agg(F.max("sample_idx").alias("n_samples"))

    def import_table(self) -> DataFrame:
        """What an import found, a row a recording, see :func:`.operators.triggers.import_table`; with where it came from."""
        events = self.events if self.events is not None else self.signal.sparkSession.createDataFrame([], "recording_id string, onset_time double, type int")
        out = triggers.import_table(events, self.lengths(), self.sampling_rate)
        return out.withColumn("file_path", F.lit(self.metadata.get("file_path", "unknown")))

    def filter(self, low: float | None = None, high: float | None = None, **design) -> Recording:
        """``design`` are the kernel's options, and ``block`` samples a task filters at once."""
        return self._then(f"band-pass {low} to {high} Hz", signal=filters.bandpass(self.signal, self.sampling_rate, low, high, **design))

    def notch(self, freqs: list[float], **design) -> Recording:
        return self._then(f"notch at {freqs} Hz", signal=filters.notch(self.signal, self.sampling_rate, freqs, **design))

    def rereference(self, ref: str | list[str] = "average", exclude: list[str] | None = None, drop_ref: bool = False) -> Recording:
        signal = reference.rereference(self.signal, ref, exclude, drop_ref)
        names = [ref] if isinstance(ref, str) else ref
        kept = self.channels.where(~F.col("channel").isin(names)) if drop_ref and ref != "average" else self.channels
        label = reference.reference_label(ref)
        return self._then(f"re-referenced to {label}", signal=signal, channels=kept, reference=label)

    def downsample(self, target: float, method: str = "decimate", strategy: str = "round", remove_outside: bool = True) -> Recording:
        factor = resample.factor_for(self.sampling_rate, target)
        if method not in ("decimate", "simple"):
            raise ValueError(f"unknown method {method!r}")
        reduce = resample.decimate if method == "decimate" else resample.keep_every
        signal = reduce(self.signal, factor, self.sampling_rate)
        n = self.lengths().withColumn("n_samples", F.floor((F.col("n_samples") - 1) / factor) + 1)
        events = None if self.events is None else resample.remap_events(self.events, factor, self.sampling_rate, n, strategy, remove_outside)
        return self._then(f"downsampled by {factor} ({method})", signal=signal, events=events, sampling_rate=self.sampling_rate / factor)

    def rename(self, labels: dict[str, str], keep_original: bool = True) -> Recording:
        """Channel types stay what they were, whatever the new names."""
        change = lambda df: channels_.rename_channels(df, labels, keep_original)
        return self._then("channels renamed", signal=change(self.signal), channels=change(self.channels))

    def label_events(self, mapping: dict[int, str], unmapped: str = "unknown") -> Recording:
        return self._then("events labelled", events=triggers.apply_trigger_labels(self.events, mapping, unmapped))

    def with_montage(self, montage: DataFrame | None = None) -> Recording:
        return self._then("montage set", montage=channels_.set_montage(self.channels, montage if montage is not None else channels_.create_montage(self.channels)))

    def epochs(self, tmin: float = -0.2, tmax: float = 0.8, **options) -> epochs_.Epochs:
        return epochs_.epoch_recording(self.signal, self.events, self.lengths(), epochs_.Geometry(self.sampling_rate, tmin, tmax), **options)

    def summary(self, **thresholds) -> tuple[DataFrame, DataFrame]:
        return quality.channel_stats(self.signal), quality.channel_flags(self.signal, **thresholds)

    def overview(self) -> DataFrame:
        return quality.recording_overview(self.signal, self.channels, self.sampling_rate)


def events_of(source: str | Path | Recording | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Events of a recording file or a directory of files, of a :class:`Recording`, or a table of events itself.

    Of files only the status lines are read.  A path to nothing is a FileNotFoundError, a
    recording without a table of events a ValueError, and anything else, a table without ``onset``,
    ``onset_time`` and ``type`` included, a TypeError.
    """
    if isinstance(source, Recording):
        if source.events is None:
            raise ValueError("the recording has no table of events")
        return source.events
    if isinstance(source, DataFrame):
        missing = {"onset", "onset_time", "type"} - set(source.columns)
        if missing:
            raise TypeError(f"a table of events has columns {sorted(missing)} too")
        return source
    if isinstance(source, str | Path):
        from .sources.bdf import list_files, read_status

        path = str(source)
        if not list_files(path):
            raise FileNotFoundError(f"there is no recording file at {path}")
        session = spark or SparkSession.getActiveSession()
        if session is None:
            raise ValueError("reading a file needs a session")
        return triggers.decode_triggers(read_status(session, path))
    raise TypeError(f"neither a path, a recording nor a table of events: {type(source).__name__}")
