"""Trigger events: decoding, cleaning, counting, validating, labelling.

Events are rows ``(recording_id, event_seq, onset, onset_time, type, description)``;
``onset`` is a 1-based sample index.  All windows are partitioned by recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIGGER_BITS = 0xFFFF


def _in_order():
    return Window.partitionBy("recording_id").orderBy("event_seq")


#: samples of a block of the status line
STATUS_BLOCK = 65_536


def decode_triggers(status: DataFrame, sampling_rate: float | None = None, block: int = STATUS_BLOCK) -> DataFrame:
    """Events of ``status(recording_id, sample_idx, raw)``: where the low 16 bits change to something not zero.

    Without a ``sampling_rate`` each recording's own is read from the column of that name.

    A code that is on at the first sample is no change and gives no event.  Each block of
    ``block`` samples is looked through by itself and leaves its first and last sample and
    those whose code changes; only these meet by recording, where changes at the seams
    show too, so a recording of any length spreads over tasks.
    """
    order = Window.partitionBy("recording_id").orderBy("sample_idx")
    inner = Window.partitionBy("recording_id", "_block").orderBy("sample_idx")
    code = F.col("raw").cast("int").bitwiseAND(TRIGGER_BITS)
    rate = F.col("sampling_rate") if sampling_rate is None else F.lit(float(sampling_rate))
    coded = status.select("recording_id", "sample_idx", code.alias("type"), rate.alias("_rate"), F.floor(F.col("sample_idx") / F.lit(block)).alias("_block"))
    near = coded.withColumn("before", F.lag("type").over(inner)).withColumn("after", F.lead("type").over(inner))
    told = near.where("before is null or after is null or type <> before").select("recording_id", "sample_idx", "type", "_rate")
    changed = told.withColumn("before", F.lag("type").over(order)).where("type <> 0 and before is not null and type <> before")
    return changed.select(
        "recording_id",
        F.row_number().over(order).cast("long").alias("event_seq"),
        F.col("sample_idx").alias("onset"),
        ((F.col("sample_idx") - 1) / F.col("_rate")).alias("onset_time"),
        "type",
        F.concat(F.lit("Trigger: "), F.col("type")).alias("description"),
    )


def mask_triggers(events: DataFrame) -> DataFrame:
    """Types cut to their low 16 bits; those that become zero go."""
    return events.withColumn("type", F.col("type").cast("int").bitwiseAND(TRIGGER_BITS)).where("type <> 0")


def exclude_types(events: DataFrame, types: list[int]) -> DataFrame:
    return events.where(~F.col("type").isin(types)) if types else events


def select_types(events: DataFrame, types, on_missing: str = "warn") -> DataFrame:
    """Events of the given types, or all for ``"all"``.

    ``on_missing="error"`` looks for types without an event and raises; ``warn`` warns; ``ignore`` doesn't look.
    """
    if types == "all":
        return events
    types = [types] if isinstance(types, int) else list(types)
    chosen = events.where(F.col("type").isin(types))
    if on_missing != "ignore":
        seen = {r["type"] for r in chosen.select("type").distinct().collect()}  # at most len(types) rows
        missing = sorted(set(types) - seen)
        if missing:
            if on_missing == "error":
                raise ValueError(f"no events of types {missing}")
            import warnings

            warnings.warn(f"no events of types {missing}", stacklevel=2)
    return chosen


def merge_runs(events: DataFrame) -> DataFrame:
    """The first of each run of equal types."""
    return events.withColumn("_p", F.lag("type").over(_in_order())).where("_p is null or type <> _p").drop("_p")


def drop_brief(events: DataFrame, least: float = 0.002) -> DataFrame:
    """Events that the next one does not follow within ``least`` seconds."""
    return events.withColumn("_n", F.lead("onset_time").over(_in_order())).where(f"_n is null or _n - onset_time >= {least}D").drop("_n")


def drop_close(events: DataFrame, least: float = 0.01) -> DataFrame:
    """Events at least ``least`` seconds after the one before, which may itself be dropped."""
    return events.withColumn("_p", F.lag("onset_time").over(_in_order())).where(f"_p is null or onset_time - _p >= {least}D").drop("_p")


def clean_triggers(events: DataFrame, mode: str = "auto", trigger_threshold: float = 0.002, min_iei: float = 0.01, exclude: list[int] | None = None) -> DataFrame:
    """``raw`` masks only, ``manual`` also excludes types, ``auto`` then merges runs and drops brief and close events.

    Recordings with one event left before merging are left as they are.
    """
    if mode not in ("auto", "raw", "manual"):
        raise ValueError(f"unknown mode {mode!r}")
    events = mask_triggers(events)
    if mode == "raw":
        return events
    events = exclude_types(events, exclude or [])
    # with one event no step drops anything, so the case needs no branch
    return drop_close(drop_brief(merge_runs(events), trigger_threshold), min_iei) if mode == "auto" else events


def dedupe_onsets(events: DataFrame, on_repeat: str = "drop") -> DataFrame:
    """The first event of each onset; ``error`` raises if there are more."""
    first = Window.partitionBy("recording_id", "onset").orderBy("event_seq")
    ranked = events.withColumn("_r", F.row_number().over(first))
    if on_repeat == "error" and ranked.where("_r > 1").limit(1).count():
        raise ValueError("several events share an onset")
    return ranked.where("_r = 1").drop("_r")


def trigger_table(events: DataFrame) -> DataFrame:
    """``type, n, percentage, first_time, last_time``, most frequent first."""
    whole = Window.partitionBy()
    by = events.groupBy("type").agg(F.count("*").alias("n"), F.min("onset_time").alias("first_time"), F.max("onset_time").alias("last_time"))
    return by.withColumn("percentage", F.bround(F.col("n") * 100.0 / F.sum("n").over(whole), 1)).orderBy(F.desc("n"), "type")


def top_types(events: DataFrame, k: int = 15) -> DataFrame:
    return trigger_table(events).limit(k)


def interval_stats(events: DataFrame) -> DataFrame:
    """Per recording: ``n_events, mean_iei, median_iei, rate_per_min, suggested_tmax``; nulls with fewer than two events."""
    gaps = events.withColumn("gap", F.col("onset_time") - F.lag("onset_time").over(_in_order()))
    by = gaps.groupBy("recording_id").agg(
        F.count("*").alias("n_events"), F.avg("gap").alias("mean_iei"), F.median("gap").alias("median_iei"), F.max("onset_time").alias("_last")
    )
    rate = F.when((F.col("n_events") > 1) & (F.col("_last") > 0), F.col("n_events") / F.col("_last") * 60)
    tmax = F.when(F.col("mean_iei") > 1.0, F.least(F.lit(0.8), F.col("mean_iei") * 0.6)).when(F.col("mean_iei") > 0.5, 0.5).otherwise(0.3)
    return by.select("recording_id", "n_events", "mean_iei", "median_iei", rate.alias("rate_per_min"), tmax.alias("suggested_tmax"))


def event_overview(events: DataFrame) -> DataFrame:
    """Per recording: ``n_events, first_time, last_time, mean_interval, rate_hz``."""
    gaps = events.withColumn("gap", F.col("onset_time") - F.lag("onset_time").over(_in_order()))
    by = gaps.groupBy("recording_id").agg(
        F.count("*").alias("n_events"), F.min("onset_time").alias("first_time"), F.max("onset_time").alias("last_time"), F.avg("gap").alias("mean_interval")
    )
    return by.withColumn("rate_hz", F.when(F.col("mean_interval") > 0, 1 / F.col("mean_interval")))


def import_table(events: DataFrame, lengths: DataFrame, sampling_rate: float) -> DataFrame:
    """A row for each recording of ``lengths(recording_id, n_samples)``, with events or without.

    ``sampling_rate, n_samples, duration_sec`` (the last sample's time), ``n_events, n_types, types`` (the codes
    in order where there are ten at most, else the least and the greatest), ``first_time, last_time, mean_interval,
    rate_hz`` (null with fewer than two events, the rate also where all fall together) and ``note`` (``no events``, else null).
    """
    codes = F.sort_array(F.collect_set("type"))
    by = events.groupBy("recording_id").agg(
        F.count("*").alias("n_events"), codes.alias("_codes"), F.min("onset_time").alias("first_time"), F.max("onset_time").alias("last_time")
    )  # codes have 16 bits, which bounds the set
    listed = F.when(F.col("_codes").isNull(), None).when(F.size("_codes") <= 10, F.array_join("_codes", ", ")).otherwise(F.concat_ws(" to ", F.array_min("_codes").cast("string"), F.array_max("_codes").cast("string")))
    gap = F.when(F.col("n_events") > 1, (F.col("last_time") - F.col("first_time")) / (F.col("n_events") - 1))
    joined = lengths.select("recording_id", F.col("n_samples").cast("long").alias("n_samples")).join(by, "recording_id", "left")
    return joined.select(
        "recording_id", F.lit(float(sampling_rate)).alias("sampling_rate"), "n_samples", ((F.col("n_samples") - 1) / F.lit(float(sampling_rate))).alias("duration_sec"),
        F.coalesce("n_events", F.lit(0).cast("long")).alias("n_events"), F.coalesce(F.size("_codes"), F.lit(0)).cast("long").alias("n_types"), listed.alias("types"),
        "first_time", "last_time", gap.alias("mean_interval"), F.when(gap > 0, 1 / gap).alias("rate_hz"), F.when(F.col("n_events").isNull(), F.lit("no events")).alias("note"),
    )


def _intervals(events: DataFrame) -> DataFrame:
    """``events`` with ``isi``, the milliseconds since the event before."""
    return events.withColumn("isi", (F.col("onset_time") - F.lag("onset_time").over(_in_order())) * 1000)


def validation_summary(events: DataFrame) -> DataFrame:
    """Per recording: interval statistics in milliseconds and their coefficient of variation."""
    by = _intervals(events).groupBy("recording_id").agg(
        F.count("*").alias("n_events"),
        F.countDistinct("type").alias("n_types"),
        F.max("type").alias("max_type"),
        F.avg("isi").alias("mean_isi"),
        F.stddev_samp("isi").alias("sd_isi"),
        F.min("isi").alias("min_isi"),
        F.max("isi").alias("max_isi"),
    )
    return by.withColumn("cv_isi", F.when(F.col("mean_isi") > 0, F.col("sd_isi") / F.col("mean_isi")))


#: variation of intervals above which timing is irregular, and how near to it rounding can decide
IRREGULAR, NEAR = 0.5, 1e-9


def _variation_in_order(intervals: DataFrame) -> DataFrame:
    """``recording_id, _cv``: coefficient of variation by Welford's recurrence over the intervals in order of events."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_seq", "isi"))), lambda x: x["isi"])
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("d"))

    def add(a, x):
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["d"] + (x - mean) * (x - a["mean"])).alias("d"))

    by = intervals.where("isi is not null").groupBy("recording_id").agg(ordered.alias("_x"), F.avg("isi").alias("_mean"))
    return by.select("recording_id", F.aggregate("_x", zero, add, lambda a: F.sqrt(a["d"] / (a["n"] - 1)) / F.col("_mean")).alias("_cv"))


def validation_issues(events: DataFrame) -> DataFrame:
    """``recording_id, issue`` for each of the five checks that a recording fails.

    Where the variation of intervals is ``IRREGULAR`` to rounding, the order of additions decides;
    these recordings alone are added up again in order of events, so that reruns agree.
    """
    per = events.groupBy("recording_id", "type").agg(F.count("*").alias("n")).groupBy("recording_id").agg((F.max("n") / F.min("n")).alias("imbalance"))
    summary = validation_summary(events)
    near = summary.where(F.abs(F.col("cv_isi") - IRREGULAR) <= NEAR).select("recording_id")
    settled = _variation_in_order(_intervals(events).join(near, "recording_id", "left_semi"))
    joined = summary.join(per, "recording_id").join(settled, "recording_id", "left").withColumn("cv_isi", F.coalesce("_cv", "cv_isi"))

    def issue(condition: str, name: str) -> Column:
        return F.when(F.expr(condition), F.lit(name))

    found = F.array(
        issue("n_events < 10", "very_few_events"),
        issue("imbalance > 5", "imbalanced_conditions"),
        issue("min_isi < 50", "double_triggers"),
        issue(f"cv_isi > {IRREGULAR}D", "irregular_timing"),
        issue("max_type > 255", "unusual_trigger_values"),
    )
    return joined.select("recording_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def apply_trigger_labels(events: DataFrame, mapping: dict[int, str], unmapped: str = "unknown") -> DataFrame:
    """A ``label`` column looked up by type."""
    if not mapping:
        return events.withColumn("label", F.lit(unmapped))
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return events.withColumn("label", F.coalesce(F.try_element_at(table, F.col("type")), F.lit(unmapped)))


def label_summary(events: DataFrame) -> DataFrame:
    """Per type: count, first and last onset time to milliseconds."""
    return events.groupBy("type").agg(
        F.count("*").alias("n"), F.round(F.min("onset_time"), 3).alias("first_time"), F.round(F.max("onset_time"), 3).alias("last_time")
    )


def time_histogram(events: DataFrame, width: float) -> DataFrame:
    """Events in bins of ``width`` seconds: ``bin, start_time, n``."""
    bins = F.floor(F.col("onset_time") / F.lit(float(width)))
    return events.groupBy(bins.alias("bin")).agg(F.count("*").alias("n")).withColumn("start_time", F.col("bin") * F.lit(float(width)))
