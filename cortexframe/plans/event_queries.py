"""Queries on triggers and events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import triggers as T
from ..sources import adapters as A
from .tables_sql import DECODED, RAW

LABELS = {1: "standard", 2: "target", 255: "response"}
KEEP = ["recording_id", "event_seq", "onset", "onset_time", "type"]


def _decoded(spark, sf) -> DataFrame:
    return T.decode_triggers(A.status_from_events(spark, sf), A.EVENT_RATE)


def _raw(spark, sf) -> DataFrame:
    """Every sample as an event, its code with all bits."""
    s = A.status_from_events(spark, sf)
    return s.select(
        "recording_id", F.col("sample_idx").alias("event_seq"), F.col("sample_idx").alias("onset"), ((F.col("sample_idx") - 1) / A.EVENT_RATE).alias("onset_time"),
        F.col("raw").cast("int").alias("type"), F.lit("").alias("description"),
    )


def _out(df: DataFrame) -> DataFrame:
    return df.select("recording_id", F.col("event_seq").cast("long").alias("event_seq"), F.col("onset").cast("long").alias("onset"), F.round("onset_time", 6).alias("onset_time"), F.col("type").cast("long").alias("type"))


_SEL = 'select recording_id, cast(event_seq as bigint) event_seq, cast(onset as bigint) onset, round(onset_time, 6) onset_time, cast("type" as bigint) "type" from '
_MASKED = RAW + ', masked as (select recording_id, event_seq, onset, onset_time, "type" & 65535 "type" from raw_events where ("type" & 65535) <> 0)'
_EXCL = _MASKED + ', excl as (select * from masked where "type" <> 255)'
_MERGED = _EXCL + ', m1 as (select *, lag("type") over (partition by recording_id order by event_seq) p from excl), merged as (select * from m1 where p is null or "type" <> p)'
_BRIEF = _MERGED + ", b1 as (select * exclude (p), lead(onset_time) over (partition by recording_id order by event_seq) nx from merged), brief as (select * from b1 where nx is null or nx - onset_time >= 0.02)"
_AUTO = _BRIEF + ", c1 as (select *, lag(onset_time) over (partition by recording_id order by event_seq) pv from brief), cleaned as (select * from c1 where pv is null or onset_time - pv >= 0.05)"


def _auto(spark, sf):
    return T.clean_triggers(_raw(spark, sf), "auto", trigger_threshold=0.02, min_iei=0.05, exclude=[255])


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(F.col(n), digits) + 0.0)
    return df


def trigger_table(spark, sf):
    return _round(T.trigger_table(_decoded(spark, sf)).withColumn("type", F.col("type").cast("long")), "first_time", "last_time")


def trigger_top(spark, sf):
    return T.top_types(_decoded(spark, sf), 2).select(F.col("type").cast("long").alias("type"), "n")


def validation_summary(spark, sf):
    out = T.validation_summary(_decoded(spark, sf)).withColumn("max_type", F.col("max_type").cast("long"))
    return _round(out, "mean_isi", "sd_isi", "min_isi", "max_isi", "cv_isi", digits=5)


_VALID = DECODED + """, g as (select *, (onset_time - lag(onset_time) over (partition by recording_id order by event_seq)) * 1000 isi from trg),
v as (select recording_id, count(*) n_events, count(distinct "type") n_types, max("type") max_type, avg(isi) mean_isi, stddev_samp(isi) sd_isi, min(isi) min_isi, max(isi) max_isi from g group by 1)"""


def dedupe(spark, sf):
    """Two status lines' events together, the second line one sample coarser, so onsets repeat."""
    one = _decoded(spark, sf)
    two = one.withColumn("onset", F.col("onset") - F.col("onset") % 4 + 1).withColumn("event_seq", F.col("event_seq") + 1_000_000)
    return _out(T.dedupe_onsets(one.unionByName(two)))


def label_apply(spark, sf):
    return _out(_decoded(spark, sf)).join(T.apply_trigger_labels(_decoded(spark, sf), LABELS).select("recording_id", "event_seq", "label"), ["recording_id", "event_seq"])


def interval_stats(spark, sf):
    return _round(T.interval_stats(_decoded(spark, sf)), "mean_iei", "median_iei", "rate_per_min", "suggested_tmax")


def overview(spark, sf):
    return _round(T.event_overview(_decoded(spark, sf)), "first_time", "last_time", "mean_interval", "rate_hz")


def import_table(spark, sf):
    """Of events before the last code's only, so that recordings without any are there too."""
    early = _decoded(spark, sf).where(F.col("onset_time") < 0.03)
    out = T.import_table(early, A.lengths(A.signal_from_events(spark, sf)), A.EVENT_RATE)
    return _round(out, "duration_sec", "first_time", "last_time", "mean_interval", "rate_hz")


def label_summary(spark, sf):
    return T.label_summary(_decoded(spark, sf)).withColumn("type", F.col("type").cast("long"))


def histogram(spark, sf):
    return T.time_histogram(_decoded(spark, sf), 0.25)


QUERIES = {
    "trigger_decode": (lambda s, d: _out(_decoded(s, d)), f"with {DECODED} {_SEL} trg"),
    "trigger_mask": (lambda s, d: _out(T.mask_triggers(_raw(s, d))), f"with {_MASKED} {_SEL} masked"),
    "trigger_raw": (lambda s, d: _out(T.clean_triggers(_raw(s, d), "raw")), f"with {_MASKED} {_SEL} masked"),
    "trigger_manual_exclude": (lambda s, d: _out(T.clean_triggers(_raw(s, d), "manual", exclude=[255])), f"with {_EXCL} {_SEL} excl"),
    "trigger_merge_runs": (lambda s, d: _out(T.merge_runs(T.exclude_types(T.mask_triggers(_raw(s, d)), [255]))), f"with {_MERGED} {_SEL} merged"),
    "trigger_auto_clean": (lambda s, d: _out(_auto(s, d)), f"with {_AUTO} {_SEL} cleaned"),
    "trigger_select": (lambda s, d: _out(T.select_types(_decoded(s, d), [1, 2])), f'with {DECODED} {_SEL} trg where "type" in (1, 2)'),
    "trigger_table": (
        trigger_table,
        f'with {DECODED} select "type", count(*) n, round_even(count(*) * 100.0 / sum(count(*)) over (), 1) percentage, round(min(onset_time), 6) + 0.0 first_time, round(max(onset_time), 6) + 0.0 last_time from trg group by 1',
    ),
    "trigger_top": (trigger_top, f'with {DECODED} select "type", count(*) n from trg group by 1 order by 2 desc, 1 limit 2'),
    "trigger_iei_stats": (
        interval_stats,
        f"""with {DECODED}, g as (select *, onset_time - lag(onset_time) over (partition by recording_id order by event_seq) gap from trg),
        a as (select recording_id, count(*) n_events, avg(gap) m, median(gap) md, max(onset_time) l from g group by 1)
        select recording_id, n_events, round(m, 6) + 0.0 mean_iei, round(md, 6) + 0.0 median_iei, round(case when n_events > 1 and l > 0 then n_events / l * 60 end, 6) + 0.0 rate_per_min,
        round(case when m > 1.0 then least(0.8, m * 0.6) when m > 0.5 then 0.5 else 0.3 end, 6) + 0.0 suggested_tmax from a""",
    ),
    "event_overview": (
        overview,
        f"""with {DECODED}, g as (select *, onset_time - lag(onset_time) over (partition by recording_id order by event_seq) gap from trg)
        select recording_id, count(*) n_events, round(min(onset_time), 6) + 0.0 first_time, round(max(onset_time), 6) + 0.0 last_time, round(avg(gap), 6) + 0.0 mean_interval,
        round(case when avg(gap) > 0 then 1 / avg(gap) end, 6) + 0.0 rate_hz from g group by 1""",
    ),
    "event_import": (
        import_table,
        f"""with {DECODED}, early as (select * from trg where onset_time < 0.03), b as (select recording_id, count(*) c, list_sort(list(distinct "type")) codes, min(onset_time) first_time, max(onset_time) last_time from early group by 1),
        g as (select *, case when c > 1 then (last_time - first_time) / (c - 1) end gap from len left join b using (recording_id))
        select recording_id, 64.0::double sampling_rate, n n_samples, round((n - 1) / 64.0, 6) + 0.0 duration_sec, coalesce(c, 0) n_events, coalesce(len(codes), 0) n_types,
        case when len(codes) <= 10 then array_to_string(codes, ', ') when codes is not null then concat(codes[1], ' to ', codes[-1]) end as types, round(first_time, 6) + 0.0 first_time, round(last_time, 6) + 0.0 last_time,
        round(gap, 6) + 0.0 mean_interval, round(case when gap > 0 then 1 / gap end, 6) + 0.0 rate_hz, case when c is null then 'no events' end note from g""",
    ),
    "event_counts": (
        lambda s, d: _decoded(s, d).groupBy("recording_id", F.col("type").cast("long").alias("type")).agg(F.count("*").alias("n"), F.min("onset").alias("first_onset")),
        f'with {DECODED} select recording_id, "type", count(*) n, min(onset) first_onset from trg group by 1, 2',
    ),
    "event_validate_summary": (
        validation_summary,
        f"""with {_VALID} select recording_id, n_events, n_types, max_type, round(mean_isi, 5) + 0.0 mean_isi, round(sd_isi, 5) + 0.0 sd_isi, round(min_isi, 5) + 0.0 min_isi, round(max_isi, 5) + 0.0 max_isi,
        round(case when mean_isi > 0 then sd_isi / mean_isi end, 5) + 0.0 cv_isi from v""",
    ),
    "event_validate_issues": (
        lambda s, d: T.validation_issues(_decoded(s, d)),
        f"""with {_VALID}, pt as (select recording_id, max(n) / min(n) imb from (select recording_id, "type", count(*) n from trg group by 1, 2) group by 1), j as (select * from v join pt using (recording_id))
        select recording_id, 'very_few_events' issue from j where n_events < 10 union all select recording_id, 'imbalanced_conditions' from j where imb > 5
        union all select recording_id, 'double_triggers' from j where min_isi < 50 union all select recording_id, 'irregular_timing' from j where mean_isi > 0 and sd_isi / mean_isi > 0.5
        union all select recording_id, 'unusual_trigger_values' from j where max_type > 255""",
    ),
    "event_label_apply": (
        label_apply,
        f"""with {DECODED} select recording_id, event_seq, onset, round(onset_time, 6) onset_time, "type", case "type" when 1 then 'standard' when 2 then 'target' when 255 then 'response' else 'unknown' end as label from trg""",
    ),
    "event_label_summary": (label_summary, f'with {DECODED} select "type", count(*) n, round(min(onset_time), 3) first_time, round(max(onset_time), 3) last_time from trg group by 1'),
    "event_dedupe_first": (
        dedupe,
        f"""with {DECODED}, u as (select * from trg union all select recording_id, event_seq + 1000000, onset - onset % 4 + 1, onset_time, "type" from trg),
        r as (select *, row_number() over (partition by recording_id, onset order by event_seq) k from u) {_SEL} r where k = 1""",
    ),
    "event_histogram": (histogram, f"with {DECODED} select cast(floor(onset_time / 0.25) as bigint) bin, count(*) n, floor(onset_time / 0.25) * 0.25 start_time from trg group by 1, 3"),
}
