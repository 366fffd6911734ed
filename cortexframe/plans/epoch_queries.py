"""Queries on epochs, averages and the data behind plots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import epochs as E
from ..operators import erp, views
from ..sources import adapters as A
from .channel_queries import NUDGE, _r
from .event_queries import _decoded
from .tables_sql import DECODED, EMB

GEO = E.Geometry(A.EVENT_RATE, -0.05, 0.2)
FIRST, LAST = GEO.first, GEO.last
BASE = GEO.span((-0.05, 0.0))
LOOK = GEO.span((0.0, 0.1))
HIGH, FLAT = 150.0, 60.0


def _epochs(spark, sf, **options):
    options = {"baseline_window": None} | options
    signal = A.signal_from_events(spark, sf)
    return E.epoch_recording(signal, _decoded(spark, sf), A.lengths(signal), GEO, **options)


def _data(**options):
    return lambda s, d: _r(_epochs(s, d, **options).data.select("recording_id", "epoch_id", F.col("type").cast("long").alias("type"), "onset", "rel_idx", "t", "value"), "t", "value", nudge=NUDGE)


def _log(**options):
    def run(spark, sf):
        log = _epochs(spark, sf, **options).log
        return _r(log.select("recording_id", "epoch_id", F.col("event_type").cast("long").alias("event_type"), "event_time", "channel", "code"), "event_time")

    return run


def _metadata(spark, sf):
    out = _epochs(spark, sf, preload=False).events
    return out.select("recording_id", "epoch_id", "candidate_id", "onset", F.col("type").cast("long").alias("type"))


def _evoked(by="event_type", method="mean", **options):
    def run(spark, sf):
        out = erp.average_epochs(_epochs(spark, sf, **options).data, by, method)
        return _r(out.select("recording_id", "condition", "rel_idx", "value", "se", "n_trials"), "value", "se", nudge=NUDGE)

    return run


def _emb_evoked(by="event_type", method="mean"):
    return lambda s, d: _r(erp.average_epochs(A.epochs_from_embeddings(s, d), by, method).select("condition", "rel_idx", "value", "se", "n_trials"), "value", "se", digits=6)


def _band(spark, sf):
    out = erp.confidence_band(erp.average_epochs(A.epochs_from_embeddings(spark, sf)))
    return _r(out.select("condition", "rel_idx", "low", "high"), "low", "high", digits=6)


def _signal_view(spark, sf):
    cut, _ = views.signal_view(A.signal_from_events(spark, sf), _decoded(spark, sf), "Cz", 100.0, 700.0)
    return _r(cut.select("recording_id", "sample_idx", "value"), "value", nudge=NUDGE)


def _signal_events(spark, sf):
    _, events = views.signal_view(A.signal_from_events(spark, sf), _decoded(spark, sf), "Cz", 100.0, 700.0)
    return events.groupBy("recording_id").agg(F.count("*").alias("n_events"))


def _sampled(spark, sf):
    return views.sampled_trials(A.epochs_from_embeddings(spark, sf), 50, 3).select("epoch_id").distinct()


_CAND = f"""{DECODED}, cand as (select trg.*, n, row_number() over (partition by trg.recording_id order by event_seq) epoch_id, onset + {FIRST} >= 1 and onset + {LAST} <= n inside from trg join len using (recording_id)),
ep as (select c.recording_id, c.epoch_id, c."type", c.onset, s.sample_idx - c.onset - {FIRST} rel_idx, {GEO.tmin} + (s.sample_idx - c.onset - {FIRST}) * {GEO.step!r} t, s.value
  from cand c join sig s on s.recording_id = c.recording_id and s.sample_idx between c.onset + {FIRST} and c.onset + {LAST} where c.inside)"""
_W = "over (partition by recording_id, epoch_id)"
_IN = f"case when rel_idx between {BASE[0]} and {BASE[1]} then value end"
_D1 = f"value - (regr_slope(value, rel_idx) {_W} * rel_idx + regr_intercept(value, rel_idx) {_W})"
_BASED = f"{_CAND}, bl as (select * replace (value - avg({_IN}) {_W} as value) from ep)"


def _ids(source: str) -> str:
    """Numbers of accepted trials."""
    return f"ids as (select recording_id, epoch_id, row_number() over (partition by recording_id order by epoch_id) new_id from (select distinct recording_id, epoch_id from {source}))"


def _select(source: str) -> str:
    return f'select recording_id, new_id epoch_id, cast("type" as bigint) "type", cast(onset as bigint) onset, cast(rel_idx as integer) rel_idx, round(t + {NUDGE}, 4) + 0.0 t, round(value + {NUDGE}, 4) + 0.0 as value from {source} join ids using (recording_id, epoch_id)'


def _plain(expression: str) -> str:
    return f"with {_CAND}, x as (select * replace ({expression} as value) from ep), {_ids('x')} {_select('x')}"


def _rejected(condition: str, span: tuple[int, int] = (0, GEO.size - 1)) -> str:
    return f"{_BASED}, pp as (select recording_id, epoch_id, max(value) - min(value) p2p from bl where rel_idx between {span[0]} and {span[1]} group by 1, 2), bad as (select * from pp where {condition}), ok as (select bl.* from bl anti join bad using (recording_id, epoch_id))"


def _log_sql(code: str, condition: str) -> str:
    return f"""with {_rejected(condition)} select recording_id, epoch_id, "type" event_type, round(onset_time, 4) + 0.0 event_time, cast(null as varchar) channel, 'boundary' code from cand where not inside
    union all select c.recording_id, c.epoch_id, c."type", round(c.onset_time, 4) + 0.0, 'Cz', {code} from bad b join cand c using (recording_id, epoch_id)"""


_BL = {"baseline_window": (-0.05, 0.0)}
_EV = 'group by 1, 2, 3'

QUERIES = {
    "epoch_extract": (_data(), _plain("value")),
    "epoch_detrend0": (_data(detrend_order=0), _plain(f"value - avg(value) {_W}")),
    "epoch_detrend1": (_data(detrend_order=1), _plain(_D1)),
    "epoch_baseline_mean": (_data(**_BL), _plain(f"value - avg({_IN}) {_W}")),
    "epoch_baseline_median": (_data(**_BL, baseline_method="median"), _plain(f"value - median({_IN}) {_W}")),
    "epoch_reject_p2p": (_data(**_BL, reject_threshold=HIGH), f"with {_rejected(f'p2p > {HIGH}')}, {_ids('ok')} {_select('ok')}"),
    "epoch_flat": (_data(**_BL, flat_threshold=FLAT), f"with {_rejected(f'p2p < {FLAT}')}, {_ids('ok')} {_select('ok')}"),
    "epoch_reject_window": (_data(**_BL, reject_threshold=HIGH, reject_window=(0.0, 0.1)), f"with {_rejected(f'p2p > {HIGH}', LOOK)}, {_ids('ok')} {_select('ok')}"),
    "epoch_select_types": (_data(types=[2]), f'with {_CAND.replace("from trg join len", "from (select * from trg where " + chr(34) + "type" + chr(34) + " = 2) trg join len")}, {_ids("ep")} {_select("ep")}'),
    "epoch_boundary_log": (_log(), f"""with {_CAND} select recording_id, epoch_id, "type" event_type, round(onset_time, 4) + 0.0 event_time, cast(null as varchar) channel, 'boundary' code from cand where not inside"""),
    "epoch_rejection_log": (_log(**_BL, reject_threshold=HIGH, flat_threshold=FLAT), _log_sql(f"case when p2p > {HIGH} then 'amplitude' else 'flat' end", f"p2p > {HIGH} or p2p < {FLAT}")),
    "epoch_preload_false": (_metadata, f'with {_CAND} select recording_id, row_number() over (partition by recording_id order by event_seq) epoch_id, epoch_id candidate_id, cast(onset as bigint) onset, "type" from cand where inside'),
    "erp_mean_trigger": (_evoked(**_BL), f'with {_BASED} select recording_id, cast("type" as varchar) condition, cast(rel_idx as integer) rel_idx, round(avg(value) + {NUDGE}, 4) + 0.0 as value, round(stddev_samp(value) / sqrt(count(value)) + {NUDGE}, 4) + 0.0 se, count(distinct epoch_id) n_trials from bl {_EV}'),
    "erp_mean": (_emb_evoked(), f'with {EMB} select cast("type" as varchar) condition, cast(rel_idx as integer) rel_idx, round(avg(value), 6) + 0.0 as value, round(stddev_samp(value) / sqrt(count(value)), 6) + 0.0 se, count(distinct epoch_id) n_trials from emb group by 1, 2'),
    "erp_median": (_emb_evoked(method="median"), f'with {EMB} select cast("type" as varchar) condition, cast(rel_idx as integer) rel_idx, round(median(value), 6) + 0.0 as value, round(stddev_samp(value) / sqrt(count(value)), 6) + 0.0 se, count(distinct epoch_id) n_trials from emb group by 1, 2'),
    "erp_all": (_emb_evoked("all"), f"with {EMB} select 'all' condition, cast(rel_idx as integer) rel_idx, round(avg(value), 6) + 0.0 as value, round(stddev_samp(value) / sqrt(count(value)), 6) + 0.0 se, count(distinct epoch_id) n_trials from emb group by 1, 2"),
    "erp_ci95": (_band, f'with {EMB}, a as (select "type", rel_idx, avg(value) m, stddev_samp(value) / sqrt(count(value)) se from emb group by 1, 2) select cast("type" as varchar) condition, cast(rel_idx as integer) rel_idx, round(m - 1.96 * se, 6) + 0.0 low, round(m + 1.96 * se, 6) + 0.0 high from a'),
    "view_butterfly": (lambda s, d: _r(views.butterfly(A.epochs_from_embeddings(s, d)).select("channel", "rel_idx", "value"), "value", digits=6), f"with {EMB} select 'emb' channel, cast(rel_idx as integer) rel_idx, round(avg(value), 6) + 0.0 as value from emb group by 2"),
    "view_trial_image": (lambda s, d: _r(views.trial_image(A.epochs_from_embeddings(s, d)).select("epoch_id", "rel_idx", "value"), "value", digits=6), f"with {EMB} select epoch_id, cast(rel_idx as integer) rel_idx, round(value, 6) + 0.0 as value from emb"),
    "view_signal": (
        _signal_view,
        f"""with {DECODED}, e as (select recording_id, first(sample_idx order by abs(t * 1000 - 100.0), sample_idx) a, first(sample_idx order by abs(t * 1000 - 700.0), sample_idx) b from sig group by 1)
        select recording_id, sample_idx, round(value - avg(value) over (partition by recording_id) + {NUDGE}, 4) + 0.0 as value from sig join e using (recording_id) where sample_idx between a and b""",
    ),
    "view_signal_events": (_signal_events, f"with {DECODED} select recording_id, count(*) n_events from trg where onset_time between 0.1 and 0.7 group by 1"),
    "view_sampled_trials": (_sampled, "select vec_id epoch_id from embeddings order by md5(concat(cast(vec_id as varchar), ':3')), vec_id limit 50"),
}
