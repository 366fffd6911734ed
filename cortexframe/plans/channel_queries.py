"""Queries on channels, electrodes, quality, references and sampling, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import butter_lowpass, edge_length
from ..operators import channels as C
from ..operators import describe
from ..operators import quality as Q
from ..operators import reference as R
from ..operators import resample as D
from ..operators import triggers as T
from ..sources import adapters as A
from .event_queries import _decoded
from .tables_sql import DECODED, SIG_E, SIG_L, values


#: moves values with few decimals off the halves that two engines may round apart
NUDGE = 3.7e-6


def _r(df, *names, digits=4, nudge=0.0):
    for n in names:
        df = df.withColumn(n, F.round(F.col(n) + nudge if nudge else F.col(n), digits) + 0.0)
    return df


_L = A.signal_from_lineitem
_ROWS = C.electrode_rows()
_ELEC = values([tuple(None if v is None else v for v in r) for r in _ROWS], "elec", "standard_name, biosemi_name, position_name, position_type, region, standard_system, x, y, z, theta, phi, radius")
#: names for the customers' "channels": standard, amplifier and accessory names and some unknown ones
_NAMES = [r[0] for r in _ROWS] + [r[1] for r in _ROWS if r[1]] + ["cz", " EXG1 ", "EOG (EXG2)", "Unknown1", "status"]


def customer_channels(spark, sf):
    """A nation is a recording whose channels are its customers, named in turn."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    c = A.table(spark, sf, "customer")
    return c.select(F.col("c_nationkey").cast("string").alias("recording_id"), "c_custkey", names[(F.col("c_custkey") % len(_NAMES)).cast("int")].alias("channel"))


_CUST = _ELEC + ", " + values([(i, n) for i, n in enumerate(_NAMES)], "names", "k, channel") + f""", cust as (
  select cast(c_nationkey as varchar) recording_id, c_custkey, channel from customer join names on k = c_custkey % {len(_NAMES)}),
keys as (select lower(standard_name) kk, * from elec union all select lower(biosemi_name), * from elec where biosemi_name is not null),
found as (select cust.*, elec.* exclude (kk) from cust left join keys elec on kk = lower(trim(channel)))"""
_EXTERNAL = "('External', 'GSR', 'Ergo/AUX', 'Respiration', 'Plethysmograph', 'Temperature')"
_PORT = r"'(?i)\((EXG[1-8]|GSR[1-2]|Plet|Temp|Resp|Erg[1-2])\)'"
_TYPE = f"case when lower(trim(channel)) = 'status' then 'status' when position_type in {_EXTERNAL} or regexp_matches(trim(channel), {_PORT}) then 'external' else 'eeg' end"


def _flat_electrodes(spark, sf):
    found = C.lookup_electrodes(customer_channels(spark, sf))
    return found.select("c_custkey", "channel", "standard_name", "position_type", "region", "standard_system", "x", "y", "z", "theta", "phi", "radius")


def _classified(spark, sf):
    return C.classify_channels(customer_channels(spark, sf))


def _naming(spark, sf):
    return _r(C.naming_system(customer_channels(spark, sf)), "confidence")


def _renamed(spark, sf):
    return C.rename_channels(_L(spark, sf), {"EXG1": "HEOG"}).groupBy("channel").agg(F.count("*").alias("n"))


def _montage(spark, sf):
    return C.create_montage(customer_channels(spark, sf))


def _set_montage(spark, sf):
    typed = C.classify_channels(customer_channels(spark, sf))
    return C.set_montage(typed, C.create_montage(typed)).select("c_custkey", "channel", "x", "y", "z")


def _projected(spark, sf):
    return _r(C.project_2d(_montage(spark, sf)).select("channel", "x2d", "y2d"), "x2d", "y2d", digits=6)


def _spherical(spark, sf):
    """Parts as points on the head: size and key as angles."""
    p = A.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7 % 181 - 90).cast("double").alias("theta"), (F.col("p_partkey") % 181 - 90).cast("double").alias("phi"))
    return C.spherical_to_cartesian(p)


def _stats(spark, sf):
    return _r(Q.channel_stats(_L(spark, sf), None), "min", "max", "mean", "sd")


def _flags(spark, sf):
    return Q.channel_flags(_L(spark, sf), flat=0.05, amplitude=1000.0, outlier=3.0)


def _overview(spark, sf):
    typed = C.classify_channels(A.channels_from_lineitem(spark, sf))
    return _r(Q.recording_overview(_L(spark, sf), typed, A.LINE_RATE), "min", "max", "mean", "sd", "duration_sec")


def _reref(ref, **more):
    return lambda s, d: _r(R.rereference(_L(s, d), ref, **more).select("recording_id", "channel", "sample_idx", "value"), "value")


def _simple(spark, sf):
    return _r(D.keep_every(_L(spark, sf), 4, A.LINE_RATE).select("recording_id", "channel", "sample_idx", "t", "value"), "t", "value")


def _remap(strategy, remove=True):
    def run(spark, sf):
        events = _decoded(spark, sf)
        lengths = A.lengths(A.signal_from_events(spark, sf)).select("recording_id", (F.floor((F.col("n_samples") - 1) / 4) + 1).alias("n_samples"))
        out = D.remap_events(events, 4, A.EVENT_RATE, lengths, strategy, remove)
        return _r(out.select("recording_id", F.col("event_seq").cast("long").alias("event_seq"), F.col("onset").cast("long").alias("onset"), "onset_time"), "onset_time")

    return run


def _remap_sql(expression: str, remove: bool = True) -> str:
    onset = expression if remove else f"greatest(1, least({expression}, nn))"
    return f"""with {DECODED}, l4 as (select recording_id, (n - 1) // 4 + 1 nn from len), r as (select trg.recording_id, event_seq, cast({onset} as bigint) onset, nn from trg join l4 using (recording_id))
    select recording_id, event_seq, onset, round((onset - 1) / 16.0, 4) + 0.0 onset_time from r {"where onset between 1 and nn" if remove else ""}"""


def _decimate_sql(factor: int = 4) -> str:
    """The sections' recursions, sample by sample, forward and then backward over signals with reflected ends."""
    design = butter_lowpass(8, 0.9 / factor)
    pad = edge_length(len(design))
    states = [f"z{j}{k}" for j in range(len(design)) for k in (1, 2)]

    def start(x: str) -> str:  # the steady state of the first value, as every section's gain is 1
        return ", ".join(f"{(float(b[1] - a[1]) + float(b[2] - a[2]))!r} * {x} z{j}1, {float(b[2] - a[2])!r} * {x} z{j}2" for j, (b, a) in enumerate(design))

    def step(rows: str) -> str:
        """``rows`` with ``y0``, the input, and all states; each section's output is the next one's input."""
        for j, (b, a) in enumerate(design):
            rows = f"select *, {float(b[0])!r} * y{j} + z{j}1 y{j + 1} from ({rows})"
        new = [f"{float(b[1])!r} * y{j} - {float(a[1])!r} * y{j + 1} + z{j}2, {float(b[2])!r} * y{j} - {float(a[2])!r} * y{j + 1}" for j, (b, a) in enumerate(design)]
        return f"select recording_id, i, y{len(design)}, {', '.join(new)} from ({rows})"

    def way(name: str, source: str) -> str:
        first = step(f"select recording_id, i, v y0, {start('v')} from {source} where i = 1")
        then = step(f"select s.recording_id, s.i, v y0, {', '.join(states)} from {name} join {source} s on s.recording_id = {name}.recording_id and s.i = {name}.i + 1")
        return f"{name}(recording_id, i, y, {', '.join(states)}) as ({first} union all {then})"

    return f"""with recursive {SIG_E}, e as (select recording_id, n, least(n - 1, {pad}) pad, max(value) filter (sample_idx = 1) a, max(value) filter (sample_idx = n) z from sig join len using (recording_id) group by 1, 2),
    p as (select recording_id, sample_idx + pad i, value v from sig join e using (recording_id) union all select recording_id, pad + 2 - sample_idx, 2 * a - value from sig join e using (recording_id) where sample_idx between 2 and pad + 1
      union all select recording_id, pad + 2 * n - sample_idx, 2 * z - value from sig join e using (recording_id) where sample_idx between n - pad and n - 1),
    {way("f", "p")}, r as (select f.recording_id, n + 2 * pad + 1 - i i, y v from f join e using (recording_id)), {way("g", "r")},
    d as (select g.recording_id, n + pad + 1 - i s, y from g join e using (recording_id) where n + pad + 1 - i between 1 and n)
    select recording_id, cast(1 as integer) ch_idx, 'Cz' channel, (s - 1) // {factor} + 1 sample_idx, ((s - 1) // {factor}) / ({A.EVENT_RATE} / {factor}) t, round(y, 4) + 0.0 as value from d where (s - 1) % {factor} = 0"""


def _slice(spark, sf):
    cut = Q.demean(Q.time_slice(_L(spark, sf), 101.0, 345.0))
    return _r(cut.select("recording_id", "channel", "sample_idx", "value"), "value")


def _bad(spark, sf):
    """Discounts as logarithms: a discount of 0 is a channel's missing or infinite value."""
    s = _L(spark, sf).withColumn("value", F.when(F.col("channel") == "Oz", F.lit(1.0) / F.when(F.col("value") == 0, F.lit(None)).otherwise(F.col("value"))).otherwise(F.col("value")))
    return Q.bad_channels(s).select("recording_id", "channel", "bad")


def _physical(spark, sf):
    from ..functions.bdf_format import digital_to_physical

    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_extendedprice") * 80 - 8388608).cast("long").alias("digital"))
    out = li.withColumn("value", digital_to_physical(F.col("digital"), -8388608, -262144.0, 262144.0))
    return _r(out.select("l_orderkey", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "digital", "value"), "value", digits=6)


def _unpack(spark, sf):
    from ..functions.bdf_format import int24

    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), (F.col("l_extendedprice") * 150).cast("long").alias("v"))
    low, mid, high = (F.col("v") % 256, F.shiftright("v", 8) % 256, F.shiftright("v", 16) % 256)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "day", int24(low, mid, high).cast("long").alias("value"))


_REGION_SQL = """case when regexp_matches(channel, '^(T[0-9]|FT|TP)') then 'Temporal' when regexp_matches(channel, '^(O|PO|Iz)') then 'Occipital' when regexp_matches(channel, '^(P[^O]|CP)') then 'Parietal' when regexp_matches(channel, '^(C|FC)') then 'Central' when regexp_matches(channel, '^(Fp|AF|F[^CT])') then 'Frontal' else 'Other' end"""
_STATS = "min(value) mn, max(value) mx, avg(value) av, stddev_samp(value) sd"
_ALL_REF = "avg(value) over (partition by recording_id, sample_idx)"


def _reref_sql(mean: str, change: str = "value - m", where: str = "true") -> str:
    return f"with {SIG_L}, a as (select *, {mean} m from sig) select recording_id, channel, sample_idx, round({change}, 4) + 0.0 as value from a where {where}"


QUERIES = {
    "channel_pick": (
        lambda s, d: C.pick_channels(_L(s, d), ["Oz", "Pz"]).groupBy("recording_id", "channel").agg(F.count("*").alias("n")),
        f"with {SIG_L} select recording_id, channel, count(*) n from sig where channel in ('Oz', 'Pz') group by 1, 2",
    ),
    "montage_overview": (
        lambda s, d: describe.describe_montage(_montage(s, d)),
        f"with {_CUST}, m as (select distinct channel, x, y, z from found where x is not null) select count(*) n_channels, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z from m",
    ),
    "channel_stats": (_stats, f"with {SIG_L} select recording_id, ch_idx, channel, round(min(value), 4) + 0.0 min, round(max(value), 4) + 0.0 max, round(avg(value), 4) + 0.0 mean, round(stddev_samp(value), 4) + 0.0 sd from sig group by 1, 2, 3"),
    "channel_pooled_sd": (lambda s, d: _r(Q.pooled_sd(_L(s, d)), "pooled_sd"), f"with {SIG_L} select recording_id, round(stddev_samp(value), 4) + 0.0 pooled_sd from sig group by 1"),
    "channel_flags": (
        _flags,
        f"""with {SIG_L}, a as (select recording_id, ch_idx, channel, {_STATS} from sig group by 1, 2, 3),
        s as (select recording_id, ch_idx, channel, round_even(mn, 2) mn, round_even(mx, 2) mx, round_even(sd, 2) sd from a), md as (select recording_id, median(sd) m from s group by 1), j as (select * from s join md using (recording_id))
        select recording_id, ch_idx, channel, 'flat' flag from j where sd < 0.05 union all select recording_id, ch_idx, channel, 'excessive_amplitude' from j where greatest(abs(mn), abs(mx)) > 1000
        union all select recording_id, ch_idx, channel, 'outlier_variance' from j where sd > 3 * m""",
    ),
    "recording_overview": (
        _overview,
        f"""with {SIG_L}, e as (select recording_id, max(sample_idx) n_samples, {_STATS} from sig where channel <> 'EXG1' group by 1)
        select recording_id, 4 n_channels, 3 n_eeg, 1 n_external, 0 n_status, n_samples, round(mn, 4) + 0.0 min, round(mx, 4) + 0.0 max, round(av, 4) + 0.0 mean, round(sd, 4) + 0.0 sd, round(n_samples / 256.0, 4) + 0.0 duration_sec from e""".replace("4 n_channels, 3 n_eeg, 1 n_external, 0 n_status", "cast(4 as bigint) n_channels, cast(3 as bigint) n_eeg, cast(1 as bigint) n_external, cast(0 as bigint) n_status"),
    ),
    "electrode_lookup": (
        _flat_electrodes,
        f"with {_CUST} select c_custkey, channel, standard_name, coalesce(position_type, 'Unknown') position_type, coalesce(region, 'Unknown') region, coalesce(standard_system, 'Unknown') standard_system, x, y, z, theta, phi, radius from found",
    ),
    "electrode_inspect": (
        lambda s, d: C.inspect_channels(customer_channels(s, d)).drop("names"),
        f"with {_CUST} select coalesce(position_type, 'Unknown') position_type, coalesce(region, 'Unknown') region, coalesce(standard_system, 'Unknown') standard_system, count(*) n from found group by 1, 2, 3",
    ),
    "header_report": (
        lambda s, d: C.channel_report(C.lookup_electrodes(customer_channels(s, d)), "c_custkey"),
        f"""with {_CUST}, k as (select recording_id, c_custkey, channel, coalesce(position_type, 'Unknown') position_type, coalesce(region, 'Unknown') region, coalesce(standard_system, 'Unknown') standard_system from found),
        s as (select *, 'region' section, region item from k union all select *, 'position_type', position_type from k union all select *, 'total', 'all' from k)
        select recording_id, section, item, count(*) n, count(*) filter (region in {C.SCALP_REGIONS}) n_eeg, count(*) filter (region = 'External') n_external, count(*) filter (region = 'Reference') n_reference,
        count(*) filter (standard_system = 'Status') n_status, string_agg(channel, ', ' order by c_custkey, channel) as names from s group by 1, 2, 3""",
    ),
    "channel_classify": (_classified, f"with {_CUST} select recording_id, c_custkey, channel, {_TYPE} channel_type from found"),
    "external_detect": (lambda s, d: C.external_channels(customer_channels(s, d)), f"with {_CUST} select recording_id, c_custkey, channel, channel_type from (select *, {_TYPE} channel_type from found) where channel_type = 'external'"),
    "external_rename": (_renamed, f"with {SIG_L} select case channel when 'EXG1' then 'HEOG (EXG1)' else channel end as channel, count(*) n from sig group by 1"),
    "naming_system": (
        _naming,
        f"""with {_CUST}, f as (select recording_id, standard_system in ('10-20', '10-10') scalp, regexp_full_match(trim(channel), '(?i)[ab][0-9]+') amp, coalesce(standard_system = 'BioSemi', false) or regexp_matches(trim(channel), {_PORT}) ext from found),
        c as (select recording_id, count(*) n_channels, sum((coalesce(scalp, false) and not amp)::bigint)::bigint n_standard, sum((coalesce(scalp, false) and amp)::bigint)::bigint n_biosemi, sum((ext and not coalesce(scalp, false))::bigint)::bigint n_external,
          sum((not coalesce(scalp, false) and not ext)::bigint)::bigint n_unknown from f group by 1),
        k as (select *, greatest(1, n_channels - n_external) rest, case when n_standard > 0 and n_biosemi = 0 and n_unknown = 0 then '10-20/10-10' when n_biosemi > 0 and n_standard = 0 and n_unknown = 0 then 'BioSemi_AB' when n_standard > 0 and n_biosemi > 0 then 'Mixed' else 'Unknown' end naming_system from c)
        select recording_id, n_channels, n_standard, n_biosemi, n_external, n_unknown, naming_system, round((case naming_system when '10-20/10-10' then n_standard when 'BioSemi_AB' then n_biosemi when 'Mixed' then greatest(n_standard, n_biosemi) else case when n_unknown > 0 then rest - n_unknown else 0 end end) / rest, 4) + 0.0 confidence from k""",
    ),
    "naming_details": (
        lambda s, d: C.naming_details(customer_channels(s, d)),
        f"""with {_CUST} select recording_id, c_custkey, channel, case when standard_system in ('10-20', '10-10') and regexp_full_match(trim(channel), '(?i)[ab][0-9]+') then 'BioSemi_AB' when standard_system in ('10-20', '10-10') then 'Standard_10-20/10-10'
        when standard_system = 'BioSemi' then 'External' else 'Unknown' end system_category, case when standard_system in ('10-20', '10-10') then standard_name end standard_equivalent from found""",
    ),
    "montage_create": (_montage, f"with {_CUST} select distinct channel, x, y, z, theta, phi, radius from found where x is not null"),
    "montage_set_overlap": (_set_montage, f"with {_CUST} select c_custkey, channel, x, y, z from found where x is not null and {_TYPE} = 'eeg'"),
    "topo_project_2d": (
        _projected,
        f"with {_CUST}, m as (select distinct channel, x, y, z from found where x is not null) select channel, round(acos(z / sqrt(x * x + y * y + z * z)) * cos(atan2(y, x)), 6) + 0.0 x2d, round(acos(z / sqrt(x * x + y * y + z * z)) * sin(atan2(y, x)), 6) + 0.0 y2d from m",
    ),
    "electrode_spherical_to_cartesian": (
        _spherical,
        """with p as (select p_partkey, cast(p_size * 7 % 181 - 90 as double) theta, cast(p_partkey % 181 - 90 as double) phi from part)
        select p_partkey, theta, phi, round_even(87.54 * sin(radians(theta)) * cos(radians(phi)), 0) + 0.0 x, round_even(87.54 * sin(radians(theta)) * sin(radians(phi)), 0) + 0.0 y, round_even(87.54 * cos(radians(theta)), 0) + 0.0 z from p""",
    ),
    "electrode_region_regex": (
        lambda s, d: customer_channels(s, d).select("c_custkey", "channel", C.region_of(F.col("channel")).alias("region")),
        f"with {_CUST} select c_custkey, channel, {_REGION_SQL} region from cust",
    ),
    "reref_average": (_reref("average"), _reref_sql(_ALL_REF)),
    "reref_single": (_reref("Cz"), _reref_sql("avg(case when channel = 'Cz' then value end) over (partition by recording_id, sample_idx)")),
    "reref_linked": (_reref(["Pz", "Oz"]), _reref_sql("avg(case when channel in ('Pz', 'Oz') then value end) over (partition by recording_id, sample_idx)")),
    "reref_exclude": (_reref("average", exclude=["EXG1"]), _reref_sql("avg(case when channel <> 'EXG1' then value end) over (partition by recording_id, sample_idx)", "case when channel = 'EXG1' then value else value - m end")),
    "reref_drop": (_reref("Oz", drop_ref=True), _reref_sql("avg(case when channel = 'Oz' then value end) over (partition by recording_id, sample_idx)", where="channel <> 'Oz'")),
    "downsample_simple": (_simple, f"with {SIG_L} select recording_id, channel, (sample_idx - 1) // 4 + 1 sample_idx, round(((sample_idx - 1) // 4) / 64.0, 4) + 0.0 t, round(value, 4) + 0.0 as value from sig where (sample_idx - 1) % 4 = 0"),
    "downsample_events_round": (_remap("round"), _remap_sql("round_even(onset / 4.0, 0)")),
    "downsample_events_nearest": (_remap("nearest"), _remap_sql("round_even(onset / 4.0, 0)")),
    "downsample_events_floor": (_remap("floor"), _remap_sql("floor(onset / 4.0)")),
    "downsample_events_ceiling": (_remap("ceiling"), _remap_sql("ceil(onset / 4.0)")),
    "downsample_events_clamp": (_remap("floor", False), _remap_sql("floor(onset / 4.0)", False)),
    "downsample_decimate": (lambda s, d: _r(D.decimate(A.signal_from_events(s, d), 4, A.EVENT_RATE), "value"), _decimate_sql()),
    "signal_window_slice": (
        _slice,
        f"""with {SIG_L}, g as (select distinct recording_id, sample_idx, (sample_idx - 1) / 256.0 t from li),
        e as (select recording_id, first(sample_idx order by abs(t * 1000 - 101.0), sample_idx) a, first(sample_idx order by abs(t * 1000 - 345.0), sample_idx) b from g group by 1),
        c as (select sig.* from sig join e using (recording_id) where sample_idx between a and b)
        select recording_id, channel, sample_idx, round(value - avg(value) over (partition by recording_id, ch_idx), 4) + 0.0 as value from c""",
    ),
    "bad_channels": (_bad, f"with {SIG_L} select recording_id, channel, bool_or(channel = 'Oz' and value = 0) bad from sig group by 1, 2"),
    "bdf_digital_to_physical": (
        _physical,
        """select l_orderkey, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') as day, cast(trunc(l_extendedprice * 80 - 8388608) as bigint) digital,
        round(524288.0 / 16777216 * cast(trunc(l_extendedprice * 80 - 8388608) as bigint) + (-262144.0 + 524288.0 / 16777216 * 8388608), 6) + 0.0 as value from lineitem""",
    ),
    "bdf_int24_unpack": (
        _unpack,
        """with v as (select l_orderkey, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') as day, cast(trunc(l_extendedprice * 150) as bigint) & 16777215 u from lineitem)
        select l_orderkey, l_partkey, l_suppkey, day, case when u >= 8388608 then u - 16777216 else u end as value from v""",
    ),
}
