"""Queries on spectra, filters, components and maps, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import channels as C
from ..operators import describe, erp, filters, ica, spectra, topography, views
from ..sources import adapters as A
from .channel_queries import _CUST, _REGION_SQL, _r, customer_channels
from .tables_sql import EMB, SIG_E, SIG_L, values

N = 64
KEYS = ["epoch_id"]
_E = A.epochs_from_embeddings
PI = "3.141592653589793"


def _fft(**options):
    return lambda s, d: _r(spectra.fft_spectrum(_E(s, d), KEYS, "rel_idx", A.EPOCH_RATE, N, **options).select("epoch_id", "freq_idx", "frequency", "power", "amplitude"), "frequency", "power", "amplitude", digits=8)


def _phase(spark, sf):
    out = spectra.fft_spectrum(_E(spark, sf), KEYS, "rel_idx", A.EPOCH_RATE, N, window="hamming")
    # an angle says nothing of a bin without amplitude and jumps at its ends, so it is compared as a vector
    both = out.select("epoch_id", "freq_idx", (F.col("amplitude") * F.cos("phase")).alias("in_phase"), (F.col("amplitude") * F.sin("phase")).alias("quadrature"))
    return _r(both, "in_phase", "quadrature", digits=7)


def _per_epoch(spark, sf):
    out = spectra.epochs_fft(_E(spark, sf), A.EPOCH_RATE, N, per_epoch=True)
    return _r(out.select("freq_idx", "frequency", "power", "amplitude"), "frequency", "power", "amplitude", digits=8)


def _averaged(spark, sf):
    out = spectra.epochs_fft(_E(spark, sf), A.EPOCH_RATE, N)
    return _r(out.select("freq_idx", "frequency", "power", "amplitude"), "frequency", "power", "amplitude", digits=8)


def _evoked(spark, sf):
    out = spectra.fft_spectrum(erp.average_epochs(_E(spark, sf)), ["condition"], "rel_idx", A.EPOCH_RATE, N)
    return _r(out.select("condition", "freq_idx", "power", "amplitude"), "power", "amplitude", digits=8)


def _welch(**options):
    return lambda s, d: _r(spectra.welch_psd(_E(s, d), KEYS, "rel_idx", A.EPOCH_RATE, N, 0.5, **options), "frequency", "power", digits=8)


def _taper(low_bias=True):
    return lambda s, d: _r(spectra.multitaper_psd(_E(s, d), KEYS, "rel_idx", A.EPOCH_RATE, N, n_tapers=8, low_bias=low_bias), "frequency", "power", digits=8)


def _bands(bands=None, relative=False):
    def run(spark, sf):
        psd = spectra.welch_psd(_E(spark, sf), KEYS, "rel_idx", A.EPOCH_RATE, N, 0.5)
        return _r(spectra.band_power(psd, KEYS, bands, relative), "power", digits=6)

    return run


def _band_wide(spark, sf):
    psd = spectra.welch_psd(_E(spark, sf), KEYS, "rel_idx", A.EPOCH_RATE, N, 0.5)
    names = ["alpha", "beta"]
    return _r(spectra.band_table(spectra.band_power(psd, KEYS, {k: spectra.BANDS[k] for k in names}), KEYS, names), *names, digits=6)


_HANN = f"(0.5 - 0.5 * cos(2 * {PI} * {{i}} / {{m}})) / (0.5 - 0.5 * cos(2 * {PI} * ({{m}} // 2) / {{m}}))"
_X = f"{EMB}, x as (select epoch_id, \"type\", rel_idx, (value - avg(value) over (partition by epoch_id)) * {_HANN.format(i='rel_idx', m=63)} v from emb)"


def _dft(source: str, by: str, n: int, bins: int, index: str = "rel_idx") -> str:
    return f"(select {by}, k, sum(v * cos(2 * {PI} * k * {index} / {n})) re, -sum(v * sin(2 * {PI} * k * {index} / {n})) im from {source}, range({bins}) r(k) group by all)"


def _amp(n: int) -> str:
    return f"sqrt(re * re + im * im) / {n} * case when k = 0 or k = {n // 2} then 1 else 2 end"


def _power_sql(x: str, by: str, n: int, where: str = "true", frequency: bool = True) -> str:
    f = f"round(k * 64.0 / {n}, 8) + 0.0 frequency, " if frequency else ""
    return f"with {x}, f as {_dft('x', by, n, n // 2 + 1)} select {by}, cast(k as integer) freq_idx, {f}round(pow({_amp(n)}, 2), 8) + 0.0 power, round({_amp(n)}, 8) + 0.0 amplitude from f where {where}"


_SEG = f"""{EMB}, seg as (select epoch_id, s, rel_idx - 16 * s i, value from emb, range(3) q(s) where rel_idx between 16 * s and 16 * s + 31),
y as (select epoch_id, s, i, (value - avg(value) over (partition by epoch_id, s)) * {_HANN.format(i='i', m=31)} v from seg),
wn as (select sum(pow({_HANN.format(i='j', m=31)}, 2)) w2 from range(32) q(j)),
pg as (select epoch_id, s, k, (re * re + im * im) / (64 * w2) * case when k = 0 or k = 16 then 1 else 2 end p from {_dft('y', 'epoch_id, s', 32, 17, 'i')}, wn),
psd as (select epoch_id, k, k * 2.0 f, avg(p) p, median(p) md from pg group by all)"""
_BAND_ROWS = [(k, a, b) for k, (a, b) in spectra.BANDS.items()]


def _band_sql(rows: list[tuple], relative: bool = False) -> str:
    power = "power / sum(power) over (partition by epoch_id)" if relative else "power"
    return f"""with {_SEG}, {values(rows, 'bands', 'band, low, high')}, ib as (select epoch_id, band, f, p, lead(f) over w nf, lead(p) over w np from psd join bands on f between low and high window w as (partition by epoch_id, band order by f)),
    ar as (select epoch_id, band, case when count(*) >= 2 then sum((nf - f) * (p + np) / 2) end power from ib group by all), al as (select epoch_id, band, power from (select distinct epoch_id from psd) cross join bands left join ar using (epoch_id, band))
    select epoch_id, band, round({power}, 6) + 0.0 power from al"""


def _taper_sql(low_bias: bool) -> str:
    v = spectra.chosen_tapers(N, 4.0, 8, low_bias)
    rows = [(k, i, float(v[k, i])) for k in range(len(v)) for i in range(N)]
    return f"""with {EMB}, {values(rows, 'tp', 'k0, i, h')}, x as (select epoch_id, k0, rel_idx, (value - m) * h v from (select *, avg(value) over (partition by epoch_id) m from emb) join tp on i = rel_idx),
    f as {_dft('x', 'epoch_id, k0', N, 33)} select epoch_id, cast(k as integer) freq_idx, round(k * 1.0, 8) + 0.0 frequency, round(avg((re * re + im * im) / 64 * case when k = 0 or k = 32 then 1 else 2 end), 8) + 0.0 power from f group by 1, 2, 3"""


_TAPS = {
    "fir_bandpass": filters.bandpass_taps(A.EVENT_RATE, 4.0, 16.0),
    "fir_highpass": filters.bandpass_taps(A.EVENT_RATE, 4.0, None),
    "fir_lowpass": filters.bandpass_taps(A.EVENT_RATE, None, 16.0, window="blackman"),
    "fir_notch": filters.notch_taps(A.EVENT_RATE, [8.0, 20.0], [2.0, 2.0], transition=4.0),
}
_LINE_TAPS = filters.bandpass_taps(A.LINE_RATE, None, 40.0)


def _fir(taps: np.ndarray, block: int | str = "auto"):
    return lambda s, d: _r(filters.fir_filter(A.signal_from_events(s, d), taps, block=block).select("recording_id", "sample_idx", "value"), "value")


def _fir_sql(taps: np.ndarray, sig: str = SIG_E, where: str = "true", extra: str = "") -> str:
    """Sum over taps of the signal, read by reflection beyond its ends."""
    m = (len(taps) - 1) // 2
    rows = [(j, float(h)) for j, h in enumerate(taps)]
    length = "" if "len as" in sig else ", len as (select recording_id, max(sample_idx) n from sig group by 1)"
    return f"""with {sig}{length}, {values(rows, 'taps', 'j, h')}, s1 as (select * from sig where {where}),
    q as (select s1.recording_id, s1.sample_idx, h, n, s1.sample_idx + {m} - j p from s1 join len using (recording_id), taps),
    e as (select recording_id, max(case when sample_idx = 1 then value end) first_v, max(case when sample_idx = n then value end) last_v from s1 join len using (recording_id) group by 1),
    g as (select q.*, case when p < 1 then 2 - p when p > n then 2 * n - p else p end z from q),
    v as (select g.recording_id, g.sample_idx, sum(h * case when g.p < 1 then 2 * first_v - s1.value when g.p > n then 2 * last_v - s1.value else s1.value end) as value
      from g join s1 on s1.recording_id = g.recording_id and s1.sample_idx = z join e on e.recording_id = g.recording_id group by 1, 2)
    select recording_id, {extra}sample_idx, round(value, 4) + 0.0 as value from v"""


def _fir_subset(spark, sf):
    """One channel filtered, the others as they were."""
    out = filters.fir_filter(A.signal_from_lineitem(spark, sf), _LINE_TAPS, ["Cz"])
    return _r(out.select("recording_id", "channel", "sample_idx", "value"), "value")


# a fixed model of three channels: rotations by given angles
_turn = lambda a: np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1.0]])
MODEL = ica.ICA(
    ["Cz", "Pz", "Oz"], np.array([10.0, 20000.0, 0.03]), np.array([2.5, 1.9, 1.6]), _turn(0.4)[[2, 0, 1]], np.array([1.5, 1.0, 0.5]), _turn(0.7)[:, [1, 2, 0]], (2,)
)
_W, _O = MODEL.to_sources()
_CLEAN, _CLEAN_O = MODEL.cleaning()
_SRC = (
    SIG_L
    + ", "
    + values([(f"IC{k + 1}", c, float(_W[k, i])) for k in range(3) for i, c in enumerate(MODEL.channels)], "wt", "component, channel, w")
    + ", "
    + values([(f"IC{k + 1}", float(_O[k])) for k in range(3)], "off", "component, o")
    + ", src as (select recording_id, sample_idx, component, sum(value * w) + max(o) as value from sig join wt using (channel) join off using (component) group by 1, 2, 3)"
)


# the columns of a line are the channels of a sample, so each cleaned channel is an expression of one row
_CLEANED_SQL = " union all ".join(
    [f"select recording_id, '{o}' channel, sample_idx, " + " + ".join(f"cast({c} as double) * {float(_CLEAN[i, j])!r}" for j, c in enumerate(("l_quantity", "l_extendedprice", "l_discount"))) + f" + {float(_CLEAN_O[i])!r} as value from li" for i, o in enumerate(MODEL.channels)]
    + ["select recording_id, 'EXG1', sample_idx, cast(l_tax as double) from li"]
)


def _sources(spark, sf):
    return _r(ica.get_sources(MODEL, A.signal_from_lineitem(spark, sf)), "value")


def _applied(spark, sf):
    return _r(ica.apply_ica(MODEL, A.signal_from_lineitem(spark, sf)).select("recording_id", "channel", "sample_idx", "value"), "value")


def _summary(spark, sf):
    return _r(ica.component_summary(MODEL, A.signal_from_lineitem(spark, sf), ["EXG1"]), "variance_share", "corr_EXG1")


def _weights(spark, sf):
    """How much each component's map weighs on each channel, scaled by the channel's deviation."""
    sd = A.signal_from_lineitem(spark, sf).groupBy("recording_id", "channel").agg(F.stddev_samp("value").alias("sd"))
    maps = ica.topographies(spark, MODEL)
    return _r(sd.join(maps, "channel").select("recording_id", "component", "channel", (F.col("weight") / F.col("sd")).alias("scaled")), "scaled")


def _whitener(spark, sf):
    typed = C.classify_channels(A.channels_from_lineitem(spark, sf))
    return _r(ica.pre_whitener(A.signal_from_lineitem(spark, sf), typed), "sd")


_SIZES = {"Cz": 10.0, "Pz": 20000.0, "Oz": 0.03, "EXG1": 0.03}


def _covariance(spark, sf):
    """Of channels brought to like sizes, as pre-whitening does."""
    scale = F.create_map(*[F.lit(v) for pair in _SIZES.items() for v in pair])
    s = A.signal_from_lineitem(spark, sf)
    return _r(ica.covariance(s.withColumn("value", F.col("value") / scale[F.col("channel")])), "cov", digits=6)


_CONTRASTS = {
    "logcosh": ("tanh(a.value)", "1 - pow(tanh(a.value), 2)"),
    "exp": ("a.value * exp(-a.value * a.value / 2)", "(1 - a.value * a.value) * exp(-a.value * a.value / 2)"),
    "cube": ("pow(a.value, 3)", "3 * a.value * a.value"),
}


def _terms(spark, sf):
    s = A.signal_from_lineitem(spark, sf)
    every = [ica.fixed_point_terms(MODEL, s, fun).withColumn("fun", F.lit(fun)) for fun in _CONTRASTS]
    return _r(every[0].unionByName(every[1]).unionByName(every[2]), "term")


def _terms_sql() -> str:
    each = [
        f"select '{fun}' fun, a.recording_id, cast(a.component[3:] as integer) i, cast(b.component[3:] as integer) j, round(avg({g} * b.value - case when a.component = b.component then {slope} else 0 end), 4) + 0.0 term from src a join src b using (recording_id, sample_idx) group by 1, 2, 3, 4"
        for fun, (g, slope) in _CONTRASTS.items()
    ]
    return f"with {_SRC} " + " union all ".join(each)


def _fitted(spark, sf):
    model = ica.fit_ica(A.signal_from_lineitem(spark, sf), ["Cz", "Pz", "Oz", "EXG1"], ["eeg", "eeg", "eeg", "external"])
    return ica.topographies(spark, model)


def _stacked(spark, sf):
    out = views.stacked_sources(ica.get_sources(MODEL, A.signal_from_lineitem(spark, sf)))
    return _r(out.select("recording_id", "sample_idx", "component", "offset", "y"), "offset", "y", digits=3)


def _overlay(spark, sf):
    return _r(ica.before_and_after(MODEL, A.signal_from_lineitem(spark, sf)), "before", "after")


def _surface(spark, sf):
    named = customer_channels(spark, sf).join(A.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    means = named.groupBy("channel").agg(F.avg("c_acctbal").alias("value")).withColumn("recording_id", F.lit("all"))
    return topography.scalp_map(means, C.create_montage(named), 40)


# an embedding's values stand for those of 64 electrodes: one map a vector
_SITES = list({(r[6], r[7], r[8]): r for r in C.electrode_rows() if r[6] is not None}.values())[:N]
_GRID = 12


def _maps(spark, sf):
    names = F.array(*[F.lit(r[0]) for r in _SITES])
    values_ = _E(spark, sf).select(F.col("epoch_id"), names[F.col("rel_idx")].alias("channel"), "value")
    montage = spark.createDataFrame([(r[0], *map(float, r[6:9])) for r in _SITES], "channel string, x double, y double, z double")
    return _r(topography.scalp_map(values_, montage, _GRID, "epoch_id").select("epoch_id", "gx", "gy", "value"), "value")


def _maps_sql() -> str:
    """Literal weights, times values."""
    x, y, z = np.array([r[6:9] for r in _SITES], float).T
    elevation, azimuth = np.arccos(np.clip(z / np.sqrt(x**2 + y**2 + z**2), -1, 1)), np.arctan2(y, x)
    weights = topography.map_weights(np.column_stack([elevation * np.cos(azimuth), elevation * np.sin(azimuth)]), _GRID)
    rows = [(g % _GRID, g // _GRID, i, float(w) if np.isfinite(w) else None) for g, ws in enumerate(weights) for i, w in enumerate(ws)]
    return f"with {EMB}, {values(rows, 'wt', 'gx, gy, i, w')} select epoch_id, cast(gx as integer) gx, cast(gy as integer) gy, round(sum(value * w), 4) + 0.0 as value from emb join wt on i = rel_idx group by 1, 2, 3"


def _electrode_view(spark, sf):
    return views.electrode_view(C.create_montage(customer_channels(spark, sf)), ["Cz", "Pz"]).select("channel", "region", "highlighted")


def _spectrum_overview(spark, sf):
    out = describe.describe_spectrum(spectra.welch_psd(_E(spark, sf), KEYS, "rel_idx", A.EPOCH_RATE, N, 0.5), KEYS)
    return _r(out, "low", "high", "peak_frequency", "peak_power", "resolution", digits=8)


QUERIES = {
    "spectrum_overview": (
        _spectrum_overview,
        f"with {_SEG} select epoch_id, count(*) n_bins, min(f) low, max(f) high, arg_max(f, p) peak_frequency, round(max(p), 8) + 0.0 peak_power, (max(f) - min(f)) / (count(*) - 1) resolution from psd group by 1",
    ),
    "fft_power": (_fft(), _power_sql(_X, "epoch_id", 64)),
    "fft_zero_pad": (_fft(n_fft=128), _power_sql(_X, "epoch_id", 128)),
    "fft_no_window": (_fft(window="none", remove_dc=False), _power_sql(f"{EMB}, x as (select epoch_id, rel_idx, value v from emb)", "epoch_id", 64)),
    "fft_frequency_range": (_fft(fmin=5.0, fmax=20.0), _power_sql(_X, "epoch_id", 64, "k between 5 and 20")),
    "fft_phase": (
        _phase,
        f"""with {EMB}, x as (select epoch_id, rel_idx, (value - avg(value) over (partition by epoch_id)) * (0.54 - 0.46 * cos(2 * {PI} * rel_idx / 63)) v from emb), f as {_dft('x', 'epoch_id', 64, 33)}
        select epoch_id, cast(k as integer) freq_idx, round({_amp(64)} * coalesce(re / nullif(sqrt(re * re + im * im), 0), 1), 7) + 0.0 in_phase, round({_amp(64)} * coalesce(im / nullif(sqrt(re * re + im * im), 0), 0), 7) + 0.0 quadrature from f""",
    ),
    "fft_per_epoch": (_per_epoch, f"with {_X}, f as {_dft('x', 'epoch_id', 64, 33)} select cast(k as integer) freq_idx, round(k * 1.0, 8) + 0.0 frequency, round(avg(pow({_amp(64)}, 2)), 8) + 0.0 power, round(avg({_amp(64)}), 8) + 0.0 amplitude from f group by 1, 2"),
    "fft_epoch_average": (
        _averaged,
        f"""with {EMB}, a as (select rel_idx, avg(value) value from emb group by 1), x as (select 0 g, rel_idx, (value - avg(value) over ()) * {_HANN.format(i='rel_idx', m=63)} v from a), f as {_dft('x', 'g', 64, 33)}
        select cast(k as integer) freq_idx, round(k * 1.0, 8) + 0.0 frequency, round(pow({_amp(64)}, 2), 8) + 0.0 power, round({_amp(64)}, 8) + 0.0 amplitude from f""",
    ),
    "fft_evoked": (
        _evoked,
        f"""with {EMB}, a as (select cast("type" as varchar) condition, rel_idx, avg(value) value from emb group by 1, 2), x as (select condition, rel_idx, (value - avg(value) over (partition by condition)) * {_HANN.format(i='rel_idx', m=63)} v from a),
        f as {_dft('x', 'condition', 64, 33)} select condition, cast(k as integer) freq_idx, round(pow({_amp(64)}, 2), 8) + 0.0 power, round({_amp(64)}, 8) + 0.0 amplitude from f""",
    ),
    "welch_mean": (_welch(), f"with {_SEG} select epoch_id, cast(k as integer) freq_idx, round(f, 8) + 0.0 frequency, round(p, 8) + 0.0 power from psd"),
    "welch_median": (_welch(average="median"), f"with {_SEG} select epoch_id, cast(k as integer) freq_idx, round(f, 8) + 0.0 frequency, round(md / (1 + 1 / 3.0 - 0.5), 8) + 0.0 power from psd"),
    "welch_fmin_fmax": (_welch(fmin=5.0, fmax=20.0), f"with {_SEG} select epoch_id, cast(k as integer) freq_idx, round(f, 8) + 0.0 frequency, round(p, 8) + 0.0 power from psd where f between 5 and 20"),
    "multitaper_psd": (_taper(False), _taper_sql(False)),
    "multitaper_low_bias": (_taper(True), _taper_sql(True)),
    "band_power_abs": (_bands(), _band_sql(_BAND_ROWS)),
    "band_power_rel": (_bands(relative=True), _band_sql(_BAND_ROWS, True)),
    "band_power_custom": (_bands({"slow": (2.0, 10.0), "single": (11.0, 12.5)}), _band_sql([("slow", 2.0, 10.0), ("single", 11.0, 12.5)])),
    "band_power_table": (_band_wide, f"with z as ({_band_sql([('alpha', 8.0, 13.0), ('beta', 13.0, 30.0)])}) select epoch_id, max(power) filter (band = 'alpha') alpha, max(power) filter (band = 'beta') beta from z group by 1"),
    **{name: (_fir(taps), _fir_sql(taps)) for name, taps in _TAPS.items()},
    "fir_blocks": (_fir(_TAPS["fir_notch"], 4096), _fir_sql(_TAPS["fir_notch"])),
    "fir_channel_subset": (_fir_subset, _fir_sql(_LINE_TAPS, SIG_L, "channel = 'Cz'", "'Cz' channel, ") + " union all select recording_id, channel, sample_idx, round(value, 4) + 0.0 from sig where channel <> 'Cz'"),
    "ica_prewhiten": (_whitener, f"with {SIG_L} select recording_id, case when channel = 'EXG1' then 'external' else 'eeg' end channel_type, round(stddev_pop(value), 4) + 0.0 sd from sig group by 1, 2"),
    "ica_pca_cov": (_covariance, f"with {SIG_L}, {values(list(_SIZES.items()), 'sz', 'channel, size')}, s as (select recording_id, ch_idx, sample_idx, value / size as value from sig join sz using (channel)) select a.recording_id, a.ch_idx ch_a, b.ch_idx ch_b, round(covar_samp(a.value, b.value), 6) + 0.0 cov from s a join s b on a.recording_id = b.recording_id and a.sample_idx = b.sample_idx and a.ch_idx <= b.ch_idx group by 1, 2, 3"),
    "ica_sources": (_sources, f"with {_SRC} select recording_id, sample_idx, component, round(value, 4) + 0.0 as value from src"),
    "ica_apply": (_applied, f"with {SIG_L} select recording_id, channel, sample_idx, round(value, 4) + 0.0 as value from ({_CLEANED_SQL})"),
    "ica_summary": (
        _summary,
        f"""with {_SRC}, {values([(f'IC{k}', float((MODEL.topography(k) ** 2).sum())) for k in (1, 2, 3)], 'pw', 'component, p')}, tv as (select recording_id, sum(v) tot from (select recording_id, channel, var_samp(value) v from sig where channel <> 'EXG1' group by 1, 2) group by 1),
        a as (select recording_id, component, var_samp(value) v from src group by 1, 2), cr as (select src.recording_id, component, corr(src.value, x.value) c from src join sig x on x.recording_id = src.recording_id and x.sample_idx = src.sample_idx and x.channel = 'EXG1' group by 1, 2)
        select recording_id, component, round(p * v / tot, 4) + 0.0 variance_share, round(c, 4) + 0.0 "corr_EXG1" from a join tv using (recording_id) join pw using (component) join cr using (recording_id, component)""",
    ),
    "ica_topography": (
        _weights,
        f"""with {SIG_L}, {values([(f'IC{k}', c, float(v)) for k in (1, 2, 3) for c, v in zip(MODEL.channels, MODEL.topography(k), strict=True)], 'mp', 'component, channel, w')}, s as (select recording_id, channel, stddev_samp(value) sd from sig group by 1, 2)
        select recording_id, component, channel, round(w / sd, 4) + 0.0 scaled from s join mp using (channel)""",
    ),
    "ica_fixed_point_terms": (_terms, _terms_sql()),
    "ica_fit": (_fitted, None),
    "view_stacked_sources": (
        _stacked,
        f"""with {_SRC}, u as (select src.recording_id, sample_idx, component, case when sd > 0 then value / sd else value end v from src join (select recording_id, component, stddev_samp(value) sd from src group by 1, 2) using (recording_id, component)),
        t as (select recording_id, max(abs(v)) top from u group by 1) select recording_id, sample_idx, component, round(-(cast(component[3:] as integer) - 1) * top * 2.2, 3) + 0.0 "offset", round(v - (cast(component[3:] as integer) - 1) * top * 2.2, 3) + 0.0 y from u join t using (recording_id)""",
    ),
    "view_overlay": (
        _overlay,
        f"with {SIG_L}, c as ({_CLEANED_SQL}) select recording_id, channel, sample_idx, round(sig.value, 4) + 0.0 as before, round(c.value, 4) + 0.0 as after from sig join c using (recording_id, sample_idx, channel)",
    ),
    "view_electrodes": (
        _electrode_view,
        f"with {_CUST} select distinct channel, {_REGION_SQL} region, channel in ('Cz', 'Pz') highlighted from found where x is not null",
    ),
    "topo_surface": (_surface, None),
    "topo_maps": (_maps, _maps_sql()),
}
