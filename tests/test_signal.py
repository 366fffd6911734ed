"""Exact cases and properties of the signal operators."""

import sys
import warnings
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from cortexframe.functions import bdf_format, kernels  # noqa: E402
from cortexframe.operators import channels, epochs, filters, ica, quality, reference, resample, spectra, topography, triggers  # noqa: E402
from cortexframe.recording import Recording  # noqa: E402


def signal_of(spark, data: dict[str, list], rate=1.0):
    rows = [("r", i + 1, c, s + 1, s / rate, None if v is None else float(v)) for i, (c, x) in enumerate(data.items()) for s, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, ch_idx int, channel string, sample_idx long, t double, value double")


def values_of(df, channel):
    return [r["value"] for r in df.where(F.col("channel") == channel).orderBy("sample_idx").collect()]


def events_of(spark, types, onsets, rate):
    rows = [("r", i + 1, o, (o - 1) / rate, t, "") for i, (t, o) in enumerate(zip(types, onsets, strict=True))]
    return spark.createDataFrame(rows, "recording_id string, event_seq long, onset long, onset_time double, type int, description string")


def test_int24():
    assert bdf_format.unpack_int24(b"\xff\xff\x7f\x00\x00\x80\x01").tolist() == [8388607, -8388608]
    v = np.array([0, 1, -1, 8388607, -8388608])
    assert bdf_format.unpack_int24(bdf_format.pack_int24(v)).tolist() == v.tolist()


def test_physical():
    got = bdf_format.digital_to_physical(np.array([-8388608.0, 0, 8388607]), -8388608, -262144, 262144)
    assert np.allclose(got, [-262144, 0, 262144], rtol=1e-6)


@pytest.mark.parametrize(
    "raw, onsets, types",
    [([0, 0, 0, 100, 100, 0, 0], [4], [100]), ([0, 0, 10, 10, 0, 20, 20, 0, 30, 30, 0], [3, 6, 9], [10, 20, 30]), ([5, 5, 0, 65636], [4], [100]), ([7, 7], [], [])],
)
def test_decode(spark, raw, onsets, types):
    status = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(raw)], "recording_id string, sample_idx long, raw long")
    got = triggers.decode_triggers(status, 512).orderBy("onset").collect()
    assert [r["onset"] for r in got] == onsets and [r["type"] for r in got] == types
    assert [r["onset_time"] for r in got] == [(o - 1) / 512 for o in onsets]


def test_cleaning(spark):
    assert triggers.mask_triggers(events_of(spark, [65536, 1, 65536, 2], [1, 2, 3, 4], 1)).count() == 2
    assert triggers.clean_triggers(events_of(spark, [1, 1, 1, 2, 2], [100, 101, 102, 500, 501], 512), "raw").count() == 5
    assert triggers.clean_triggers(events_of(spark, [1, 1, 1, 2], [200, 202, 204, 800], 512)).count() == 2
    assert triggers.clean_triggers(events_of(spark, [1, 2, 1], [500, 501, 600], 1000)).count() == 2
    assert triggers.clean_triggers(events_of(spark, [], [], 1000)).count() == 0


def test_average_reference(spark):
    s = signal_of(spark, {"Ch1": [10, 20, 30, 40], "Ch2": [0, 10, 20, 30], "Ch3": [-5, 5, 15, 25]})
    once = reference.rereference(s)
    for c, v in (("Ch1", 25 / 3), ("Ch2", -5 / 3), ("Ch3", -20 / 3)):
        assert np.allclose(values_of(once, c), v, atol=1e-10)
    assert np.allclose(values_of(reference.rereference(once), "Ch1"), 25 / 3)
    assert sorted(r["channel"] for r in reference.rereference(s, "Ch2", drop_ref=True).select("channel").distinct().collect()) == ["Ch1", "Ch3"]


def test_onset_strategies(spark):
    n = spark.createDataFrame([("r", 1000)], "recording_id string, n_samples long")
    e = events_of(spark, [1, 1, 1], [101, 201, 401], 512)
    onsets = lambda how: sorted(r["onset"] for r in resample.remap_events(e, 2, 512, n, how).collect())
    assert onsets("floor") == [50, 100, 200] and onsets("ceiling") == [51, 101, 201]


def test_names(spark):
    c = spark.createDataFrame([("r", n) for n in ("Fp1", "Fp2", "Unknown1", "Unknown2")], "recording_id string, channel string")
    got = channels.naming_system(c).first()
    assert (got["naming_system"], got["confidence"]) == ("Unknown", 0.5)
    kinds = {r["channel"]: r["channel_type"] for r in channels.classify_channels(spark.createDataFrame([("CZ",), (" EXG1 ",), ("EOG (EXG2)",), ("STATUS",)], "channel string")).collect()}
    assert kinds == {"CZ": "eeg", " EXG1 ": "external", "EOG (EXG2)": "external", "STATUS": "status"}
    with pytest.raises(ValueError):
        channels.rename_channels(c, {"Fp1": "a/b"})


def test_filter_shapes():
    rate = 256.0
    for taps, low, high in ((filters.bandpass_taps(rate, 8, 30), 15, 60), (filters.notch_taps(rate, [50.0]), 20, 50)):
        gain = np.abs(np.fft.rfft(taps, 1 << 16))
        at = lambda f: gain[round(f / rate * (1 << 16))]  # noqa: B023, E731
        assert abs(at(low) - 1) < 0.01 and at(high) < 0.01
    with pytest.raises(ValueError):
        filters.bandpass_taps(rate, 40, 20)


def test_fir_whole_and_blocks(spark):
    x = np.random.default_rng(0).normal(size=700)
    taps = filters.bandpass_taps(128.0, 4, 20)
    s = signal_of(spark, {"Cz": x, "EXG1": x + 1}, 128.0)
    whole = values_of(filters.fir_filter(s, taps, ["Cz"]), "Cz")
    padded = kernels.reflect_pad(x, len(taps) - 1)
    want = np.convolve(padded, taps)[len(taps) - 1 + (len(taps) - 1) // 2 :][: len(x)]
    assert np.allclose(whole, want, atol=1e-10)
    assert np.allclose(values_of(filters.fir_filter(s, taps, ["Cz"], block=200), "Cz"), want, atol=1e-10)
    assert np.allclose(values_of(filters.fir_filter(s, taps, ["Cz"]), "EXG1"), x + 1)


def test_butterworth():
    sections = kernels.butter_lowpass(8, 0.25)
    x = np.random.default_rng(1).normal(size=1500)
    for b, a in sections:
        y, z1, z2 = [], None, None
        gain = b.sum() / a.sum()
        z2 = (b[2] - a[2] * gain) * x[0]
        z1 = (b[1] - a[1] * gain) * x[0] + z2
        for u in x:
            v = b[0] * u + z1
            z1, z2 = b[1] * u - a[1] * v + z2, b[2] * u - a[2] * v
            y.append(v)
        assert np.allclose(kernels.Section(b, a)(x), y)
    sections = [kernels.Section(b, a) for b, a in sections]
    t = np.arange(2000) / 100
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 30 * t)
    assert np.abs(kernels.filtfilt(sections, slow + fast) - slow)[100:-100].max() < 0.05
    assert np.allclose(kernels.filtfilt(sections, np.full(50, 3.0)), 3.0)


@pytest.mark.parametrize("factor", [4, 16])
def test_decimate_matches_the_plain_recursion(spark, factor):
    """Whole and in blocks, against each section run sample by sample, both ways, over the reflected signal."""
    x = np.cumsum(np.random.default_rng(factor).normal(size=9000))
    design = kernels.butter_lowpass(8, 0.9 / factor)
    pad = kernels.edge_length(len(design))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]).tolist()
    for _ in range(2):
        for b, a in design:
            gain = b.sum() / a.sum()
            z2 = (b[2] - a[2] * gain) * y[0]
            z1 = (b[1] - a[1] * gain) * y[0] + z2
            for i, u in enumerate(y):
                v = b[0] * u + z1
                z1, z2, y[i] = b[1] * u - a[1] * v + z2, b[2] * u - a[2] * v, v
        y = y[::-1]
    want = np.array(y[pad : pad + len(x)])[::factor]
    s = signal_of(spark, {"Cz": x}, 512)
    for block in (65_536, 1):  # the least block is the filter's memory
        assert np.allclose(values_of(resample.decimate(s, factor, 512.0, block=block), "Cz"), want, atol=1e-9)


def test_transform_lengths_and_convolution():
    for n in (1, 2, 7, 11, 97, 1025, 65_537):
        m, rest = kernels.fast_length(n), kernels.fast_length(n)
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        assert rest == 1 and m >= n and not any(_smooth(k) for k in range(n, m))
    rng = np.random.default_rng(0)
    for n in (3, 101):
        x, h = rng.normal(size=1000), rng.normal(size=n)
        assert np.allclose(kernels.convolve_valid(x, h), np.convolve(x, h, mode="valid"))


def _smooth(n: int) -> bool:
    for p in (2, 3, 5):
        while n % p == 0:
            n //= p
    return n == 1


def test_decimate_keeps_slow_waves(spark):
    t = np.arange(1024) / 512
    s = signal_of(spark, {"Cz": np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 200 * t)}, 512)
    got = values_of(resample.decimate(s, 4, 512), "Cz")
    assert np.abs(np.array(got) - np.sin(2 * np.pi * 5 * t[::4]))[20:-20].max() < 0.05


def test_tapers():
    v, c = kernels.dpss(128, 4, 7)
    assert np.allclose(v @ v.T, np.eye(7), atol=1e-8) and (c > 0.8).all()
    assert [round(kernels.median_bias(n), 4) for n in range(8)] == [1, 1, 1, 0.8333, 0.8333, 0.7833, 0.7833, 0.7595]


def test_spectral_peak(spark):
    t = np.arange(1024) / 256
    s = signal_of(spark, {"Cz": 10 * np.sin(2 * np.pi * 10 * t)}, 256)
    for out in (
        spectra.fft_spectrum(s, ["recording_id", "channel"], "sample_idx", 256, 1024),
        spectra.welch_psd(s, ["recording_id", "channel"], "sample_idx", 256, 1024),
        spectra.multitaper_psd(s, ["recording_id", "channel"], "sample_idx", 256, 1024, segment_length=2.0),
    ):
        assert abs(out.orderBy(F.desc("power")).first()["frequency"] - 10) < 1
    bands = spectra.band_power(spectra.welch_psd(s, ["channel"], "sample_idx", 256, 1024), ["channel"], relative=True)
    assert abs(bands.agg(F.sum("power")).first()[0] - 1) < 1e-9


def test_missing_values_give_nulls(spark):
    s = signal_of(spark, {"Cz": [1.0, None, 3.0, 4.0] * 8, "Pz": [1.0, 2.0, 3.0, 5.0] * 8}, 32)
    out = spectra.fft_spectrum(s, ["channel"], "sample_idx", 32, 32)
    assert out.where("channel = 'Cz' and power is not null").count() == 0 and out.where("channel = 'Pz' and power is null").count() == 0
    assert {r["channel"]: r["bad"] for r in quality.bad_channels(s).collect()} == {"Cz": True, "Pz": False}


def test_epochs_reject_and_renumber(spark):
    x = np.zeros(200)
    x[60] = 100
    s = signal_of(spark, {"Cz": x + np.arange(200) % 3}, 10)
    out = epochs.epoch_recording(s, events_of(spark, [1, 1, 1, 1], [1, 60, 60, 120], 10), s.groupBy("recording_id").agg(F.max("sample_idx").alias("n_samples")), epochs.Geometry(10, -0.5, 0.5), reject_threshold=50.0)
    assert [r["epoch_id"] for r in out.events.collect()] == [1]
    assert sorted(r["code"] for r in out.log.collect()) == ["amplitude", "boundary"]
    assert out.data.select("epoch_id").distinct().count() == 1


def mixed(spark):
    t = np.arange(2000) / 256
    src = np.stack([np.sin(2 * np.pi * 5 * t), np.sign(np.sin(2 * np.pi * 11 * t))])
    data = np.array([[1, 0.5], [0.3, 1], [0.8, -0.6]]) @ src + np.random.default_rng(2).normal(0, 0.01, (3, 2000))
    return src, signal_of(spark, dict(zip(["Fp1", "Fp2", "Cz"], data, strict=True)), 256)


def test_ica_recovers_sources(spark):
    src, s = mixed(spark)
    model = ica.fit_ica(s, ["Fp1", "Fp2", "Cz"], n_components=2, max_iter=50)
    found = np.stack([[r["value"] for r in ica.get_sources(model, s).where(F.col("component") == c).orderBy("sample_idx").collect()] for c in ("IC1", "IC2")])
    assert (np.abs(np.corrcoef(np.vstack([src, found]))[:2, 2:]).max(1) > 0.9).all()


def test_ica_by_deflation(spark):
    """Directions one after the other recover the sources too, and are orthonormal."""
    src, s = mixed(spark)
    model = ica.fit_ica(s, ["Fp1", "Fp2", "Cz"], n_components=2, max_iter=60, algorithm="deflation")
    assert np.allclose(model.unmixing @ model.unmixing.T, np.eye(2), atol=1e-9) and 1 <= model.n_iter <= 60
    found = np.stack([[r["value"] for r in ica.get_sources(model, s).where(F.col("component") == c).orderBy("sample_idx").collect()] for c in ("IC1", "IC2")])
    assert (np.abs(np.corrcoef(np.vstack([src, found]))[:2, 2:]).max(1) > 0.9).all()


def test_deflation_finds_the_known_rotation():
    """On exact moments of independent sources, each direction is one source, in order of its start."""
    rng = np.random.default_rng(3)
    z = rng.uniform(-np.sqrt(3), np.sqrt(3), (40_000, 3)) @ (turn := ica.decorrelate(rng.normal(size=(3, 3)))).T
    z = (z - z.mean(0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(z.T))).T

    def moments(w):
        g = np.tanh(z @ w.T)
        return g.T @ z / len(z), (1 - g**2).mean(0)

    w, steps = ica.turn_in_sequence(moments, rng.normal(size=(3, 3)), 200, 1e-8)
    assert (np.abs(w @ turn).max(1) > 0.99).all() and sorted(np.abs(w @ turn).argmax(1)) == [0, 1, 2] and steps < 200


def test_ica_settings_are_checked(spark):
    s = signal_of(spark, {"Cz": [1, 2, 3], "Pz": [3, 1, 2]})
    for wrong in ({"algorithm": "both"}, {"fun": "sine"}, {"tol": -1.0}, {"max_iter": 0}):
        with pytest.raises(ValueError):
            ica.fit_ica(s, ["Cz", "Pz"], **wrong)
    for absent in ({"noise_cov": np.eye(2)}, {"method": "infomax"}):
        with pytest.raises(NotImplementedError):
            ica.fit_ica(s, ["Cz", "Pz"], **absent)


def test_ica_fit_query_is_converged(spark, monkeypatch):
    """The query's maps on a small mixture against a fixed point of numpy run to 1e-12."""
    from cortexframe.plans import spectral_queries

    names = ["Cz", "Pz", "Oz", "EXG1"]
    rng = np.random.default_rng(6)  # noise slows the fixed point: a loose tolerance stops at 0.984
    src = np.stack([rng.uniform(-1, 1, 3000) + 0.8 * rng.normal(size=3000), rng.laplace(size=3000), np.sin(np.arange(3000) / 7) + 0.8 * rng.normal(size=3000), rng.uniform(-1, 1, 3000) + 0.8 * rng.normal(size=3000)])
    x = (rng.normal(size=(4, 4)) @ src).T
    monkeypatch.setattr(spectral_queries.A, "signal_from_lineitem", lambda s, d: signal_of(spark, dict(zip(names, x.T.tolist(), strict=True))))
    got = {(r["component"], r["channel"]): r["weight"] for r in spectral_queries.QUERIES["ica_fit"][0](spark, "").collect()}
    maps = np.array([[got[f"IC{k}", c] for c in names] for k in range(1, 5)])
    scale = np.array([x[:, :3].std()] * 3 + [x[:, 3].std()])
    pw = x / scale
    values, rows = np.linalg.eigh(np.cov(pw.T))
    z = (pw - pw.mean(0)) @ rows / np.sqrt(values)
    w = ica.decorrelate(rng.normal(size=(4, 4)))
    for _ in range(5000):
        g = np.tanh(z @ w.T)
        new = ica.decorrelate(g.T @ z / len(z) - (1 - g**2).mean(0)[:, None] * w)
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if moved < 1e-12:
            break
    want = (scale[:, None] * (rows * np.sqrt(values)) @ w.T).T
    alike = np.abs(maps @ want.T) / np.linalg.norm(maps, axis=1)[:, None] / np.linalg.norm(want, axis=1)
    assert moved < 1e-12 and (alike.max(1) > 0.999).all() and sorted(alike.argmax(1)) == [0, 1, 2, 3]


def test_ica_round_trip(spark):
    _, s = mixed(spark)
    model = ica.fit_ica(s, ["Fp1", "Fp2", "Cz"], n_components=3, max_iter=3, tol=10.0)
    assert np.allclose(values_of(ica.apply_ica(model, s), "Fp2"), values_of(s, "Fp2"), atol=1e-6)
    assert ica.set_exclude(model, [2, 1, 2]).exclude == (1, 2) and ica.set_exclude(model, None).exclude == ()
    with pytest.raises(ValueError):
        ica.set_exclude(model, [4])


def test_small_algebra():
    rows = np.array([[1.0, 0, 0]])
    first = ica.gram_schmidt(np.array([0.5, 0.5, 0.5]), rows)
    assert first.tolist() == [0, 0.5, 0.5]
    w = ica.decorrelate(np.random.default_rng(3).normal(size=(4, 4)))
    assert np.allclose(w @ w.T, np.eye(4))


def test_scalp_map(spark):
    names = ["Cz", "Fz", "Pz", "Oz", "T7", "T8"]
    m = channels.create_montage(spark.createDataFrame([(n,) for n in names], "channel string"))
    v = spark.createDataFrame([("r", n, float(i)) for i, n in enumerate(names)], "recording_id string, channel string, value double")
    out = topography.scalp_map(v, m, 21)
    assert out.count() == 441 and out.where("gx = 10 and gy = 10").first()["value"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(Exception, match="three"):
        topography.scalp_map(v.limit(2), m, 5).collect()


def test_bdf_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    samples = [8, 4, 8]
    records = [[rng.integers(-1000, 1000, n) for n in samples[:2]] + [np.array([0, 0, 0, 0, 7, 7, 0, 0])] for _ in range(5)]
    (tmp_path / "a.bdf").write_bytes(bdf_format.build_file(["Cz", "EXG1", "Status"], records, samples, declared=-1))
    from cortexframe.sources import bdf

    got = bdf.read_bdf(spark, str(tmp_path), chunk_records=2)
    want = np.concatenate([r[0] for r in records]) * (524288 / 16777216)
    assert np.allclose(values_of(got, "Cz"), want) and len(values_of(got, "EXG1")) == 20
    head = bdf.read_bdf_header(spark, str(tmp_path / "a.bdf")).orderBy("ch_idx").collect()
    assert [h["sampling_rate"] for h in head] == [8, 4, 8] and head[0]["records"] == 5
    r = Recording.from_bdf(spark, str(tmp_path / "a.bdf"), ["Cz", "Status"])
    assert [e["onset"] for e in r.events.orderBy("onset").collect()] == [5, 13, 21, 29, 37]
    assert [c["channel_type"] for c in r.channels.collect()] == ["eeg"]
    with pytest.raises(ValueError):
        bdf.list_files(__file__)


def test_bdf_events_come_from_the_status_line(spark, tmp_path):
    """With other channels chosen, and where no channel is named Status: the last one is read unscaled."""
    from cortexframe.sources import bdf

    rng = np.random.default_rng(7)
    code = [np.array([0, 0, 3, 3, 0, 0, 65536 + 9, 9])] * 3
    records = [[rng.integers(-9999, 9999, 8), c] for c in code]
    for name, labels in (("a", ["Cz", "Status"]), ("b", ["Cz", "Trig"]), ("c", ["status", "Cz"])):
        (tmp_path / name).mkdir()
        rows = [r[::-1] for r in records] if name == "c" else records
        (tmp_path / name / "x.bdf").write_bytes(bdf_format.build_file(labels, rows, [8, 8]))
        for chosen in (None, ["Cz"]):
            r = Recording.from_bdf(spark, str(tmp_path / name), chosen)
            assert [(e["onset"], e["type"]) for e in r.events.orderBy("onset").collect()] == [(k * 8 + i, t) for k in range(3) for i, t in ((3, 3), (7, 9))]
            assert [c["channel"] for c in r.channels.collect()] == ["Cz"]
        assert [s["raw"] for s in bdf.read_status(spark, str(tmp_path / name)).orderBy("sample_idx").limit(8).collect()] == code[0].tolist()


def test_bdf_rates_differ_by_file(spark, tmp_path):
    ramp = lambda n: [[np.arange(n), np.array([0] * (n // 2) + [5] * (n // 2))] for _ in range(2)]
    (tmp_path / "slow.bdf").write_bytes(bdf_format.build_file(["Cz", "Status"], ramp(8), [8, 8]))
    (tmp_path / "fast.bdf").write_bytes(bdf_format.build_file(["Cz", "Status"], ramp(16), [16, 16]))
    with pytest.raises(ValueError):
        Recording.from_bdf(spark, str(tmp_path))
    found = Recording.from_bdf_by_rate(spark, str(tmp_path))
    assert sorted(found) == [8.0, 16.0]
    for rate, r in found.items():
        assert [(e["onset_time"], e["recording_id"]) for e in r.events.orderBy("onset").collect()] == [(k + 0.5, "slow" if rate == 8 else "fast") for k in range(2)]
        assert r.signal.agg(F.max("t")).first()[0] == pytest.approx(2 - 1 / rate)


def test_bdf_cut_file_and_partitions(spark, tmp_path):
    """Samples that a cut file lacks are null; shares of a file's records make its whole."""
    from cortexframe.sources import bdf

    records = [[np.arange(4) + 10 * r, np.zeros(4, int)] for r in range(7)]
    raw = bdf_format.build_file(["Cz", "Status"], records, [4, 4])
    (tmp_path / "x.bdf").write_bytes(raw[:-18])
    got = bdf.read_bdf(spark, str(tmp_path), ["Cz"])
    assert got.count() == 28 and got.where("value is null").count() == 2
    bdf.register(spark)
    small = spark.read.format("bdf").option("path", str(tmp_path)).option("partition_bytes", 60).option("chunk_records", 2).load()
    assert small.rdd.getNumPartitions() > 5
    assert [r["record_no"] for r in small.where("channel = 'Cz'").orderBy("record_no").collect()] == list(range(7))


def test_conditions_in_order_of_appearance(spark):
    e = events_of(spark, [7, 3, 7, 5, 3], [10, 20, 30, 40, 50], 10)
    assert [(r["type"], r["position"]) for r in epochs.condition_order(e).orderBy("position").collect()] == [(7, 1), (3, 2), (5, 3)]


def test_channels_without_a_position_are_named(spark):
    s = signal_of(spark, {"Cz": [1, 2], "Q1": [3, 4]})
    montage = channels.create_montage(s.select("channel").distinct())
    assert [tuple(r) for r in channels.unplaced_channels(s, montage).collect()] == [("Q1", 2)]


def test_recording_chain(spark):
    x = np.random.default_rng(5).normal(size=512)
    s = signal_of(spark, {"Cz": x, "Pz": -x, "EXG1": x * 2}, 128)
    r = Recording.from_signal(s, 128.0, events_of(spark, [1, 2], [129, 257], 128))
    out = r.rename({"EXG1": "HEOG"}, keep_original=False).rereference("average").downsample(64, "simple").with_montage()
    assert out.sampling_rate == 64 and len(out.history) == 4 and out.montage.count() == 2
    assert {c["channel"]: c["channel_type"] for c in out.channels.collect()}["HEOG"] == "external"
    assert [e["onset"] for e in out.events.orderBy("onset").collect()] == [64, 128]
    assert out.epochs(-0.2, 0.2).events.count() == 2
    with pytest.raises(ValueError):
        Recording.from_signal(s.drop("value"), 128.0)


def test_small_helpers(spark, tmp_path):
    from cortexframe.operators import describe
    from cortexframe.sources import bdf

    r = Recording.from_matrix(spark, [[1, 2, 3], [4, 5, 6]], ["Cz", "EXG1"], 10.0)
    assert values_of(r.signal, "EXG1") == [4, 5, 6] and r.overview().first()["n_eeg"] == 1
    with pytest.raises(ValueError):
        Recording.from_matrix(spark, [[1]], ["Cz", "Pz"], 10.0)
    assert channels.pick_channels(r.signal, [2]).count() == 3
    with pytest.raises(ValueError):
        channels.pick_channels(r.signal, ["Cz", "Fz"])
    with pytest.warns(UserWarning):
        assert resample.check_bands({"alpha": (8, 13), "gamma": (30, 100)}, 64) == ["gamma"]
    assert describe.describe_ica(spark, ica.ICA(["Cz"])).first()["fitted"] is False
    (tmp_path / "b.bdf").write_bytes(bdf_format.build_file(["Cz", "Status"], [[np.array([1, 2]), np.array([0, 0])]], [2, 2]))
    got = {x["channel"]: x["position_type"] for x in bdf.scan_channels(spark, str(tmp_path / "b.bdf")).collect()}
    assert got == {"Cz": "Central", "Status": "Status/Metadata"}
    bdf.write_events_csv(events_of(spark, [1], [2], 10), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_stream_decodes_across_batches(spark, tmp_path):
    from cortexframe.streaming.triggers import decode_stream

    raw = [0, 0, 10, 10, 0, 20, 20, 20, 30, 30, 0]
    schema = "recording_id string, sample_idx long, raw long"
    for i in range(0, len(raw), 4):
        part = [("r", k + 1, raw[k]) for k in range(i, min(len(raw), i + 4))]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decode_stream(files, 1.0).writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["type"] for r in spark.table("decoded").collect()} <= {10, 20, 30} and spark.table("decoded").count() == 3


def write_bdf(path, labels, values, per_record):
    records = [list(values[:, a : a + per_record]) for a in range(0, values.shape[1], per_record)]
    path.write_bytes(bdf_format.build_file(labels, records, [per_record] * len(labels)))
    return path


def pushed_reader(path, *filters):
    from cortexframe.sources import bdf

    reader = bdf.BdfSampleReader({"path": str(path), "chunk_records": "4"})
    return reader, list(reader.pushFilters(list(filters)))


def test_filters_reach_the_recording_file(spark, tmp_path, monkeypatch):
    """Fewer bytes are read for one channel and a range of samples, and the rows are the same."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan

    from cortexframe.sources import bdf

    rng = np.random.default_rng(0)
    labels = ["Fz", "Cz", "Pz", "Oz", "C3", "C4", "Status"]
    path = write_bdf(tmp_path / "r.bdf", labels, rng.integers(-1000, 1000, (len(labels), 40 * 16)), 16)
    write_bdf(tmp_path / "other.bdf", labels, rng.integers(-1000, 1000, (len(labels), 40 * 16)), 16)
    read = []
    plain = bdf._read_at
    monkeypatch.setattr(bdf, "_read_at", lambda f, offset, size: read.append(size) or plain(f, offset, size))

    def rows(*filters):
        reader, left = pushed_reader(path, *filters)
        read.clear()
        out = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return out, sum(read), left

    whole, all_bytes, _ = rows()
    chosen, some_bytes, left = rows(EqualTo(("channel",), "Cz"), GreaterThanOrEqual(("sample_idx",), 100), LessThan(("sample_idx",), 200), IsNotNull(("value",)))
    assert chosen == [r for r in whole if r["channel"] == "Cz" and 100 <= r["sample_idx"] < 200] and len(chosen) == 100
    assert some_bytes * 30 < all_bytes and [type(f) for f in left] == [IsNotNull]
    assert rows(EqualTo(("channel",), "none"))[:2] == ([], 0)
    frame = bdf.read_bdf(spark, str(tmp_path)).where("channel = 'Cz' and recording_id = 'r' and sample_idx between 100 and 199")
    assert sorted(r["value"] for r in frame.collect()) == sorted(r["value"] for r in chosen)


def test_long_channels_in_chunks_of_segments(spark):
    """Means and medians over chunks equal those of whole traces; also with values missing."""
    n = 20_000
    x = np.random.default_rng(4).normal(size=n)
    rows = spark.range(n).select(F.lit("r").alias("recording_id"), (F.col("id") + 501).alias("sample_idx"), F.get(F.array(*[F.lit(float(v)) for v in x[:500]]), (F.col("id") % 500).cast("int")).alias("v"), F.col("id"))
    rows = rows.select("recording_id", "sample_idx", (F.col("v") + F.sin(F.col("id") * 0.3)).alias("value"))
    for make in (
        lambda **o: spectra.welch_psd(rows, ["recording_id"], "sample_idx", 256, n, 0.5, **o),
        lambda **o: spectra.welch_psd(rows, ["recording_id"], "sample_idx", 256, n, 0.5, 0.3, average="median", **o),
        lambda **o: spectra.multitaper_psd(rows, ["recording_id"], "sample_idx", 256, n, segment_length=1.0, **o),
    ):
        whole = {r["freq_idx"]: r["power"] for r in make().collect()}
        for options in ({"chunk": 1000}, {"chunk": 3333, "start": 501}):
            parts = {r["freq_idx"]: r["power"] for r in make(**options).collect()}
            assert whole.keys() == parts.keys() and all(abs(parts[k] - whole[k]) < 1e-12 + 1e-9 * whole[k] for k in whole)
    rows = rows.withColumn("value", F.when(F.col("sample_idx") != 9000, F.col("value")))
    assert {r["power"] for r in spectra.welch_psd(rows, ["recording_id"], "sample_idx", 256, n, 0.5, chunk=1000).collect()} == {None}


def test_a_ten_million_sample_channel_spreads_over_tasks(spark):
    n = 10_000_000
    rows = spark.range(n).select(F.lit("r").alias("recording_id"), (F.col("id") + 1).alias("sample_idx"), F.sin(F.col("id") * (2 * np.pi * 32 / 256)).alias("value"))
    out = spectra.welch_psd(rows, ["recording_id"], "sample_idx", 256, n, 2.0, start=1).collect()
    assert len(out) == 257 and max(out, key=lambda r: r["power"])["frequency"] == 32.0
    chunks = spectra.hopping_chunks(rows.where("sample_idx <= 200000"), ["recording_id"], "sample_idx", 512, 256, 255, 1)
    assert sorted(r["n"] for r in chunks.select(F.size("x").alias("n")).collect())[-1] == 254 * 256 + 512


def test_segment_rows(spark):
    rows = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("value"))
    got = {r["chunk"]: r["x"] for r in spectra.hopping_chunks(rows, ["k"], "i", 4, 2).collect()}
    assert [got[s] for s in range(4)] == [[s * 2.0 + j for j in range(4)] for s in range(4)]
    gaps = {r["chunk"]: r["x"] for r in spectra.hopping_chunks(rows, ["k"], "i", 2, 3).collect()}
    assert gaps == {0: [0.0, 1.0], 1: [3.0, 4.0], 2: [6.0, 7.0], 3: [9.0]}


@pytest.mark.parametrize("block", [1, 3, 7, 65_536])
def test_triggers_across_blocks(spark, block):
    raw = np.random.default_rng(block).choice([0, 0, 3, 5, 65_536 + 5], 400)
    status = spark.createDataFrame([(f"r{i // 200}", i % 200 + 1, int(v)) for i, v in enumerate(raw)], "recording_id string, sample_idx long, raw long")
    got = [(r["recording_id"], r["event_seq"], r["onset"], r["type"]) for r in triggers.decode_triggers(status, 64, block).orderBy("recording_id", "onset").collect()]
    want = []
    for rec in (0, 1):
        code = raw[rec * 200 : rec * 200 + 200] & 0xFFFF
        at = [i for i in range(1, 200) if code[i] and code[i] != code[i - 1]]
        want += [(f"r{rec}", k, i + 1, int(code[i])) for k, i in enumerate(at, 1)]
    assert got == want


@pytest.mark.parametrize("block", [16, 4096])
def test_covariance_of_blocks(spark, block):
    """Against numpy, with large offsets, and with samples that lack a channel."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 150)) @ np.diag(np.ones(150)) + np.array([[1e5], [0], [-3e4], [7]])
    rows = [("r", c + 1, i + 1, float(x[c, i])) for c in range(4) for i in range(150) if not (c == 3 and i % 5 == 0)]
    got = {(r["ch_a"], r["ch_b"]): r["cov"] for r in ica.covariance(spark.createDataFrame(rows, "recording_id string, ch_idx int, sample_idx long, value double"), block).collect()}
    assert len(got) == 10
    for (a, b), v in got.items():
        use = [i for i in range(150) if not (4 in (a, b) and i % 5 == 0)]
        assert abs(v - np.cov(x[a - 1, use], x[b - 1, use])[0, 1]) < 1e-6


def test_fir_blocks_need_no_lengths(spark):
    """Two exchanges at most, and every block size and end gives the whole channel's values."""
    rng = np.random.default_rng(6)
    taps = filters.bandpass_taps(64.0, 4.0, 16.0)
    half = len(taps)
    sizes = [5, half, 2 * half, 2 * half + 1, 4 * half + half // 2 - 1, 6 * half]
    rows = [(f"r{k}", 1, "Cz", i + 1, i / 64, float(v)) for k, n in enumerate(sizes) for i, v in enumerate(rng.normal(size=n))]
    s = spark.createDataFrame(rows, "recording_id string, ch_idx int, channel string, sample_idx long, t double, value double")
    for zero in (True, False):
        whole = {(r[0], r[1]): r[2] for r in filters.fir_filter(s, taps, zero_phase=zero, block=None).select("recording_id", "sample_idx", "value").collect()}
        done = filters.fir_filter(s, taps, zero_phase=zero, block=2 * half)
        parts = {(r[0], r[1]): r[2] for r in done.select("recording_id", "sample_idx", "value").collect()}
        assert whole.keys() == parts.keys() and max(abs(whole[k] - parts[k]) for k in whole) < 1e-9
        assert done._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2


def test_tapers_of_a_long_trace():
    v, c = kernels.dpss(4096, 4, 7)
    assert np.abs(v @ v.T - np.eye(7)).max() < 1e-12 and (np.diff(c) < 0).all() and c[0] > 0.9999999
    i = np.arange(4096)
    one = np.sin(2 * np.pi * 4 / 4096 * np.subtract.outer(i[::512], i)) / (np.pi * np.where(np.subtract.outer(i[::512], i) == 0, 1, np.subtract.outer(i[::512], i)))
    one[np.subtract.outer(i[::512], i) == 0] = 8 / 4096
    assert np.abs(one @ v.T - c * v[:, ::512].T).max() < 1e-9  # rows of the concentration kernel


def test_maps_of_different_electrodes(spark):
    """Rows that lack a channel get their own weights; both equal a spline solved for that row alone."""
    names = ["Cz", "Fz", "Pz", "Oz", "T7", "T8"]
    m = channels.create_montage(spark.createDataFrame([(n,) for n in names], "channel string"))
    rows = [(k, n, float(i * k)) for k in (1, 2, 3) for i, n in enumerate(names)] + [(9, n, float(i)) for i, n in enumerate(names[:5])] + [(9, "T8", None)]
    out = topography.scalp_map(spark.createDataFrame(rows, "k int, channel string, value double"), m, 9, "k").toPandas().set_index(["k", "gx", "gy"])["value"]
    assert len(out) == 4 * 81 and np.allclose(out[2].fillna(0), 2 * out[1].fillna(0)) and not np.allclose(out[9].fillna(0), out[1].fillna(0))
    at = {r["channel"]: (r["x2d"], r["y2d"]) for r in channels.project_2d(m).collect()}
    weights = topography.map_weights(np.array([at[n] for n in names[:5]]), 9)
    assert np.allclose(weights @ np.arange(5), [out[(9, g % 9, g // 9)] for g in range(81)], equal_nan=True)


def test_header_report(spark):
    found = channels.lookup_electrodes(spark.createDataFrame([("r", n, i) for i, n in enumerate(["Cz", "Pz", "EXG1", "Status", "what"])], "recording_id string, channel string, ch_idx int"))
    out = {(r["section"], r["item"]): r for r in channels.channel_report(found, "ch_idx").collect()}
    total = out[("total", "all")]
    # the status line's system is the amplifier's, so it isn't counted as one; as before
    assert (total["n"], total["n_eeg"], total["n_external"], total["n_status"], total["names"]) == (5, 2, 1, 0, "Cz, Pz, EXG1, Status, what")
    assert out[("region", "Unknown")]["names"] == "what" and {k for k, _ in out} == {"total", "region", "position_type"}


def test_fixed_points_warn_when_they_stop_early():
    rng = np.random.default_rng(4)
    z = rng.laplace(size=(4000, 3))
    z = (z - z.mean(0)) / z.std(0)

    def moments(w):
        g = np.tanh(z @ w.T)
        return g.T @ z / len(z), (1 - g**2).mean(0)

    begin = rng.normal(size=(3, 3))
    for turn in (ica.turn_together, ica.turn_in_sequence):
        with pytest.warns(UserWarning, match="did not converge"):
            turn(moments, begin, 1, 1e-12)
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            w, rounds = turn(moments, begin, 500, 1e-4)
        assert rounds < 500 and np.allclose(w @ w.T, np.eye(3))


def test_time_slice_without_a_grid(spark):
    s = signal_of(spark, {"Cz": range(10), "Pz": range(10)}, 1000.0).where("not (channel = 'Pz' and sample_idx = 4)")
    cut = quality.time_slice(s, 2.5, 5.4)  # 2.5 is as near to 2 as to 3
    assert sorted({r["sample_idx"] for r in cut.collect()}) == [3, 4, 5, 6] and cut.count() == 7
    assert "distinct" not in (plan := s.sparkSession._jvm.PythonSQLUtils.explainString(cut._jdf.queryExecution(), "simple")) and plan.count("HashAggregate") <= 4


@pytest.mark.parametrize("fun", ["logcosh", "exp", "cube"])
def test_fixed_point_terms_tell_the_end_of_a_fit(spark, fun):
    """Near 0 where a fit has ended, for both algorithms, and not where it was stopped."""
    _, s = mixed(spark)
    names = ["Fp1", "Fp2", "Cz"]
    for algorithm in ("parallel", "deflation"):
        done = ica.fit_ica(s, names, n_components=2, max_iter=500, tol=1e-13, fun=fun, algorithm=algorithm, seed=1)
        terms = ica.fixed_point_terms(done, s, fun)
        residual = {r["component"]: r["residual"] for r in ica.fit_residual(terms, algorithm).collect()}
        assert set(residual) == {1, 2} and max(residual.values()) < 1e-5
        turned = ica.replace(done, unmixing=np.array([[np.cos(0.4), -np.sin(0.4)], [np.sin(0.4), np.cos(0.4)]]) @ done.unmixing)
        assert max(r["residual"] for r in ica.fit_residual(ica.fixed_point_terms(turned, s, fun), algorithm).collect()) > 1e-2
    # against numpy
    w, o = done.to_sources()
    y = np.stack([values_of(s, c) for c in names], 1) @ w.T + o
    g, slope = ica.contrast(y, fun)
    want = g.T @ y / len(y) - np.diag(slope.mean(0))
    assert all(abs(r["term"] - want[r["i"] - 1, r["j"] - 1]) < 1e-9 for r in terms.collect())
    with pytest.raises(ValueError):
        ica.fixed_point_terms(done, s, "tanh")


def test_sources_of_samples_with_gaps(spark):
    """A missing value counts as 0, a sample without a channel's row or without any value is left as it is."""
    model = ica.ICA(["Cz", "Pz"], np.ones(2), np.zeros(2), np.eye(2), np.ones(2), np.eye(2), ())
    s = signal_of(spark, {"Cz": [1, 2, None, 4], "Pz": [5, None, None, 8], "X": [1, 1, 1, 1]}).where("not (channel = 'Pz' and sample_idx = 4)")
    got = {(r["sample_idx"], r["component"]): r["value"] for r in ica.get_sources(model, s).collect()}
    assert got == {(1, "IC1"): 1, (1, "IC2"): 5, (2, "IC1"): 2, (2, "IC2"): 0}
    kept = ica.apply_ica(model, s)
    assert values_of(kept, "Cz") == [1, 2, None, 4] and values_of(kept, "X") == [1, 1, 1, 1]


def test_decimation_of_short_signals(spark):
    assert values_of(resample.decimate(signal_of(spark, {"Cz": [7.0]}), 2, 1.0), "Cz") == [7.0]


def test_events_of_anything(spark, tmp_path):
    from cortexframe.recording import events_of as found

    labels = ["Cz", "Status"]
    status = np.array([0, 0, 7, 7, 0, 9, 9, 0])
    path = write_bdf(tmp_path / "r.bdf", labels, np.stack([np.arange(8), status]), 4)
    want = [(3, 7), (6, 9)]
    pairs = lambda df: sorted((r["onset"], r["type"]) for r in df.collect())
    assert pairs(found(str(path), spark)) == pairs(found(path)) == pairs(found(str(tmp_path), spark)) == want
    whole = Recording.from_bdf(spark, str(path))
    assert pairs(found(whole)) == pairs(found(whole.events)) == want
    r = whole.import_table().first()
    assert (r["n_samples"], r["n_events"], r["types"], r["note"], r["file_path"]) == (8, 2, "7, 9", None, str(path))
    assert r["duration_sec"] == 7 / whole.sampling_rate and r["mean_interval"] == 3 / whole.sampling_rate
    for wrong in (123, None, {"a": 1}, spark.range(3)):
        with pytest.raises(TypeError):
            found(wrong, spark)
    with pytest.raises(FileNotFoundError):
        found(str(tmp_path / "nonexistent.bdf"), spark)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        found(str(tmp_path / "empty"), spark)
    with pytest.raises(ValueError):
        found(Recording.from_signal(signal_of(spark, {"Cz": [1, 2]}), 1.0))


def test_import_table_without_events(spark):
    r = Recording.from_signal(signal_of(spark, {"Cz": range(2560)}, 256.0), 256.0).import_table().first()
    assert (r["n_events"], r["n_types"], r["types"], r["note"], r["file_path"]) == (0, 0, None, "no events", "unknown")
    assert r["first_time"] is None and r["rate_hz"] is None and r["duration_sec"] == 2559 / 256
    one = events_of(spark, [1], [3], 256.0)
    many = events_of(spark, range(1, 13), range(1, 13), 256.0)
    lengths = spark.createDataFrame([("r", 100)], "recording_id string, n_samples long")
    r = triggers.import_table(one, lengths, 256.0).first()
    assert r["n_events"] == 1 and r["mean_interval"] is None and r["rate_hz"] is None and r["note"] is None
    assert triggers.import_table(many, lengths, 256.0).first()["types"] == "1 to 12"


def test_segments_of_samples_in_any_order():
    from cortexframe.streaming.spectra import ready_segments

    rng = np.random.default_rng(8)
    for size, step, lag in ((8, 4, 500), (5, 7, 500), (6, 1, 30), (4, 4, 0)):
        x = rng.normal(size=200)
        order = np.argsort(np.arange(200) + rng.uniform(0, lag / 2, 200)) if lag else np.arange(200)
        at, idx, values, got = 0, np.zeros(0, np.int64), np.zeros(0), {}
        for part in np.array_split(order, 9):
            again = part[:3]  # repeats of samples held or gone
            at, idx, values, ks, rows = ready_segments(at, np.concatenate([idx, part, again]), np.concatenate([values, x[part], x[again] + 9]), size, step, lag)
            assert not set(ks) & set(got) and len(idx) <= size + lag + len(part)
            got |= dict(zip(ks, rows, strict=True))
        want = {k: x[k * step : k * step + size] for k in range((200 - size) // step + 1)}
        assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    # a sample that never comes is waited for, then missing; empty segments are passed over
    gap = np.r_[0:10, 11:20, 100:120]
    at, idx, values, ks, rows = ready_segments(0, gap[:19], gap[:19] * 1.0, 4, 4, 12)
    assert ks == [0, 1] and at == 2 and idx[0] == 8
    at, idx, values, ks, rows = ready_segments(at, np.r_[idx, gap[19:]], np.r_[values, gap[19:]], 4, 4, 12)
    assert ks == [2, 3, 4, *range(25, 30)] and np.isnan(rows[0]).tolist() == [False, False, True, False] and not len(idx)
    assert ready_segments(at, np.r_[3], np.r_[1.0], 4, 4, 12)[3] == []  # too late


def test_stream_of_welch_segments_equals_the_batch(spark, tmp_path):
    from cortexframe.streaming.spectra import welch_segments

    rng = np.random.default_rng(9)
    schema = "recording_id string, channel string, sample_idx long, value double"
    rows = [(r, c, i + 1, float(v)) for r in "ab" for c in ("Cz", "Pz") for i, v in enumerate(rng.normal(size=150))]
    rows[200] = (*rows[200][:3], None)
    for part in np.array_split(rng.permutation(len(rows)), 4):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = welch_segments(files, 16.0).writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    segments = spark.table("segments")
    assert segments.select("segment").distinct().count() == (150 - 32) // 16 + 1 and segments.count() == segments.dropDuplicates(["recording_id", "channel", "segment", "freq_idx"]).count()
    lost = F.count("*") > F.count("power")
    mean = segments.groupBy("recording_id", "channel", "freq_idx", "frequency").agg(F.when(~lost, F.avg("power")).alias("p"))
    batch = spectra.welch_psd(spark.createDataFrame(rows, schema), ["recording_id", "channel"], "sample_idx", 16.0, 150)
    both = batch.join(mean, ["recording_id", "channel", "freq_idx", "frequency"]).collect()
    assert len(both) == 4 * 17 and sum(r["power"] is None for r in both) == 17
    assert all((r["power"] is None) == (r["p"] is None) and (r["p"] is None or abs(r["power"] - r["p"]) < 1e-12) for r in both)


def test_irregular_timing_at_its_limit(spark):
    """Intervals whose variation is 0.5 but for rounding, which SQL's sum in order of events puts above."""
    onsets = [3, 4, 6, 7, 11, 13, 15, 16, 19, 20, 21, 22, 26, 29, 31, 32, 35, 36, 38, 40, 41, 43, 45, 47, 49, 53]
    found = triggers.validation_issues(events_of(spark, [1, 2] * 13, onsets, 64))
    assert sorted(r["issue"] for r in found.collect()) == ["double_triggers", "irregular_timing"]


def test_epochs_are_cut_after_the_last_shuffle(spark):
    """No join or exchange sees the samples of trials, of which there are many times those of the signal."""
    s = signal_of(spark, {"Cz": list(range(40))}, 10)
    lengths = s.groupBy("recording_id").agg(F.max("sample_idx").alias("n_samples"))
    out = epochs.epoch_recording(s, events_of(spark, [1, 2], [10, 20], 10), lengths, epochs.Geometry(10, -0.5, 0.5), reject_threshold=50.0)
    plan = out.data._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join")[0].count("Generate") == 2
    failed = epochs.epoch_recording(s, events_of(spark, [1, 2], [10, 20], 10), lengths, epochs.Geometry(10, -0.5, 0.5), reject_threshold=5.0)
    assert failed.data.count() == 0 and [r["code"] for r in failed.log.orderBy("epoch_id").collect()] == ["amplitude"] * 2


#: values of a trial whose peak to peak is 150 or 60 but for rounding: added up backwards, the baseline's mean gives the other verdict
AT_LIMIT = {
    "high": ([67.89, 20.99, 134.23, 2.8, 19.62, 118.11, 43.03, 8.42, 52.76, 25.69, 0.3, 49.71, 61.2, 150.3, 14.73, 27.64, 73.25], {"reject_threshold": 150.0}, ["amplitude"]),
    "kept": ([132.51, 9.41, 11.36, 16.76, 34.66, 30.4, 0.86, 36.25, 45.32, 24.61, 11.31, 5.57, 68.15, 126.65, 150.86, 16.5, 4.97], {"reject_threshold": 150.0}, []),
    "window": ([19.62, 118.11, 43.03, 8.42, 52.76, 25.69, 0.3, 49.71, 61.2, 150.3, 14.73, 27.64, 73.25, 9.97, 9.57, 62.0, 16.11], {"reject_threshold": 150.0, "reject_window": (0.0, 0.1)}, ["amplitude"]),
    "flat": ([14.59, 5.97, 21.46, 48.78, 16.63, 53.21, 40.44, 6.15, 35.41, 32.49, 4.03, 27.4, 63.19, 45.1, 42.48, 46.07, 3.19], {"flat_threshold": 60.0}, ["flat"]),
}


@pytest.mark.parametrize("case", sorted(AT_LIMIT))
def test_trials_at_the_limit(spark, case):
    """Sums follow the samples, whatever the order of the rows."""
    x, options, codes = AT_LIMIT[case]
    span = (3, 10) if "reject_window" in options else (0, 16)

    def fails(first: list[float]) -> bool:
        total = 0.0
        for v in first:
            total += v
        p2p = (max(x[span[0] : span[1] + 1]) - total / 4) - (min(x[span[0] : span[1] + 1]) - total / 4)
        return p2p > options["reject_threshold"] if "reject_threshold" in options else p2p < options["flat_threshold"]

    assert fails(x[:4]) == bool(codes) and fails(x[3::-1]) != bool(codes)
    s = signal_of(spark, {"Cz": x}, 64)
    lengths = s.groupBy("recording_id").agg(F.max("sample_idx").alias("n_samples"))
    for rows in (s, s.orderBy(F.desc("sample_idx")), s.repartition(5, "value")):
        out = epochs.epoch_recording(rows, events_of(spark, [1], [4], 64), lengths, epochs.Geometry(64, -0.05, 0.2), baseline_window=(-0.05, 0.0), **options)
        assert [r["code"] for r in out.log.collect()] == codes and out.data.count() == (0 if codes else 17)


def test_epochs_of_gaps_and_repeats(spark):
    from cortexframe.operators import erp

    s = signal_of(spark, {"Cz": [float(i) for i in range(300)], "Pz": [1.0] * 300}, 10)
    s = s.where("not (channel = 'Cz' and sample_idx in (12, 131))").unionByName(s.where("channel = 'Pz' and sample_idx = 127"))
    lengths = s.groupBy("recording_id").agg(F.max("sample_idx").alias("n_samples"))
    out = epochs.epoch_recording(s, events_of(spark, [1, 1], [10, 125], 10), lengths, epochs.Geometry(10, -0.5, 0.8), baseline_window=(-0.5, -0.4))
    got = out.data.where("channel = 'Cz' and epoch_id = 2").orderBy("rel_idx").collect()
    assert [r["rel_idx"] for r in got] == [j for j in range(14) if j != 11] and [r["value"] for r in got] == [r["rel_idx"] - 0.5 for r in got]
    assert out.data.where("channel = 'Pz' and epoch_id = 2").count() == 15
    n = {(r["channel"], r["rel_idx"]): r["n_trials"] for r in erp.average_epochs(out.data).collect()}
    assert n["Pz", 7] == 2 and n["Cz", 7] == 1 and n["Cz", 11] == 1 and n["Cz", 3] == 2


def test_cleaning_needs_no_join(spark):
    model = ica.ICA(["Cz", "Pz"], np.ones(2), np.zeros(2), np.eye(2), np.ones(2), np.eye(2), (1,))
    s = signal_of(spark, {"Cz": [1, 2, None, 4], "Pz": [5, None, None, 8], "X": [1, 1, 1, 1]}).where("not (channel = 'Pz' and sample_idx = 4)")
    assert "Join" not in ica.apply_ica(model, s)._jdf.queryExecution().optimizedPlan().toString()
    both = {(r["sample_idx"], r["channel"]): (r["before"], r["after"]) for r in ica.before_and_after(model, s).collect()}
    kept = {(r["sample_idx"], r["channel"]): r["value"] for r in ica.apply_ica(model, s).collect()}
    assert {k: a for k, (_, a) in both.items()} == kept and len(kept) == 11
    assert both[2, "Cz"][0] == 2 and both[4, "Cz"] == (4, 4) and both[3, "Pz"] == (None, None) and both[1, "X"] == (1, 1)


def test_filter_gives_batches_of_bounded_size():
    import pyarrow as pa

    lists = pa.array([[0] * n for n in (3, 4, 9, 1, 1, 1)], pa.list_(pa.int64()))
    got = list(filters.pieces(pa.RecordBatch.from_arrays([lists], names=["x"]), 0, 7))
    assert [[len(r) for r in g.column(0).to_pylist()] for g in got] == [[3, 4], [9], [1, 1, 1]]
    assert list(filters.pieces(got[0].slice(0, 0), 0)) == []
