"""Schemas of the canonical tables, as DDL."""

RECORDINGS = "recording_id string, sampling_rate double, n_samples bigint, duration_sec double, reference string, metadata map<string,string>, history array<string>"
CHANNELS = "recording_id string, ch_idx int, channel string, channel_type string"
SIGNAL = "recording_id string, ch_idx int, channel string, sample_idx bigint, t double, value double"
STATUS = "recording_id string, sample_idx bigint, raw bigint"
EVENTS = "recording_id string, event_seq bigint, onset bigint, onset_time double, type int, description string"
EPOCHS = "recording_id string, epoch_id bigint, type int, onset bigint, channel string, ch_idx int, rel_idx int, t double, value double"
REJECTIONS = "recording_id string, epoch_id bigint, event_type int, event_time double, channel string, code string, reason string"
EVOKED = "recording_id string, condition string, channel string, rel_idx int, t double, value double, se double, n_trials bigint"
SPECTRUM = "recording_id string, condition string, epoch_id bigint, channel string, freq_idx int, frequency double, power double, amplitude double, phase double"
MONTAGE = "channel string, x double, y double, z double, theta double, phi double, radius double"
