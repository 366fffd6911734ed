"""Electrodes, channel types, names, montages."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_RADIUS = 87.54

# The 64 scalp electrodes in the order of amplifier inputs A1-A32, B1-B32,
# with inclination and azimuth in degrees.
SCALP = """
Fp1 -92 -72
AF7 -92 -54
AF3 -74 -65
F1 -50 -68
F3 -60 -51
F5 -75 -41
F7 -92 -36
FT7 -92 -18
FC5 -72 -21
FC3 -50 -28
FC1 -32 -45
C1 -23 0
C3 -46 0
C5 -69 0
T7 -92 0
TP7 -92 18
CP5 -72 21
CP3 -50 28
CP1 -32 45
P1 -50 68
P3 -60 51
P5 -75 41
P7 -92 36
P9 -115 36
PO7 -92 54
PO3 -74 65
O1 -92 72
Iz 115 -90
Oz 92 -90
POz 69 -90
Pz 46 -90
CPz 23 -90
Fpz 92 90
Fp2 92 72
AF8 92 54
AF4 74 65
AFz 69 90
Fz 46 90
F2 50 68
F4 60 51
F6 75 41
F8 92 36
FT8 92 18
FC6 72 21
FC4 50 28
FC2 32 45
FCz 23 90
Cz 0 0
C2 23 0
C4 46 0
C6 69 0
T8 92 0
TP8 92 -18
CP6 72 -21
CP4 50 -28
CP2 32 -45
P2 50 -68
P4 60 -51
P6 75 -41
P8 92 -36
P10 115 -36
PO8 92 -54
PO4 74 -65
O2 92 -72
"""
# The electrodes of the 10-20 system; all others are of the 10-10 system.
TEN_TWENTY = "Fp1 F3 F7 C3 T7 P3 P7 O1 Oz Pz Fpz Fp2 Fz F4 F8 Cz C4 T8 P4 P8 O2".split()
# Kind of position by the letters of a name.
KINDS = {
    "Fp": "Prefrontal", "AF": "Anterior Frontal", "F": "Frontal", "FT": "Fronto-Temporal", "FC": "Fronto-Central", "C": "Central", "T": "Temporal",
    "TP": "Centro-Temporal", "CP": "Centro-Parietal", "P": "Parietal", "PO": "Parieto-Occipital", "O": "Occipital", "I": "Occipital",
}
# Accessory inputs and their kinds.
ACCESSORIES = {
    **{f"EXG{i}": "External" for i in range(1, 9)}, "GSR1": "GSR", "GSR2": "GSR", "Erg1": "Ergo/AUX", "Erg2": "Ergo/AUX",
    "Resp": "Respiration", "Plet": "Plethysmograph", "Temp": "Temperature", "Status": "Status/Metadata",
}
EXTERNAL_KINDS = ["External", "GSR", "Ergo/AUX", "Respiration", "Plethysmograph", "Temperature"]
# Names of positions, in the order of the tables above.
POSITION_NAMES = {
    "Fp1": "Prefrontal left",
    "AF7": "Anterior frontal left",
    "AF3": "Anterior frontal left-center",
    "F1": "Frontal left-midline",
    "F3": "Frontal left",
    "F5": "Frontal left-center",
    "F7": "Frontal left temporal",
    "FT7": "Fronto-temporal left",
    "FC5": "Fronto-central left",
    "FC3": "Fronto-central left-center",
    "FC1": "Fronto-central left-midline",
    "C1": "Central left-midline",
    "C3": "Central left",
    "C5": "Central left",
    "T7": "Temporal left",
    "TP7": "Centro-temporal left",
    "CP5": "Centro-parietal left",
    "CP3": "Centro-parietal left-center",
    "CP1": "Centro-parietal left-midline",
    "P1": "Parietal left-midline",
    "P3": "Parietal left",
    "P5": "Parietal left-center",
    "P7": "Parietal left temporal",
    "P9": "Parietal left ear",
    "PO7": "Parieto-occipital left",
    "PO3": "Parieto-occipital left-center",
    "O1": "Occipital left",
    "Iz": "Inion",
    "Oz": "Occipital midline",
    "POz": "Parieto-occipital midline",
    "Pz": "Parietal midline",
    "CPz": "Centro-parietal midline",
    "Fpz": "Prefrontal midline",
    "Fp2": "Prefrontal right",
    "AF8": "Anterior frontal right",
    "AF4": "Anterior frontal right-center",
    "AFz": "Anterior frontal midline",
    "Fz": "Frontal midline",
    "F2": "Frontal right-midline",
    "F4": "Frontal right",
    "F6": "Frontal right-center",
    "F8": "Frontal right temporal",
    "FT8": "Fronto-temporal right",
    "FC6": "Fronto-central right",
    "FC4": "Fronto-central right-center",
    "FC2": "Fronto-central right-midline",
    "FCz": "Fronto-central midline",
    "Cz": "Central midline",
    "C2": "Central right-midline",
    "C4": "Central right",
    "C6": "Central right",
    "T8": "Temporal right",
    "TP8": "Centro-temporal right",
    "CP6": "Centro-parietal right",
    "CP4": "Centro-parietal right-center",
    "CP2": "Centro-parietal right-midline",
    "P2": "Parietal right-midline",
    "P4": "Parietal right",
    "P6": "Parietal right-center",
    "P8": "Parietal right temporal",
    "P10": "Parietal right ear",
    "PO8": "Parieto-occipital right",
    "PO4": "Parieto-occipital right-center",
    "O2": "Occipital right",
    "EXG1": "External electrode 1 (EOG/ECG/EMG/GSR)",
    "EXG2": "External electrode 2 (EOG/ECG/EMG/GSR)",
    "EXG3": "External electrode 3 (EOG/ECG/EMG/GSR)",
    "EXG4": "External electrode 4 (EOG/ECG/EMG/GSR)",
    "EXG5": "External electrode 5 (EOG/ECG/EMG/GSR)",
    "EXG6": "External electrode 6 (EOG/ECG/EMG/GSR)",
    "EXG7": "External electrode 7 (EOG/ECG/EMG/GSR)",
    "EXG8": "External electrode 8 (EOG/ECG/EMG/GSR)",
    "GSR1": "Galvanic skin response channel 1 (electrodermal activity/arousal)",
    "GSR2": "Galvanic skin response channel 2 (electrodermal activity/arousal)",
    "Erg1": "Ergo/AUX input 1 (Response Switch/Photocell/Microphone)",
    "Erg2": "Ergo/AUX input 2 (Response Switch/Photocell/Microphone)",
    "Resp": "Respiration belt (breathing rate/pattern measurement)",
    "Plet": "Plethysmograph (blood volume/pulse measurement)",
    "Temp": "Temperature sensor (body temperature measurement)",
    "Status": "Status channel (event markers/triggers)",
}
# An original port name in parentheses, as renaming leaves it.
PORT = r"(?i)\((EXG[1-8]|GSR[1-2]|Plet|Temp|Resp|Erg[1-2])\)"
# Regions by the start of a name; later rules win.
REGIONS = [
    (r"^Fp|^AF|^F[^CT]", "Frontal"),
    (r"^C|^FC", "Central"),
    (r"^P[^O]|^CP", "Parietal"),
    (r"^O|^PO|^Iz", "Occipital"),
    (r"^T[0-9]|^FT|^TP", "Temporal"),
]


def region(name: str) -> str:
    found = [r for pattern, r in REGIONS if re.match(pattern, name)]
    return found[-1] if found else "Other"


def electrode_rows() -> list[tuple]:
    """All electrodes and accessories, one row each; coordinates follow from the angles."""
    rows = []
    for i, line in enumerate(SCALP.split("\n")[1:-1]):
        name, theta, phi = line.split()
        theta, phi = float(theta), float(phi)
        a, b = math.radians(theta), math.radians(phi)
        xyz = [float(round(v)) + 0.0 for v in (HEAD_RADIUS * math.sin(a) * math.cos(b), HEAD_RADIUS * math.sin(a) * math.sin(b), HEAD_RADIUS * math.cos(a))]
        kind = KINDS[re.match(r"[A-Za-z]+?(?=z|\d)", name)[0]]
        system = "10-20" if name in TEN_TWENTY else "10-10"
        rows.append((name, f"{'AB'[i // 32]}{i % 32 + 1}", POSITION_NAMES[name], kind, region(name), system, *xyz, theta, phi, HEAD_RADIUS))
    for name, kind in ACCESSORIES.items():
        where = "Metadata" if name == "Status" else "External"
        rows.append((name, None, POSITION_NAMES[name], kind, where, "BioSemi", *[None] * 6))
    return rows


ELECTRODE_DDL = (
    "standard_name string, biosemi_name string, position_name string, position_type string, region string, standard_system string, "
    "x double, y double, z double, theta double, phi double, radius double"
)


def electrodes(spark: SparkSession) -> DataFrame:
    """The electrode table: 80 rows."""
    return spark.createDataFrame(electrode_rows(), ELECTRODE_DDL)


def electrode_keys(spark: SparkSession) -> DataFrame:
    """The table under lower-case keys, standard and amplifier names."""
    table = electrodes(spark)
    names = F.array_compact(F.array(F.lower("standard_name"), F.lower("biosemi_name")))
    return table.withColumn("key", F.explode(names))


def lookup_electrodes(channels: DataFrame, name: str = "channel") -> DataFrame:
    """``channels`` with the electrode's columns; unknown names get "Unknown" and null coordinates.

    Names are trimmed and their case doesn't matter.
    """
    keys = electrode_keys(channels.sparkSession)  # fixed, small
    joined = channels.join(F.broadcast(keys), F.lower(F.trim(name)) == F.col("key"), "left").drop("key")
    for c in ("position_name", "position_type", "region", "standard_system"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit("Unknown")))
    return joined


def channel_type(name: Column, position_type: Column) -> Column:
    return (
        F.when(F.lower(F.trim(name)) == "status", "status")
        .when(position_type.isin(EXTERNAL_KINDS) | F.trim(name).rlike(PORT), "external")
        .otherwise("eeg")
    )


def pick_channels(signal: DataFrame, picks: list[str] | list[int] | None) -> DataFrame:
    """Rows of the channels named, or numbered from 1; None takes all.  Unknown ones are an error."""
    if picks is None:
        return signal
    by = "ch_idx" if all(isinstance(p, int) for p in picks) else "channel"
    chosen = signal.where(F.col(by).isin(list(picks)))
    found = {r[0] for r in chosen.select(by).distinct().collect()}  # at most as many as picks
    missing = [p for p in picks if p not in found]
    if missing:
        raise ValueError(f"no such channels: {missing}")
    return chosen


def classify_channels(channels: DataFrame, name: str = "channel") -> DataFrame:
    """``channels`` with ``channel_type``: eeg, external or status."""
    found = lookup_electrodes(channels, name)
    return found.select(*channels.columns, channel_type(F.col(name), F.col("position_type")).alias("channel_type"))


def external_channels(channels: DataFrame, name: str = "channel") -> DataFrame:
    return classify_channels(channels, name).where("channel_type = 'external'")


def rename_channels(df: DataFrame, labels: dict[str, str], keep_original: bool = True, name: str = "channel") -> DataFrame:
    """Channels named as ``label (original)``, or as ``label``; the label "Unlabeled" changes nothing."""
    labels = {k: v for k, v in labels.items() if v != "Unlabeled"}
    bad = [v for v in labels.values() if not re.fullmatch(r"[A-Za-z0-9_ -]+", v)]
    if bad:
        raise ValueError(f"labels may hold letters, digits, spaces, _ and - only: {bad}")
    if not labels:
        return df
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    label = F.try_element_at(table, F.col(name))
    new = F.concat(label, F.lit(" ("), F.col(name), F.lit(")")) if keep_original else label
    return df.withColumn(name, F.coalesce(new, F.col(name)))


def naming_system(channels: DataFrame, name: str = "channel", by: str = "recording_id") -> DataFrame:
    """Per recording: counts of standard, amplifier, external and unknown names, ``naming_system`` and ``confidence``."""
    found = lookup_electrodes(channels, name)
    amplifier = F.trim(name).rlike("(?i)^[ab][0-9]+$")
    scalp = F.col("standard_system").isin("10-20", "10-10")
    external = (F.col("standard_system") == "BioSemi") | F.trim(name).rlike(PORT)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    by_ = found.groupBy(by).agg(
        F.count("*").alias("n_channels"),
        count(scalp & ~amplifier).alias("n_standard"),
        count(scalp & amplifier).alias("n_biosemi"),
        count(external & ~scalp).alias("n_external"),
        count(~scalp & ~external).alias("n_unknown"),
    )
    rest = F.greatest(F.lit(1), F.col("n_channels") - F.col("n_external"))
    system = (
        F.when(F.expr("n_standard > 0 and n_biosemi = 0 and n_unknown = 0"), "10-20/10-10")
        .when(F.expr("n_biosemi > 0 and n_standard = 0 and n_unknown = 0"), "BioSemi_AB")
        .when(F.expr("n_standard > 0 and n_biosemi > 0"), "Mixed")
        .otherwise("Unknown")
    )
    share = (
        F.when(system == "10-20/10-10", F.col("n_standard"))
        .when(system == "BioSemi_AB", F.col("n_biosemi"))
        .when(system == "Mixed", F.greatest("n_standard", "n_biosemi"))
        .when(F.col("n_unknown") > 0, rest - F.col("n_unknown"))
        .otherwise(0)
    )
    return by_.withColumn("naming_system", system).withColumn("confidence", share / rest)


def naming_details(channels: DataFrame, name: str = "channel") -> DataFrame:
    """Each channel's ``system_category`` and ``standard_equivalent``."""
    found = lookup_electrodes(channels, name)
    scalp = F.col("standard_system").isin("10-20", "10-10")
    amplifier = F.trim(name).rlike("(?i)^[ab][0-9]+$")
    category = F.when(scalp & amplifier, "BioSemi_AB").when(scalp, "Standard_10-20/10-10").when(F.col("standard_system") == "BioSemi", "External").otherwise("Unknown")
    return found.select(*channels.columns, category.alias("system_category"), F.when(scalp, F.col("standard_name")).alias("standard_equivalent"))


def inspect_channels(channels: DataFrame, name: str = "channel") -> DataFrame:
    """``position_type, region, standard_system`` counts of a file's channels."""
    return lookup_electrodes(channels, name).groupBy("position_type", "region", "standard_system").agg(
        F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_list(name))).alias("names")
    )


def create_montage(channels: DataFrame, name: str = "channel") -> DataFrame:
    """Positions of the channels that have any, one row a name."""
    found = lookup_electrodes(channels.select(name).distinct(), name).where("x is not null")
    return found.select(F.col(name).alias("channel"), "x", "y", "z", "theta", "phi", "radius")


def set_montage(channels: DataFrame, montage: DataFrame) -> DataFrame:
    """EEG channels of ``channels(channel, channel_type, ...)`` with their positions; others are left out."""
    return channels.where("channel_type = 'eeg'").join(montage, "channel")


def unplaced_channels(values: DataFrame, montage: DataFrame, by: str = "channel") -> DataFrame:
    """Channels of ``values`` that the montage has no position for, once each, with how many rows each has."""
    return values.join(montage.select(F.col("channel").alias(by)), by, "left_anti").groupBy(by).agg(F.count("*").alias("n_values"))


def spherical_to_cartesian(angles: DataFrame, radius: float = HEAD_RADIUS) -> DataFrame:
    """Whole millimetres from inclination and azimuth in degrees."""
    a, b, r = F.radians("theta"), F.radians("phi"), F.lit(radius)
    return (
        angles.withColumn("x", F.rint(r * F.sin(a) * F.cos(b)) + 0.0).withColumn("y", F.rint(r * F.sin(a) * F.sin(b)) + 0.0).withColumn("z", F.rint(r * F.cos(a)) + 0.0)
    )


def region_of(name: Column) -> Column:
    out = F.lit("Other")
    for pattern, value in REGIONS:
        out = F.when(name.rlike(pattern), F.lit(value)).otherwise(out)
    return out


SCALP_REGIONS = ("Parietal", "Frontal", "Central", "Temporal", "Occipital")


def channel_report(found: DataFrame, order: str) -> DataFrame:
    """The header report of recordings, from ``found(recording_id, channel, position_type, region, standard_system, order)``.

    ``recording_id, section, item, n, n_eeg, n_external, n_reference, n_status, names``: a row
    for the recording (section ``total``), for each region and for each position type, in
    one pass over grouping sets; names are in order of the channels.
    """
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sets = [["recording_id", "region"], ["recording_id", "position_type"], ["recording_id"]]
    kinds = found.select(*["recording_id", "channel", order], *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("position_type", "region", "standard_system")])
    kinds = kinds.withColumn("_region", F.col("region"))  # grouping sets blank the column that they group by
    by = kinds.groupingSets(sets, "recording_id", "region", "position_type").agg(
        F.grouping("region").alias("_no_region"), F.grouping("position_type").alias("_no_type"), F.count("*").alias("n"),
        count(F.col("_region").isin(*SCALP_REGIONS)).alias("n_eeg"), count(F.col("_region") == "External").alias("n_external"),
        count(F.col("_region") == "Reference").alias("n_reference"), count(F.col("standard_system") == "Status").alias("n_status"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "channel"))), lambda s: s["channel"]), ", ").alias("names"),
    )
    section = F.when(F.col("_no_region") == 0, "region").when(F.col("_no_type") == 0, "position_type").otherwise("total")
    return by.select("recording_id", section.alias("section"), F.coalesce("region", "position_type", F.lit("all")).alias("item"), "n", "n_eeg", "n_external", "n_reference", "n_status", "names")


def project_2d(montage: DataFrame) -> DataFrame:
    """Azimuthal-equidistant head positions: adds ``x2d, y2d``."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    elevation, azimuth = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / r))), F.atan2("y", "x")
    return montage.withColumn("x2d", elevation * F.cos(azimuth)).withColumn("y2d", elevation * F.sin(azimuth))
