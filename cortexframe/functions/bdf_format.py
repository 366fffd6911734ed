"""The 24-bit recording format: samples and headers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: bytes of the fixed header's fields, and of each channel's
FIXED_FIELDS = (("magic", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("header_bytes", 8), ("version", 44), ("records", 8), ("duration", 8), ("channels", 4))
CHANNEL_FIELDS = (
    ("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32),
)


def int24(low: Column, mid: Column, high: Column) -> Column:
    """Signed value of three little-endian bytes."""
    raw = low + F.shiftleft(mid.cast("int"), 8) + F.shiftleft(high.cast("int"), 16)
    return F.when(raw >= 1 << 23, raw - (1 << 24)).otherwise(raw)


def unpack_int24(raw: bytes) -> np.ndarray:
    """Signed values of whole triplets; a cut one at the end is left out."""
    b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
    v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return np.where(v >= 1 << 23, v - (1 << 24), v)


def pack_int24(values: np.ndarray) -> bytes:
    v = np.asarray(values, np.int64) & 0xFFFFFF
    return np.stack([v & 255, v >> 8 & 255, v >> 16 & 255], 1).astype(np.uint8).tobytes()


def digital_to_physical(digital, digital_min: float, physical_min: float, physical_max: float):
    """A column or an array in physical units; the digital range is taken as symmetric."""
    gain = (physical_max - physical_min) / (-2.0 * digital_min)
    return digital * gain + (physical_min - gain * digital_min)


def parse_header(data: bytes) -> dict:
    """Fields of a header; ``channel_list`` has a dict for each channel."""
    at, fixed = 0, {}
    for name, size in FIXED_FIELDS:
        fixed[name] = data[at : at + size]
        at += size
    text = {k: v.decode("latin-1").strip() for k, v in fixed.items() if k != "magic"}
    n = int(text["channels"])
    if len(data) < 256 * (n + 1):
        raise ValueError("the header is cut")
    columns = {}
    for name, size in CHANNEL_FIELDS:
        columns[name] = [data[at + i * size : at + (i + 1) * size].decode("latin-1").strip() for i in range(n)]
        at += n * size
    numbers = ("physical_min", "physical_max", "digital_min", "digital_max")
    rows = [{k: (float(v[i]) if k in numbers else int(v[i]) if k == "samples" else v[i]) for k, v in columns.items()} for i in range(n)]
    return {
        "patient": text["patient"], "recording": text["recording"], "date": text["date"], "time": text["time"], "header_bytes": int(text["header_bytes"]), "version": text["version"],
        "records": int(text["records"]), "duration": float(text["duration"]), "channels": n, "channel_list": rows,
    }


def build_file(labels: list[str], records: list[list[np.ndarray]], samples: list[int], duration: float = 1.0, declared: int | None = None, digital_min: int = -8388608, physical: float = 262144.0) -> bytes:
    """A file of digital values: ``records[r][c]`` holds channel c's samples of record r."""
    n = len(labels)
    field = lambda v, size: str(v).ljust(size)[:size].encode("latin-1")
    out = b"\xffBIOSEMI" + field("", 80) + field("", 80) + field("01.01.20", 8) + field("12.00.00", 8) + field(256 * (n + 1), 8) + field("24BIT", 44)
    out += field(len(records) if declared is None else declared, 8) + field(duration, 8) + field(n, 4)
    per = {"label": labels, "physical_min": [-physical] * n, "physical_max": [physical] * n, "digital_min": [digital_min] * n, "digital_max": [-digital_min - 1] * n, "samples": samples}
    for name, size in CHANNEL_FIELDS:
        for i in range(n):
            v = per[name][i] if name in per else ""
            out += field(int(v) if isinstance(v, float) and v == int(v) else v, size)
    return out + b"".join(pack_int24(c) for r in records for c in r)
