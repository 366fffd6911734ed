"""Reading 24-bit recordings as a Spark data source.

The driver only lists files with their sizes.  A file's records have one size, so each
partition reads the header and a range of records by its offset.  Files are reached through ``pyarrow.fs``, by path or URI of a store that
executors can reach too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.bdf_format import digital_to_physical, parse_header, unpack_int24

PARTITION_BYTES = 32 << 20
SAMPLES = "recording_id string, ch_idx int, channel string, sampling_rate double, sample_idx bigint, t double, value double"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: channels are read one by one where they are less than this share of a record
SPARSE = 0.25
SIGNAL_BLOCKS = "recording_id string, record_no bigint, ch_idx int, channel string, sampling_rate double, first_sample bigint, values array<double>"
HEADER = (
    "recording_id string, ch_idx int, channel string, transducer string, unit string, physical_min double, physical_max double, digital_min double, digital_max double, "
    "samples_per_record int, sampling_rate double, records bigint, record_duration double, start_date string, start_time string"
)


def _open(path: str):
    filesystem, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return filesystem, inner


def list_files(path: str) -> list[str]:
    """The ``.bdf`` files a path names: itself, or those in a directory."""
    return [f for f, _ in sized_files(path)]


def sized_files(path: str) -> list[tuple[str, int]]:
    filesystem, inner = _open(path)
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        if not inner.lower().endswith(".bdf"):
            raise ValueError(f"{path} isn't a .bdf file")
        return [(path, info.size)]
    prefix = path[: len(path) - len(inner)] if "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in filesystem.get_file_info(fs.FileSelector(inner)) if f.path.lower().endswith(".bdf"))


def read_header(path: str) -> dict:
    """Header fields; a count of records that the file doesn't give (-1) follows from its size."""
    filesystem, inner = _open(path)
    with filesystem.open_input_file(inner) as f:
        fixed = f.read(256)
        head = parse_header(fixed + f.read(256 * int(fixed[252:256].decode("latin-1").strip())))
        size = f.size()
    head["record_bytes"] = 3 * sum(c["samples"] for c in head["channel_list"])
    whole = (size - head["header_bytes"]) // head["record_bytes"]
    head["complete_records"] = whole
    if head["records"] < 0:
        head["records"] = whole
    return head


def recording_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def status_index(labels: list[str]) -> int:
    """Which channel is the status line: the one named so, else the last."""
    named = [i for i, label in enumerate(labels) if label.strip().lower() == "status"]
    return named[0] if named else len(labels) - 1


class Range(InputPartition):
    """The ``part``-th of ``parts`` equal shares of a file's records."""

    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class BdfSource(DataSource):
    """``format("bdf")``; options ``path``, ``partition_bytes``, ``chunk_records``, ``channels`` (a JSON list, read only those), ``status`` (true: only the status line)."""

    @classmethod
    def name(cls) -> str:
        return "bdf"

    def schema(self) -> str:
        return SIGNAL_BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return BdfReader(self.options)


class BdfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.chunk = int(options.get("chunk_records", 100))
        self.channels = json.loads(options["channels"]) if options.get("channels") else None
        self.status = options.get("status", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        out = []
        for path, size in sized_files(self.path):
            parts = max(1, -(-size // self.bytes))
            out += [Range(path, k, parts) for k in range(parts)]
        return out

    def wanted(self, head: dict) -> tuple[list[int], int]:
        """Places of the channels to read, and of the status line."""
        listed = head["channel_list"]
        at_status = status_index([c["label"] for c in listed])
        if self.status:
            return [at_status], at_status
        return [i for i, c in enumerate(listed) if self.channels is None or c["label"] in self.channels], at_status

    def blocks(self, path: str, head: dict, first: int, stop: int, wanted: list[int], at_status: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """``record, records, channel, values, missing`` for each ``chunk_records`` records and wanted channel; samples that a cut file lacks are missing.

        The status line is read with its bits, not scaled, whether or not it is named so.
        """
        listed = head["channel_list"]
        starts = np.cumsum([0, *(c["samples"] for c in listed)])
        few = sum(listed[i]["samples"] for i in wanted) < SPARSE * starts[-1]
        filesystem, inner = _open(path)
        with filesystem.open_input_file(inner) as f:
            for a in range(first, stop, self.chunk):
                n = min(self.chunk, stop - a)
                at = head["header_bytes"] + a * head["record_bytes"]
                grid, missing = np.zeros((n, starts[-1]), np.int32), np.ones((n, starts[-1]), bool)
                if few:
                    for r in range(n):
                        for i in wanted:
                            own = unpack_int24(_read_at(f, at + r * head["record_bytes"] + 3 * int(starts[i]), 3 * listed[i]["samples"]))
                            grid[r, starts[i] : starts[i] + len(own)], missing[r, starts[i] : starts[i] + len(own)] = own, False
                else:
                    digital = unpack_int24(_read_at(f, at, n * head["record_bytes"]))
                    grid.ravel()[: len(digital)], missing.ravel()[: len(digital)] = digital, False
                for i in wanted:
                    c = listed[i]
                    own = grid[:, starts[i] : starts[i + 1]].astype(np.float64)
                    own = own if i == at_status else digital_to_physical(own, c["digital_min"], c["physical_min"], c["physical_max"])
                    yield a, n, i, own.ravel(), missing[:, starts[i] : starts[i + 1]].ravel()

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """A batch for each ``chunk_records`` records and channel."""
        head = read_header(part.path)
        first, stop = (head["records"] * k // part.parts for k in (part.part, part.part + 1))
        for a, n, i, own, missing in self.blocks(part.path, head, first, stop, *self.wanted(head)):
            c = head["channel_list"][i]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * c["samples"], pa.int32()), pa.array(own, mask=missing))
            fixed = (recording_name(part.path), i + 1, c["label"], c["samples"] / head["duration"])
            name, index, label, rate = (pa.repeat(pa.scalar(v, t), n) for v, t in zip(fixed, (pa.string(), pa.int32(), pa.string(), pa.float64()), strict=True))
            record = np.arange(a, a + n)
            cols = [name, pa.array(record), index, label, rate, pa.array(record * c["samples"] + 1), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["recording_id", "record_no", "ch_idx", "channel", "sampling_rate", "first_sample", "values"])


def _read_at(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


class BdfSampleSource(DataSource):
    """``format("bdf_samples")``: a row a sample, with the options of ``bdf``.

    Comparisons of ``channel`` and ``recording_id`` with values, and of ``sample_idx`` with
    bounds, reach the reader: files, channels and records that can't match aren't read.
    """

    @classmethod
    def name(cls) -> str:
        return "bdf_samples"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return BdfSampleReader(self.options)


class BdfSampleReader(BdfReader):
    def __init__(self, options):
        super().__init__(options)
        self.sets: dict[str, set] = {}
        self.low, self.high = 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("channel", "recording_id") and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sets[name] = self.sets.get(name, values) & values
            elif name == "sample_idx" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
            else:
                yield f

    def partitions(self) -> list[Range]:
        named = self.sets.get("recording_id")
        return [p for p in super().partitions() if named is None or recording_name(p.path) in named]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """A batch for each ``chunk_records`` records and channel, of the samples asked for."""
        head = read_header(part.path)
        listed, named = head["channel_list"], self.sets.get("channel")
        wanted, at_status = self.wanted(head)
        wanted = [i for i in wanted if named is None or listed[i]["label"] in named]
        if not wanted:
            return
        first, stop = (head["records"] * k // part.parts for k in (part.part, part.part + 1))
        first = max(first, min((self.low - 1) // listed[i]["samples"] for i in wanted))
        if self.high is not None:
            stop = min(stop, max((self.high - 1) // listed[i]["samples"] for i in wanted) + 1)
        for a, _, i, own, missing in self.blocks(part.path, head, first, stop, wanted, at_status):
            c = listed[i]
            idx = a * c["samples"] + 1 + np.arange(len(own))
            keep = (idx >= self.low) & (idx <= (self.high if self.high is not None else idx[-1]))
            idx, values, rate = idx[keep], pa.array(own[keep], mask=missing[keep]), c["samples"] / head["duration"]
            fixed = ((recording_name(part.path), pa.string()), (i + 1, pa.int32()), (c["label"], pa.string()), (rate, pa.float64()))
            cols = [*[pa.repeat(pa.scalar(v, t), len(idx)) for v, t in fixed], pa.array(idx), pa.array((idx - 1) / rate), values]
            yield pa.RecordBatch.from_arrays(cols, names=["recording_id", "ch_idx", "channel", "sampling_rate", "sample_idx", "t", "value"])


class BdfHeaderSource(DataSource):
    """``format("bdf_header")``: one row a channel."""

    @classmethod
    def name(cls) -> str:
        return "bdf_header"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema) -> DataSourceReader:
        return BdfHeaderReader(self.options)


class BdfHeaderReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[Range]:
        return [Range(p, 0, 1) for p in list_files(self.path)]

    def read(self, part: Range) -> Iterator[tuple]:
        head = read_header(part.path)
        for i, c in enumerate(head["channel_list"]):
            yield (
                recording_name(part.path), i + 1, c["label"], c["transducer"], c["unit"], c["physical_min"], c["physical_max"], c["digital_min"], c["digital_max"],
                c["samples"], c["samples"] / head["duration"], head["records"], head["duration"], head["date"], head["time"],
            )


def register(spark: SparkSession) -> None:
    """The formats ``bdf``, ``bdf_samples`` and ``bdf_header``.

    Filters reach sources written in Python only where the session allows it, which this
    turns on; no other kind of source is touched by it.
    """
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(BdfSource)
    spark.dataSource.register(BdfSampleSource)
    spark.dataSource.register(BdfHeaderSource)


def read_bdf(spark: SparkSession, path: str, channels: list[str] | None = None, chunk_records: int = 100, status: bool = False) -> DataFrame:
    """The signal table of a file or a directory of files; each channel keeps its own rate.

    Filters of ``channel``, ``recording_id`` and ``sample_idx`` on it reach the files.

    ``status`` reads only each file's status line; it is found in the header, so it
    does not matter which channels are asked for.
    """
    register(spark)
    reader = spark.read.format("bdf_samples").option("path", path).option("chunk_records", chunk_records).option("status", str(status).lower())
    samples = (reader.option("channels", json.dumps(channels)) if channels is not None else reader).load()
    return samples.select("recording_id", "ch_idx", "channel", "sample_idx", "t", "value")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """``recording_id, sample_idx, raw, sampling_rate`` of each file's status line."""
    register(spark)
    blocks = spark.read.format("bdf").option("path", path).option("status", "true").load()
    laid = blocks.select("recording_id", "sampling_rate", "first_sample", F.posexplode("values").alias("_i", "value")).where("value is not null")
    return laid.select("recording_id", (F.col("first_sample") + F.col("_i")).alias("sample_idx"), F.col("value").cast("long").alias("raw"), "sampling_rate")


def status_channels(header: DataFrame) -> DataFrame:
    """``recording_id, ch_idx`` of each recording's status line, from the header table."""
    named = F.lower(F.trim("channel")) == "status"
    rank = F.struct(named.cast("int"), F.when(named, -F.col("ch_idx")).otherwise(F.col("ch_idx")))
    return header.groupBy("recording_id").agg(F.max_by("ch_idx", rank).alias("ch_idx"))


def read_bdf_header(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("bdf_header").option("path", path).load()


def scan_channels(spark: SparkSession, path: str) -> DataFrame:
    """A file's channels and what they are: ``recording_id, ch_idx, channel, position_type, region, standard_system``."""
    from ..operators.channels import lookup_electrodes

    found = lookup_electrodes(read_bdf_header(spark, path))
    return found.select("recording_id", "ch_idx", "channel", "sampling_rate", "position_type", "region", "standard_system")


def write_events_csv(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").option("header", True).csv(path)
