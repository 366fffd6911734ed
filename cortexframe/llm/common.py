"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    Read from the session; a folder of this machine is set only where the
    session names none and driver and executors are one process, as in local tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but runs the plan once only, and the
    table survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote, once nothing that is still to run reads them."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: rows of an Arrow batch and of a vector read from Parquet, so that long texts don't add up
BATCH_ROWS, BATCH_BYTES, VECTOR_ROWS = 500, 16 << 20, 512


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES``, vectors of the Parquet reader to ``VECTOR_ROWS``, unless the session sets its own bounds.

    A vector of 4,096 texts is a single array of many megabytes for each task, which fragments an executor's heap.
    """
    arrow = "spark.sql.execution.arrow"
    for name, bound in ((f"{arrow}.maxRecordsPerBatch", BATCH_ROWS), (f"{arrow}.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", VECTOR_ROWS)):
        if spark.conf.get(name, None) is None:  # not set by anyone
            spark.conf.set(name, str(bound))


def give_back() -> None:
    """Return unused memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every platform
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: what tasks leave in this process for later tasks of their kind
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """``make()``, held by this process until a task that doesn't keep ``name`` begins."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def let_go(keeps: str | None) -> None:
    """Drop all that is kept under other names than ``keeps``."""
    others = [name for name in _kept if name != keeps]
    for name in others:
        del _kept[name]
    if others:
        give_back()


def frugal(run, keeps: str | None = None):
    """A task that gives memory back when it ends, as Python workers live on between tasks.

    Workers take turns, so what one kind of task keeps would soon be in all of them and
    stay through later steps: when a task begins, all goes but what it ``keeps``.
    """

    def task(batches: Iterator) -> Iterator:
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(col: str, mod: int):
    """crc32 of a column's text, modulo ``mod``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def pack_texts(docs: DataFrame, keep: list[str], to: str = "z") -> DataFrame:
    """``keep`` columns and ``to``: texts as Zstandard frames, to be shuffled; null stays null."""
    narrow = docs.select(*keep, "text")
    schema = StructType([narrow.schema[c] for c in keep]).add(to, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                z = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(z, pa.binary())], names=schema.names)

    return narrow.mapInArrow(frugal(run), schema)


#: bits of a filter of ids at most: 32 MB are broadcast
FILTER_BITS = 28


def id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of ``ids(id)`` as words of 64 bits, and the power of two of its bits: 16 an id, ``2**FILTER_BITS`` at most."""
    bits = min(FILTER_BITS, max(10, (16 * ids.count()).bit_length()))
    places = ids.select(F.explode(F.array(*_places("id", bits))).alias("p"))
    set_ = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return words, bits


def _places(column: str, bits: int) -> list:
    return [F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << bits)) for seed in (1, 2)]


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, h, z`` of the rows of ``docs(doc_id, text)`` whose doc_id is in ``ids(id)``, one for each text of an id.

    ``z`` is the text as a Zstandard frame, ``h`` its hash.  A Bloom filter of the ids, of
    bounded size, keeps nearly all other texts out of the shuffle; the join is exact.
    """
    ids = materialize(ids, "wanted-ids")
    words, bits = id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    named = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    narrow = named.select("id", F.xxhash64("text").alias("h"), *[p.alias(f"p{i}") for i, p in enumerate(_places("id", bits))], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5).compress
        for batch in batches:
            maybe = np.ones(batch.num_rows, bool)
            for k in (2, 3):
                p = batch.column(k).to_numpy()
                maybe &= (shared.value[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            part = batch.filter(pa.array(maybe))
            z = [squeeze(t.encode("utf-8", "surrogatepass")) for t in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], names=["id", "h", "z"])

    bounded_batches(docs.sparkSession)
    return narrow.mapInArrow(frugal(run), "id long, h long, z binary").hint("merge").join(ids, "id", "left_semi").dropDuplicates(["id", "h"])


def unpack_texts(z: list[bytes | None]) -> list[bytes | None]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [None if x is None else open_(x) for x in z]


#: a vertex with fewer edges than this is never hot
HOT_EDGES = 100_000


def _least_of(edges: DataFrame, key: str, least: DataFrame, total: int) -> DataFrame:
    """``edges(u, v)`` with ``m`` of ``least(key, m, degree)`` by their ``key``.

    Vertices with so many edges that there can be at most ``HOT_EDGES`` of them are
    broadcast, so that no task has all edges of a hub; the others are joined.
    """
    bound = max(HOT_EDGES, -(-2 * total // HOT_EDGES))
    if 2 * total < bound:  # no vertex can have so many
        return edges.join(least.select(key, "m"), key).select("u", "v", "m")
    hot = F.broadcast(least.where(F.col("degree") >= bound).select(key, F.col("m").alias("_hot")))
    rest = least.where(F.col("degree") < bound).select(key, "m")
    marked = edges.join(hot, key, "left")
    return marked.where("_hot is not null").select("u", "v", F.col("_hot").alias("m")).unionByName(marked.where("_hot is null").join(rest, key).select("u", "v", "m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``.

    Alternating large-star / small-star contraction (Kiveris et al., 2014): each
    round links every vertex to the least neighbour it knows, and the number of
    rounds grows with the logarithm of the longest chain.  Rounds are joins and
    groupings over edges; only a changed-or-not sum reaches the driver.  The
    component is the least id reachable.  An empty input gives an empty output.
    """
    e = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    e = materialize(e, "cc-edges")
    before = None
    total = e.count()
    for _ in range(max_rounds):
        # large star: every neighbour u above v goes to v's least neighbour (or v)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = _least_of(e.select("u", "v"), "v", least, total).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every neighbour not above u, and u, go to the least of them
        small_min = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = _least_of(large, "u", small_min, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(small_min.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
