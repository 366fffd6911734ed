"""Removing repeated passages by bucket-pointer refinement of suffixes.

A byte is removed when a string of ``min_bytes`` bytes around it also starts in a
document with a smaller doc_id.  Positions are suffixes, sorted only as deep as
that length:

1. Initial buckets of q-grams over the whole corpus (q just over half the length).  Of
   the q-grams inside a window of ``min_bytes`` only the one with the least hash names
   the window, so equal windows fall in equal buckets and one position in thirteen is
   looked at.  Buckets of a single document are final: nothing in them repeats.
2. In buckets that are left, runs of windows with one name whose text is equal are
   folded into one run of the least document, which settles all other members.
3. What is left of a bucket is refined by bucket pointers (:func:`bucket_pointers`):
   positions are sorted by their first eight bytes, a bucket's pointer being its place
   in that order; then each bucket is sorted by the pointers of the positions ``d``
   later, which makes buckets of depth ``2 d``, whose pointers are used in the next
   round, up to ``min_bytes``.  Buckets of one document take no part in later rounds.

Level 1 exchanges sorted, packed blocks of (bucket, document).  A bucket shared
inside one task's block is settled there and sent on as one summary, so a line that
a third of all documents share costs one entry a block; runs equal within a block of
level 2 are settled likewise.  Levels 2 and 3 are groupings and joins.  In buckets with
very many runs, which no task could sort, windows are rows grouped over the cluster by
the identifiers of the q-gram they start with and of the one ``min_bytes - q`` later.
Texts are compressed and shuffled once, by doc_id; every step that needs them
reads that exchange, and whole copies leave before the first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import bounded_batches, documents, frugal, materialize, pack_texts, unpack_texts

MIN_BYTES = 50
KEY_BITS = 48
#: window names that a task settles together, about; bytes of packed texts that it names together
PART_NAMES, NAMED_BYTES = 250_000, 1_000_000
P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept by each worker for the longest text so far."""
    if len(_powers[0]) < n:
        for at, base in enumerate((P, P_INV)):
            steps = np.full(n + n // 2, base)
            steps[0] = 1
            _powers[at] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xCA9B0B1B0E0C6D2B)
    return h ^ (h >> np.uint64(29))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * P**i; the hash of any range is a difference of two."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def gram(length: int) -> int:
    return length // 2 + 1


def window_names(data: np.ndarray, length: int, sums: np.ndarray | None = None) -> np.ndarray:
    """For each start of a window of ``length`` bytes, the least q-gram hash inside it."""
    q = gram(length)
    if len(data) < length:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data) if sums is None else sums
    n = len(data) - q + 1
    least = mix((sums[q:] - sums[:-q]) * powers(n)[1])
    w, size, out = length - q + 1, 1, len(data) - length + 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:out], least[w - size : w - size + out])


def _planes(values: np.ndarray, planes: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:planes]).tobytes()


def _unplanes(raw: np.ndarray, planes: int) -> np.ndarray:
    n = len(raw) // planes
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = raw.reshape(planes, n).T
    return out.reshape(-1).view("<u8")


def encode_block(keys: np.ndarray, docs: np.ndarray, flags: np.ndarray) -> bytes:
    """Keys in ascending order, documents, flags, as byte planes, which compress well."""
    base = int(docs.min())
    return base.to_bytes(8, "little", signed=True) + _planes(np.diff(keys, prepend=np.uint64(0)), 6) + _planes((docs - base).astype(np.uint64), 8) + flags.astype(np.uint8).tobytes()


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = int.from_bytes(block[:8], "little", signed=True)
    raw = np.frombuffer(block, np.uint8, offset=8)
    n = len(raw) // 15
    return np.cumsum(_unplanes(raw[: 6 * n], 6)), _unplanes(raw[6 * n : 14 * n], 8).astype(np.int64) + base, raw[14 * n :].astype(bool)


def _frames(z: pa.Array) -> pa.Array:
    """The packed texts of a column, beside which rows may be carried."""
    return z.field(0) if pa.types.is_struct(z.type) else z


def _unpacked(z: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", np.uint8) for x in unpack_texts(_frames(z).to_pylist())]


def shared_names(base: DataFrame, length: int, total_bytes: int) -> DataFrame:
    """``doc_id, keys``: of each document the window names that another document has too.

    ``base(doc_id, z)`` holds no two copies of a text.
    """
    q = gram(length)
    bits = max(8, math.ceil(math.log2(max(1, total_bytes / (length - q + 1) * 2 / PART_NAMES))))
    parts = 1 << bits

    def emit(ids: list[int], texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        keys, docs = [], []
        with np.errstate(over="ignore"):
            for d, data in zip(ids, _unpacked(pa.array(texts, pa.binary())), strict=True):
                names = window_names(data, length)
                if len(names):
                    k = np.unique(names[np.append(True, names[1:] != names[:-1])] >> np.uint64(64 - KEY_BITS))
                    keys.append(k), docs.append(np.full(len(k), d, np.int64))
        if not keys:
            return
        k, d = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        several = d[first] != d[np.append(first[1:], len(k)) - 1]
        part, block = [], []
        one_k, one_d = k[first], d[first]
        edges = np.searchsorted(one_k >> np.uint64(KEY_BITS - bits), np.arange(parts + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(edges)):
            s = slice(edges[p], edges[p + 1])
            part.append(int(p)), block.append(encode_block(one_k[s], one_d[s], several[s]))
        known = np.repeat(several, np.diff(np.append(first, len(k))))
        if known.any():  # settled here; passes through a group of its own
            part.append(parts + int(min(ids)) % parts), block.append(encode_block(k[known], d[known], np.zeros(known.sum(), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(block, pa.binary())], names=["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), _frames(batch.column(1)).to_pylist(), strict=True):
                ids.append(d), texts.append(t)
                held += len(t or b"")
                if held > NAMED_BYTES:
                    yield from emit(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield from emit(ids, texts)

    def settle(table: pa.Table) -> pa.Table:
        got = [decode_block(b) for b in table.column("block").to_pylist()]
        k, d, known = (np.concatenate([g[i] for g in got]) for i in range(3))
        if table.column("part")[0].as_py() < parts:
            order = np.lexsort((d, k))
            k, d, known = k[order], d[order], known[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            n = np.diff(np.append(first, len(k)))
            several = (d[first] != d[first + n - 1]) | np.logical_or.reduceat(known, first)
            stay = np.repeat(several, n) & ~known
            k, d = k[stay], d[stay]
        return pa.table({"doc_id": pa.array(d, pa.int64()), "key": pa.array(k.astype(np.int64))})

    blocks = base.select("doc_id", "z").mapInArrow(frugal(run), "part long, block binary")
    return blocks.groupBy("part").applyInArrow(settle, "doc_id long, key long").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def segments(named: DataFrame, length: int) -> DataFrame:
    """Runs of windows with one shared name: ``key, ctx, doc_id, v, s, n, settled`` from ``named(doc_id, v, z, keys)``.

    ``settled`` runs are equal to one of a smaller document in the same block; those that
    follow each other are one row, and their key is their document's, a negative number, so
    that they spread.  Which runs are settled depends on the blocks, and so on how rows were
    dealt: open and settled runs must be taken from one evaluation.  The least document of a
    key and ctx is open in any.
    """
    w = length - gram(length) + 1
    names = ["key", "ctx", "doc_id", "v", "s", "n", "settled"]

    def block(parts: list[tuple]) -> pa.RecordBatch:
        key, ctx, d, v, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((d, ctx, key))
        k, c, o = key[order], ctx[order], d[order]
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        settled = np.empty(len(k), bool)
        settled[order] = o != np.repeat(o[first], np.diff(np.append(first, len(k))))
        # runs come in text order
        follows = settled[1:] & settled[:-1] & (d[1:] == d[:-1]) & (v[1:] == v[:-1]) & (s[1:] == s[:-1] + n[:-1])
        head = np.flatnonzero(np.append(True, ~follows))
        n = np.add.reduceat(n, head)
        key, ctx = np.where(settled, -1 - (d & np.int64((1 << 62) - 1)), key), np.where(settled, 0, ctx)
        return pa.RecordBatch.from_arrays([pa.array(x[head]) for x in (key, ctx, d, v, s.astype(np.int32))] + [pa.array(n.astype(np.int32)), pa.array(settled[head])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for d, v, data, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _unpacked(part.column(2)), part.column(3), strict=True):
                    if len(data) < length:
                        continue
                    with np.errstate(over="ignore"):
                        sums = prefix_sums(data)
                        named_ = window_names(data, length, sums)
                        edge = np.flatnonzero(np.append(True, named_[1:] != named_[:-1]))
                        sizes = np.diff(np.append(edge, len(named_)))
                        if sizes.max() > w:  # periodic text: cut long runs
                            many = -(-sizes // w)
                            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                            edge = np.repeat(edge, many) + inner * w
                            sizes = np.diff(np.append(edge, len(named_)))
                        key = (named_[edge] >> np.uint64(64 - KEY_BITS)).astype(np.int64)
                        stay = np.isin(key, wanted.values.to_numpy())
                        s, n, key = edge[stay], sizes[stay], key[stay]
                        ctx = range_hash(sums, s, s + n + length - 1).view(np.int64)
                    parts.append((key, ctx, np.full(len(s), d, np.int64), np.full(len(s), v, np.int64), s, n))
                    held += len(s)
                if held > 150_000:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return named.select("doc_id", "v", "z", "keys").mapInArrow(frugal(run), "key long, ctx long, doc_id long, v long, s int, n int, settled boolean")


def contents(wanted: DataFrame, length: int) -> DataFrame:
    """``key, ctx, m, bytes`` of the runs listed in ``wanted(doc_id, v, z, runs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for d, v, data, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _unpacked(part.column(2)), part.column(3).to_pylist(), strict=True):
                    raw = data.tobytes()
                    rows += [(r["key"], r["ctx"], d, raw[r["s"] : r["s"] + r["n"] + length - 1]) for r in runs if r["v"] == v and r["s"] + r["n"] + length - 1 <= len(raw)]  # a null text may stand beside
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["key", "ctx", "m", "bytes"])

    return wanted.select("doc_id", "v", "z", "runs").mapInArrow(frugal(run), "key long, ctx long, m long, bytes binary")


def bucket_pointers(blobs: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of several runs: owner, place in it, and the pointer of the window's bucket.

    Windows have one pointer if they are equal; those that no other document's window
    equals may have one in common with others of their document.
    """
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], np.int64)
    owner = np.repeat(np.arange(len(blobs)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes to the run's end
    doc = docs[owner]
    depth = min(8, length)
    value = np.zeros(len(data), np.uint64)
    for k in range(depth):
        value[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (depth - 1 - k))
    at = np.flatnonzero(room >= depth)
    key, bucket = value[at], np.zeros(len(at), np.int64)
    pointer = np.zeros(len(data), np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        at, key, bucket = at[order], key[order], bucket[order]
        first, n = _runs(key)
        # the bucket's place in the order before this round, and the sub-bucket's within it
        within = np.repeat(*_runs(bucket))
        pointer[at] = bucket + np.repeat(first, n) - within
        low, high = np.minimum.reduceat(doc[at], first), np.maximum.reduceat(doc[at], first)
        open_ = np.repeat(low < high, n)
        step = min(depth, length - depth)
        at = at[open_ & (room[at] >= depth + step)]
        if not step or not len(at):
            break
        bucket = pointer[at]
        key = bucket.astype(np.uint64) << np.uint64(32) | pointer[at + step].astype(np.uint64)
        depth += step
    window = np.flatnonzero(room >= length)
    return owner[window], window - (np.cumsum(sizes) - sizes)[owner[window]], pointer[window]


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one value start, and how long they are."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return first, np.diff(np.append(first, len(ordered)))


def _windows(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of several runs: owner, place in it, and the two bucket identifiers that cover it."""
    q = gram(length)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], np.int64)
    with np.errstate(over="ignore"):
        sums = prefix_sums(data)
        grams = mix((sums[q:] - sums[:-q]) * powers(len(data) - q + 1)[1])
    n = sizes - length + 1
    owner = np.repeat(np.arange(len(blobs)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + place
    return owner, place, grams[at], grams[at + length - q]


def _bitmap(places: np.ndarray) -> bytes:
    bits = np.zeros(int(places.max()) + 1, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def refine_sorted(length: int):
    """Task for rows sorted by key: windows of a bucket whose equals have a lesser document, as bitmaps."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        key, ctx, least, blobs = zip(*rows, strict=True)
        docs = np.array(least, np.int64)
        owner, place, pointer = bucket_pointers(list(blobs), docs, length)
        m = docs[owner]
        best = np.full(int(pointer.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, pointer, m)
        beaten = m > best[pointer]
        own, at = owner[beaten], place[beaten]
        by = np.lexsort((at, own))
        own, at = own[by], at[by]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        bits = [_bitmap(x) for x in np.split(at, cut[1:])] if len(own) else []
        who = own[cut]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[i] for i in who], pa.int64()), pa.array([ctx[i] for i in who], pa.int64()), pa.array(bits, pa.binary())], names=["key", "ctx", "hits"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(rows) < 4000:
                continue
            last = rows[-1][0]
            split = len(rows)
            while split and rows[split - 1][0] == last:
                split -= 1
            for a in _cuts(rows, split):
                yield settle(rows[a[0] : a[1]])
            rows = rows[split:]
        for a in _cuts(rows, len(rows)):
            yield settle(rows[a[0] : a[1]])

    def _cuts(rows: list[tuple], end: int, size: int = 4000) -> list[tuple[int, int]]:
        """Ranges of about ``size`` rows that do not cut a key."""
        out, start = [], 0
        while start < end:
            stop = min(end, start + size)
            while stop < end and rows[stop][0] == rows[stop - 1][0]:
                stop += 1
            out.append((start, stop))
            start = stop
        return out

    return run


def _refine_hot(hot: DataFrame, length: int) -> DataFrame:
    """The same for buckets with very many sub-buckets: windows are rows, grouped over the cluster."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                owner, place, one, two = _windows(part.column(3).to_pylist(), length)
                take = [part.column(i).take(pa.array(owner)) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*take, pa.array(place.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["key", "ctx", "m", "place", "one", "two"]
                )

    rows = hot.select("key", "ctx", "m", "bytes").mapInArrow(frugal(explode), "key long, ctx long, m long, place int, one long, two long")
    least = rows.groupBy("key", "one", "two").agg(F.min("m").alias("least"))
    beaten = rows.join(least, ["key", "one", "two"]).where("m > least").groupBy("key", "ctx").agg(F.collect_list("place").alias("places"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_bitmap(np.array(p)) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["key", "ctx", "hits"])

    return beaten.mapInArrow(frugal(bitmaps), "key long, ctx long, hits binary")


def covered(n_bytes: int, runs: pa.Array | None, hits: list[dict] | None, length: int) -> np.ndarray:
    """Mask of removed bytes, from whole runs (start and number of windows in one long) and bitmaps of windows."""
    edge = np.zeros(n_bytes + 1, np.int64)
    both = runs.to_numpy() if runs is not None else np.zeros(0, np.int64)
    starts, stops = [both >> 32], [(both >> 32) + (both & 0xFFFFFFFF) + length - 1]
    for h in hits or ():
        at = h["s"] + np.flatnonzero(np.unpackbits(np.frombuffer(h["hits"], np.uint8), bitorder="little"))
        starts.append(at), stops.append(at + length)
    np.add.at(edge, np.minimum(np.concatenate(starts), n_bytes), 1)
    np.add.at(edge, np.minimum(np.concatenate(stops), n_bytes), -1)
    return np.cumsum(edge[:-1]) > 0


def kept_text(data: np.ndarray, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes are removed; cut characters stay whole."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(start):
        return ""
    whole = np.logical_and.reduceat(gone, start)
    return data[~np.repeat(whole, np.diff(np.append(start, len(data))))].tobytes().decode("utf-8", "surrogatepass")


def repeated_passages(docs: DataFrame, min_bytes: int = MIN_BYTES, hot_bucket: int = 5000, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    ``with_text`` adds ``kept_text``, whose characters are whole: one of which some bytes are
    covered stays; null for a null text.  Columns named in ``carry`` go along with the texts
    and come back in the struct ``row``, so that no join has to bring them to their text again.

    Null and empty texts and texts under ``min_bytes`` (8 at least) lose nothing; texts of
    any length are read whole.  Rows with a null doc_id neither remove nor lose anything;
    rows repeating one doc_id do not remove from each other, and each loses what its own
    text shares with smaller doc_ids.  Whole texts that a smaller doc_id has too go whole.
    Other columns are left out.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    length = min_bytes
    hashed = F.xxhash64("text").alias("h")
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row)
    known = docs.where("doc_id is not null")
    sizes = materialize(known.select("doc_id", hashed, F.octet_length("text").cast("long").alias("n_bytes"), F.substring(F.unhex(F.sha2(F.col("text"), 256)), 1, 16).alias("sha")), "suffix-sizes")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    # texts of a doc_id that has several are told apart by v, a hash; for all others v is 0
    several = sizes.groupBy("doc_id").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).where("lo <> hi").select("doc_id", F.lit(True).alias("several"))
    several = materialize(several, "suffix-several")
    v = F.when(F.col("several"), F.col("h").bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long").alias("v")
    sizes = sizes.where(F.col("n_bytes") >= length)
    firsts = sizes.groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = sizes.hint("merge").join(firsts, "sha").where("doc_id > first").hint("merge").join(several, "doc_id", "left").select("doc_id", v, "n_bytes")
    copies = materialize(copies, "suffix-copies")
    # one exchange of all texts; the filters keep its plan the same wherever it is read, and all joins are by doc_id alone
    # rows carried along are in one struct with the text, which Python alone opens: nothing prunes them below the exchange
    z = F.struct("z", "row").alias("z") if carry else F.col("z")
    also = ["row"] if carry else []
    packed = pack_texts(known.select("*", hashed), ["doc_id", "h", *also]).select("doc_id", "h", z)
    exchanged = packed.where("doc_id is not null").repartition("doc_id")
    texts = exchanged.hint("merge").join(several, "doc_id", "left").select("doc_id", v, "z")
    # not an anti-join, which would be pushed below the exchange and make it another one
    marked = texts.hint("merge").join(copies.groupBy("doc_id").agg(F.collect_set("v").alias("copied")), "doc_id", "left")
    shared = shared_names(marked.where(F.coalesce(~F.array_contains("copied", F.col("v")), F.lit(True))), length, total)
    runs = segments(texts.hint("merge").join(shared, "doc_id"), length)
    # the filters that later joins would push down are written here, so that all read one exchange
    present = "key is not null and ctx is not null and doc_id is not null"
    runs = runs.where(present).select("key", "ctx", "doc_id", "v", "s", "n", "settled").repartition("key", "ctx")
    subs = runs.groupBy("key", "ctx").agg(F.min(F.when(~F.col("settled"), F.struct("doc_id", "v", "s", "n"))).alias("f"))
    # counting f, which settled runs don't have, keeps all columns below, and with them one exchange of the runs
    counts = subs.groupBy("key").agg(F.count("f").alias("subs")).where("subs > 1")
    mixed = subs.hint("merge").join(counts, "key").select("key", "ctx", "subs", "f.doc_id", "f.v", "f.s", "f.n")

    def bytes_of(part: DataFrame) -> DataFrame:
        lists = part.groupBy("doc_id").agg(F.collect_list(F.struct("key", "ctx", "v", "s", "n")).alias("runs"))
        return contents(texts.hint("merge").join(lists, "doc_id"), length)

    plain = bytes_of(mixed.where(F.col("subs") <= hot_bucket)).repartition("key").sortWithinPartitions("key")
    hits = plain.mapInArrow(frugal(refine_sorted(length)), "key long, ctx long, hits binary")
    hits = hits.unionByName(_refine_hot(bytes_of(mixed.where(F.col("subs") > hot_bucket)), length))
    judged = subs.select("key", "ctx", F.col("f.doc_id").alias("m")).hint("merge").join(hits, ["key", "ctx"], "left")
    whole_run = "settled or doc_id > m"
    found = runs.hint("merge").join(judged, ["key", "ctx"], "left").where(f"{whole_run} or hits is not null")
    whole = (F.col("s").cast("long") * F.lit(1 << 32) + F.col("n")).alias("run")
    no_hits = F.lit(None).cast("struct<s:int,hits:binary>").alias("hit")
    found = found.select(
        "doc_id", "v", F.when(F.expr(whole_run), whole).alias("run"), F.when(F.col("doc_id") == F.col("m"), F.struct("s", "hits")).alias("hit")
    )
    found = found.unionByName(copies.select("doc_id", "v", (F.col("n_bytes") - length + 1).alias("run"), no_hits))
    one = F.col("v") == 0
    spans = found.groupBy("doc_id").agg(
        F.collect_list(F.when(one, F.col("run"))).alias("runs"), F.collect_list(F.when(one, F.col("hit"))).alias("hits"), F.collect_list(F.when(~one, F.struct("v", "run", "hit"))).alias("others")
    )
    joined = texts.hint("merge").join(spans, "doc_id", "left").select("doc_id", "v", "z", "runs", "hits", "others")
    nameless = pack_texts(docs.where("doc_id is null"), ["doc_id", *also]).select("doc_id", z)
    joined = joined.unionByName(nameless, allowMissingColumns=True)

    schema = StructType()
    for name in ("doc_id", "n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, LongType())
    schema = schema.add("kept_sha256", StringType())
    if with_text:
        schema = schema.add("kept_text", StringType())
    if carry:
        schema = schema.add("row", docs.schema["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, left = [], []
                packed_ = _frames(part.column(2))
                for version, known_, data, whole_runs, hit_runs, others in zip(part.column(1).to_pylist(), packed_.is_valid().to_pylist(), _unpacked(packed_), part.column(3), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    whole_runs = whole_runs.values
                    if version:
                        own = [x for x in others or () if x["v"] == version]
                        whole_runs = pa.array([x["run"] for x in own if x["run"] is not None], pa.int64())
                        hit_runs = [x["hit"] for x in own if x["hit"] is not None]
                    gone = covered(len(data), whole_runs, hit_runs, length)
                    rises = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                    rows.append((len(data), int(gone.sum()), rises, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
                    if with_text:
                        left.append(kept_text(data, gone) if known_ else None)
                columns = [part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True))]
                columns += [pa.array(left, pa.string())] if with_text else []
                columns += [part.column(2).field(1)] if carry else []
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(frugal(run), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))
