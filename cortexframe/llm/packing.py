"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens in one tokenizing pass,
written once.  Only the number of pieces of each length (``capacity`` numbers)
reaches the driver, which plans there: lengths, pairs and triples of lengths are
indexed by their sum (:class:`SumIndex`), the longest length left is taken, and the
index gives the combination that fills its gap exactly under the counts available;
where there is none, the longest length that fits goes in and the rest is looked up
again.  A plan line says "this pattern of lengths, n times", so the work does not
depend on how many pieces there are.  Each piece then finds its place from its rank
among pieces of its length; ranks are taken within salted groups, so that a common
length is spread.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, documents, frugal, kept, materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 2
KNOWN_BITS = 20
#: characters outside these are cut by the pattern itself
OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]")
SPACE, LETTER, DIGIT, REST = range(4)
CLASS = np.array([SPACE if chr(i).isspace() else LETTER if chr(i).isalpha() else DIGIT if chr(i).isdecimal() else REST for i in range(0x2028)], np.uint8)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces start in texts laid end to end.

    ``first`` marks each text's first character.  Pieces are runs of letters, of digits
    or of other signs, with a space before; contractions after an apostrophe that starts
    a piece; white space but for its last character, and that one if it isn't a space.
    """
    n = len(codes)
    kind = CLASS[codes]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.append(first[1:], True)  # of a text
    white = kind == SPACE
    ends = white & ~last
    ends[:-1] &= ~white[1:]  # a run's last white space, with something after it
    start |= ends
    glued = np.zeros(n, bool)
    glued[1:] = (ends & (codes == 32))[:-1]
    start &= ~glued
    quote = np.flatnonzero(start & (codes == 39) & ~last)
    if len(quote):
        one = codes[quote + 1]
        inside = quote + 2 < n
        two = np.where(inside & ~last[quote + 1], codes[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after] = True
    return np.flatnonzero(start)


class PieceTokenizer:
    """Ids as ``tokenizers`` gives them by default, asking it once for each distinct piece.

    A byte-level BPE never merges across the pieces its pattern cuts a text into, so
    ids of pieces can be kept and put together.  Pieces are cut, hashed and looked up
    as arrays; a hit counts only if the kept piece has the same characters.  Texts
    that the pattern cuts otherwise, that hold a special token's string, or of which
    a piece shares its hash with another go to the library whole.  The store is
    emptied when it is half full; texts with more distinct pieces than that are
    taken in smaller groups, and one alone that has more goes to the library.
    """

    def __init__(self, path: str, known_bits: int = KNOWN_BITS):
        self.inner = Tokenizer.from_file(path)
        strings = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.known_bits = known_bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.known_bits
        self.keys, self.at, self.size = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.letters_at, self.n_letters = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.ids, self.used, self.entries = np.zeros(size, np.uint32), 0, 0
        self.letters, self.letters_used = np.zeros(4 * size, np.uint32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or the negative of the free slot where its probe ended, less one."""
        mask = (1 << self.known_bits) - 1
        slot = (h >> np.uint64(64 - self.known_bits)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            key = self.keys[slot[open_]]
            free = key == 0
            slot[open_[free]] = -slot[open_[free]] - 1
            open_ = open_[~free & (key != h[open_])]
            slot[open_] = (slot[open_] + 1) & mask
        return slot

    def add(self, hashes: list[int], pieces: list[str]) -> None:
        """Keep new pieces, at most half as many as there are slots."""
        mask = (1 << self.known_bits) - 1
        letters = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters = _room(self.letters, self.letters_used + len(letters))
        self.letters[self.letters_used : self.letters_used + len(letters)] = letters
        for h, piece, got in zip(hashes, pieces, self.inner.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            ids = got.ids
            slot = h >> (64 - self.known_bits)
            while self.keys[slot]:
                slot = (slot + 1) & mask
            self.ids = _room(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.keys[slot], self.at[slot], self.size[slot] = h, self.used, len(ids)
            self.letters_at[slot], self.n_letters[slot] = self.letters_used, len(piece)
            self.used += len(ids)
            self.letters_used += len(piece)
        self.entries += len(pieces)

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(codes), bool)
        first[(ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]] = True
        start = piece_starts(codes, first)
        stop = np.append(start[1:], len(codes))
        with np.errstate(over="ignore"):
            up, down = powers(len(codes) + 1)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
            h = (sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * PRIME
            h = (h ^ (h >> np.uint64(29))) | np.uint64(1)
        slot = self.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            half = 1 << (self.known_bits - 1)
            new, at = np.unique(h[missing], return_index=True)
            if self.entries + len(new) > half:
                self.clear()
                missing = np.arange(len(h))
                new, at = np.unique(h, return_index=True)
            if len(new) > half and len(texts) > 1:
                middle = len(texts) // 2
                return self.encode_plain(texts[:middle]) + self.encode_plain(texts[middle:])
            if len(new) > half:
                return self.encode_whole(texts)
            at = missing[at]
            self.add(new.tolist(), [whole[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)])
            slot[missing] = self.find(h[missing])
        # the hash has found a piece; the characters decide
        letters, length = self.letters_at[slot], stop - start
        same = self.n_letters[slot] == length
        known_letters = self.letters[np.repeat(np.where(same, letters, 0) - start, length) + np.arange(len(codes))]
        wrong = np.flatnonzero(~same | ~np.logical_and.reduceat(known_letters == codes, start) if len(start) else ~same)
        size = self.size[slot]
        out = np.repeat(self.at[slot] - (np.cumsum(size) - size), size)
        ids = self.ids[out + np.arange(len(out))]
        tokens = np.concatenate([[0], np.cumsum(size)])
        got = np.split(ids, tokens[np.searchsorted(start, ends)][:-1])
        for i in np.unique(np.searchsorted(ends, start[wrong], side="right")).tolist():
            got[i] = self.encode_whole(texts[i : i + 1])[0]
        return got

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.inner.encode_batch(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        plain = [not OTHER.search(t) and not (self.special and self.special.search(t)) for t in texts]
        done = iter(self.encode_plain([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else [])
        other = iter(self.encode_whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(done if p else other).astype("<u4").tobytes() for p in plain]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """``array``, or a copy of twice its length or more if it has no room for ``n`` values."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(len(array), n - len(array)), array.dtype)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and its inverse modulo 2**64 for i < n."""
    out = []
    for base in (PRIME, np.uint64(pow(int(PRIME), -1, 1 << 64))):
        steps = np.full(n, base)
        steps[:1] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each Python worker, until it gets a task of another kind.

    A task has one core, so the library starts no threads of its own, whose memory would stay.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(path, lambda: PieceTokenizer(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; all but the first have ``capacity``."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]] if n else []


def token_pieces(docs: DataFrame, capacity: int = 1024, end: int = END, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs(doc_id, text)``.

    A null or empty text still ends with ``end``; a text of any length is tokenized whole; rows
    with a null or repeated doc_id have pieces of their own; other columns are left out; an
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    from pyspark.sql.types import IntegerType, LongType, StructType

    schema = StructType([docs.schema["doc_id"]]).add("piece", IntegerType()).add("start", LongType()).add("length", LongType()).add("ids_crc32", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                which, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(tok.encode_batch(texts)):
                    ids += struct.pack("<I", end)
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        which.append(i), piece.append(k), start.append(s), length.append(n)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
                arrays = [part.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(frugal(run, keeps=path), schema)


class SumIndex:
    """Lengths, pairs and triples of lengths by their sum, longest first.

    Counts only fall while a plan is made, so a combination that lacks a piece lacks it
    for good: each sum's list is built once, from the lengths that are left then, and
    read on from the first entry that may still hold.
    """

    def __init__(self, left: np.ndarray, capacity: int):
        self.left, self.capacity = left, capacity
        have = np.flatnonzero(left)
        high, low = np.meshgrid(have, have, indexing="ij")
        ok = (high >= low) & (high + low <= capacity)
        high, low = high[ok], low[ok]
        order = np.lexsort((-high, high + low))
        self.high, self.low = high[order].astype(np.int32), low[order].astype(np.int32)
        self.edge = np.searchsorted(self.high + self.low, np.arange(capacity + 2))
        self.lists: dict[tuple[int, int], np.ndarray] = {}
        self.next: dict[tuple[int, int], int] = {}

    def _entries(self, parts: int, total: int) -> np.ndarray:
        if (parts, total) not in self.lists:
            if parts == 2:
                at = slice(self.edge[total], self.edge[total + 1])
                self.lists[2, total] = np.stack([self.high[at], self.low[at]], 1)
            else:
                end = self.edge[total]  # pairs of smaller sums
                first = total - self.high[:end] - self.low[:end]
                ok = np.flatnonzero(first >= self.high[:end])
                rows = np.stack([first[ok], self.high[ok], self.low[ok]], 1)
                rows = rows[(self.left[rows] > 0).all(1)]
                self.lists[3, total] = rows[np.lexsort((-rows[:, 1], -rows[:, 0]))].astype(np.int16)
            self.next[parts, total] = 0
        return self.lists[parts, total]

    def fill(self, gap: int, free: np.ndarray) -> list[int] | None:
        """The fewest lengths, three at most, that fill ``gap`` under the counts ``free``."""
        if free[gap]:
            return [gap]
        for parts in (2, 3):
            rows = self._entries(parts, gap)
            at = self.next[parts, gap]
            dead = True  # all entries so far lack a piece for good
            while at < len(rows):
                some = rows[at : at + 4096].astype(np.int64)
                holds = (free[some] >= self._times(some)).all(1)
                if dead:
                    alive = (self.left[some] >= self._times(some)).all(1)
                    self.next[parts, gap] = at + (int(alive.argmax()) if alive.any() else len(some))
                    dead = not alive.any()
                if holds.any():
                    return some[holds.argmax()].tolist()
                at += len(some)
        return None

    @staticmethod
    def _times(rows: np.ndarray) -> np.ndarray:
        """How often each entry of a row occurs in it."""
        return (rows[:, :, None] == rows[:, None, :]).sum(2)


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """``counts[length]`` pieces to ``[({length: uses}, times)]``, all consumed.

    Gaps are filled by combinations of the index's exact sum; what is left is best fit.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    index = SumIndex(left, capacity)
    plan = []
    for top in range(capacity, 0, -1):
        while left[top] > 0:
            free = left.copy()
            free[top] -= 1
            uses, gap = {top: 1}, capacity - top
            while gap > 0:
                fill = index.fill(gap, free)
                if fill is None:
                    fits = np.flatnonzero(free[: gap + 1])
                    if not len(fits):
                        break
                    fill = [int(fits[-1])]
                for x in fill:
                    uses[x] = uses.get(x, 0) + 1
                    free[x] -= 1
                    gap -= x
            times = min(int(left[x]) // n for x, n in uses.items())
            for x, n in uses.items():
                left[x] -= n * times
            plan.append((uses, times))
    return plan


def place_table(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), ordered by length and rank."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for uses, times in plan:
        offset = 0
        for length, n in sorted(uses.items(), reverse=True):
            rows.append((length, seen.get(length, 0), times, sequence, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    big = np.int64(1) << 48
    at = np.searchsorted(table[:, 0] * big + table[:, 1], length * big + rank, side="right") - 1
    row = table[at]
    index = rank - row[:, 1]
    return row[:, 3] + index % row[:, 2], row[:, 4] + index // row[:, 2] * length


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces(doc_id, piece, length, ids_crc32, ...)``.

    Sequences are gapless from 0 and hold at most ``capacity`` tokens.  Equal rows are
    pieces of their own; null doc_ids are ordinary; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    table = spark.sparkContext.broadcast(place_table(plan_patterns(counts, capacity)))
    salts = max(64, int(counts.sum()) // 20_000)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1)
    ranked = ranked.select(*pieces.columns, "_rank")
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*pieces.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    n, at_length = len(pieces.columns), pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = place(table.value, batch.column(at_length).to_numpy(), batch.column(n).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(frugal(run), schema)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialize(token_pieces(documents(spark, sf_dir)), "pack-pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
