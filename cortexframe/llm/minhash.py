"""Near duplicates by order MinHash over five-word shingles, verified by alignment.

A document is its sequence of five-word shingles (lower case, cut at white space;
a shorter text is one shingle), each labelled with how often it occurred before.
A sketch takes the two labelled shingles of least hash and keeps their order in
the text, so it is sensitive to edit similarity and not to shared words alone.
Bands of two sketches name buckets.  In a bucket each text is compared with
its subgroup's first and with its neighbour by length, and the subgroups' firsts with the
bucket's first, which links groups of copies with rows linear in the bucket's size and
gives no text more than a subgroup's partners and one a subgroup.  Where a bucket then still holds several components,
all pairs of its members from different components are compared, in pairs of blocks
over the cluster.  Candidates are verified exactly:
the longest common subsequence of the labelled shingle sequences, within the
band of offsets that the threshold allows, over the length of their union.

Equal texts are folded into one class before anything else, so large groups of
copies cost one row each.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import bounded_batches, components, documents, frugal, materialize, texts_of, unpack_texts

SHINGLE = 5
BANDS, ROWS = 16, 2
SIMILARITY = 0.8
BLOCK = 256  # members of a bucket's block; a task compares two blocks
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of each text's words."""
    cut = [t.lower().split() if t else [] for t in texts]
    flat = np.array([w for words in cut for w in words], dtype=object)
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    return np.split(hashed, np.cumsum([len(c) for c in cut])[:-1])


def labelled_shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of ``k``-word shingles in text order, each labelled with its occurrence; all distinct."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - k + 1)
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(words))):
            s = s * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        s = mix(s + np.uint64(min(k, len(words))))
        order = np.argsort(s, kind="stable")
        run = s[order]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        if len(first) < n:
            seen = np.empty(n, np.uint64)
            seen[order] = np.arange(n, dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, n))).astype(np.uint64)
            s = mix(s + seen * np.uint64(0xD6E8FEB86659FD93))
    return s


def bands(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of ordered two-minimum sketches."""
    out = np.empty(len(SEEDS), np.uint64)
    with np.errstate(over="ignore"):
        for i, seed in enumerate(SEEDS):
            h = (shingles ^ seed) * _M1
            h ^= h >> np.uint64(32)
            a = int(h.argmin())
            if len(h) > 1:
                h[a] = np.uint64(0xFFFFFFFFFFFFFFFF)
                b = int(h.argmin())
                a, b = min(a, b), max(a, b)
            else:
                b = a
            out[i] = shingles[a] * np.uint64(3) + shingles[b]
        out = mix(out).reshape(BANDS, ROWS)
        return mix((out * np.array([1, 31], np.uint64)).sum(1) + np.arange(BANDS, dtype=np.uint64))


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """|LCS| / (|a| + |b| - |LCS|) of two labelled sequences, or 0 once it is known to be below ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n + m - 2 * need  # insertions and deletions at most
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    j = j[np.argsort(i, kind="stable")]
    if (j[1:] > j[:-1]).all():
        common = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        common = len(tails)
    return common / (n + m - common) if common >= need - 1e-9 else 0.0


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, h, k1, k2, n, bands``: hash of the text, a 128-bit key of the words, the number of shingles, the bands (null without words)."""
    schema = StructType([docs.schema["doc_id"]]).add("h", LongType()).add("k1", LongType()).add("k2", LongType()).add("n", IntegerType()).add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                k1, k2, ns, bs = [], [], [], []
                for words in word_hashes(part.column(2).to_pylist()):
                    s = labelled_shingles(words)
                    if len(s):
                        place = mix(words + np.arange(len(words), dtype=np.uint64) * _M2)
                        k1.append(int(place.sum(dtype=np.uint64).astype(np.int64))), k2.append(int(mix(place).sum(dtype=np.uint64).astype(np.int64)))
                        bs.append(bands(s).astype(np.int64))
                    else:
                        k1.append(None), k2.append(None), bs.append(None)
                    ns.append(len(s))
                cols = [part.column(0), part.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ns, pa.int32()), pa.array(bs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(frugal(run), schema)


def candidate_pairs(classes: DataFrame, similarity: float = SIMILARITY, group: int = 500) -> DataFrame:
    """Pairs ``(a, b)`` of class representatives to verify, from ``classes(rep, n, bands)``.

    Two rows at most for each member of a bucket.  The bucket's first member comes from
    a grouping that combines before its shuffle; a bucket's members are dealt to subgroups of
    about ``group``, so no task holds a whole hot bucket.  A member meets its neighbour by
    length and the first of its subgroup, and these meet the bucket's first: a text is wanted
    by a subgroup's members and one row a subgroup at most, not by the whole bucket.
    """
    members = materialize(classes.select("rep", "n", F.explode("bands").alias("band")), "minhash-members")
    heads = members.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
    near = members.join(heads, "band").withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / F.lit(group))))
    order = Window.partitionBy("band", "part").orderBy("n", "rep")
    first = F.min(F.struct("rep", "n")).over(Window.partitionBy("band", "part"))
    near = near.withColumn("before", F.lag(F.struct("rep", "n")).over(order)).withColumn("first", first)
    over = F.when(F.col("first.rep") == F.col("rep"), F.col("head")).otherwise(F.col("first"))
    pairs = near.select("rep", "n", F.explode(F.array(over, "before")).alias("o")).where("o is not null and o.rep <> rep")
    alike = F.least("n", "o.n") >= F.lit(similarity) * F.greatest("n", "o.n")
    return pairs.where(alike).select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of ``pairs`` whose alignment reaches ``similarity``.

    Texts of documents in pairs, and few others, are shuffled by doc_id and meet each pair.  A
    doc_id that repeats with several texts is linked if any of them is alike.
    """
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = texts_of(docs, ids)
    both = (
        pairs.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
        .hint("merge").join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
        .select("a", "b", "za", "zb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = part.column(2).to_pylist() + part.column(3).to_pylist()
                distinct = list(dict.fromkeys(packed))
                texts = [t.decode("utf-8", "surrogatepass") for t in unpack_texts(distinct)]
                known = dict(zip(distinct, map(labelled_shingles, word_hashes(texts)), strict=True))
                got = [aligned_similarity(known[x], known[y], similarity) for x, y in zip(packed[: part.num_rows], packed[part.num_rows :], strict=True)]
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.float64())], names=["a", "b", "similarity"])
                yield out.filter(pa.array([g > 0 for g in got], pa.bool_()))

    schema = StructType().add("a", LongType()).add("b", LongType()).add("similarity", "double")
    return both.mapInArrow(frugal(run), schema)


def shared_ids(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` from each doc_id that has several texts to the representatives of their classes."""
    key = F.struct("k1", "k2")
    several = marks.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id")
    texts = marks.join(several, "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct()
    return texts.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def common_shingles(shingles: list[np.ndarray]) -> np.ndarray:
    """Counts of labelled shingles that each two texts share, as a matrix."""
    out = np.zeros((len(shingles), len(shingles)), np.float32)
    owner = np.repeat(np.arange(len(shingles)), [len(s) for s in shingles])
    _, at, times = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, at = owner[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = 2048
    cuts = np.searchsorted(at, np.arange(0, int((times > 1).sum()) + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        rows, local = np.unique(owner[lo:hi], return_inverse=True)
        has = np.zeros((len(rows), width), np.float32)
        has[local, at[lo:hi] - k * width] = 1
        out[np.ix_(rows, rows)] += has @ has.T
    return out


def block_links(ids: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, bands: np.ndarray, band: int, z: list, similarity: float) -> list[tuple[int, int]]:
    """Links among one block's members, or between two blocks' (``side`` 0 and 1), of different components.

    Pairs that an earlier band holds too are left to that band's bucket.
    """
    ask = (comp[:, None] != comp) & (np.minimum(n[:, None], n) >= similarity * np.maximum(n[:, None], n))
    ask &= (side[:, None] < side) if side.any() else np.triu(np.ones(ask.shape, bool), 1)
    for j in range(int((bands[0] == band).argmax())):
        ask &= bands[:, j, None] != bands[:, j]
    used = np.flatnonzero(ask.any(0) | ask.any(1))
    if not len(used):
        return []
    ask, n, ids = ask[np.ix_(used, used)], n[used], ids[used]
    texts = [t.decode("utf-8", "surrogatepass") for t in unpack_texts([z[i] for i in used])]
    known = [labelled_shingles(w) for w in word_hashes(texts)]
    need = similarity * (n[:, None] + n) / (1 + similarity)
    found = np.argwhere(ask & (common_shingles(known) >= need - 1e-3))  # sharing is necessary, order decides
    return [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in found if aligned_similarity(known[i], known[j], similarity) > 0]


def open_links(classes: DataFrame, groups: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, group: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between members of a bucket that ``groups(id, component)`` has in different components; all such pairs are compared.

    Buckets of one component are done.  Others are cut into blocks of about ``group``
    members: by hash, in large buckets also by length (only adjacent strata can be alike)
    and with components of half a block or more apart, which don't meet themselves.
    """
    comp = F.coalesce("component", "rep").alias("comp")
    members = materialize(classes.join(groups, F.col("rep") == F.col("id"), "left").select("rep", "h", "n", comp, F.explode("bands").alias("band")), "minhash-named")
    sizes = members.groupBy("band").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    width = 1e-6 - math.log(similarity)
    stratum = F.when(F.col("size") > group, F.floor(F.log("n") / width)).otherwise(F.lit(0)).cast("long").alias("stratum")
    left = materialize(members.join(sizes.select("band", "size"), "band").select("band", "rep", "h", "n", "comp", "size", stratum), "minhash-open")
    own = left.where(F.col("size") > group).groupBy("band", "stratum", "comp").agg(F.count("*").alias("c")).where(F.col("c") >= group // 2)
    placed = left.join(own, ["band", "stratum", "comp"], "left").withColumn("pure", F.col("c").isNotNull()).withColumn("of", F.when(F.col("pure"), F.col("comp")).otherwise(F.lit(0).cast("long")))
    cells = placed.groupBy("band", "stratum", "pure", "of").agg(F.count("*").alias("cell"))
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("cell") / F.lit(group))).cast("long").alias("part")
    placed = placed.join(cells, ["band", "stratum", "pure", "of"]).select("band", "rep", "h", "n", "comp", F.struct("stratum", "pure", "of", part).alias("block"))
    placed = materialize(placed, "minhash-placed")
    blocks = placed.select("band", "block").distinct()
    both = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "band").where("x <= y and abs(x.stratum - y.stratum) <= 1 and not (x.pure and y.pure and x.of = y.of)")
    both = both.withColumn("task", F.xxhash64("x", "y"))
    uses = both.select("band", "task", F.col("x").alias("block"), F.lit(0).alias("side")).unionByName(both.where("x <> y").select("band", "task", F.col("y").alias("block"), F.lit(1).alias("side")))
    ids = placed.select(F.col("rep").alias("id")).distinct()
    # an id can stand for several texts, so texts and seats are told apart by hash too
    texts = texts_of(docs, ids).hint("merge").join(classes.select(F.col("rep").alias("id"), "h", "bands"), ["id", "h"])
    seats = placed.join(uses, ["band", "block"]).select("band", "task", "side", F.col("rep").alias("id"), "h", "n", "comp").dropDuplicates(["band", "task", "id", "h"])
    names = ["id", "n", "comp", "side", "bands", "z"]
    # the count of partitions is given, as small blocks can be much work
    rows = seats.hint("merge").join(texts, ["id", "h"]).select("band", "task", *names)
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "task").sortWithinPartitions("band", "task")

    def solve(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        ids, n, comp, side = (t.column(c).to_numpy() for c in names[:4])
        got = block_links(ids, n, comp, side, np.array(t.column("bands").to_pylist(), np.int64), key[0], t.column("z").to_pylist(), similarity)
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            band, task = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((band[1:] != band[:-1]) | (task[1:] != task[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                now = (int(band[lo]), int(task[lo]))
                if held and now != key:
                    yield solve(key, held)
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield solve(key, held)

    return rows.mapInArrow(frugal(run), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, class_id, n_copies, kept``.

    ``class_id`` is the least doc_id reachable by links of ``similarity`` or more;
    ``n_copies`` counts rows with the same words.  Texts without words (null, empty,
    white space) link with nothing and are kept, as are rows with a null doc_id.
    Of rows repeated with one doc_id all have the same class, if their texts differ too: such
    an id links its texts.  No rows, no result.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = materialize(sketches(keyed), "minhash-sketches")
    classes = materialize(
        marks.where("k1 is not null").groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("n_copies"))
        .select("k1", "k2", F.col("least.doc_id").alias("rep"), F.col("least.h").alias("h"), "n", "bands", "n_copies"),
        "minhash-classes",
    )
    pairs = materialize(candidate_pairs(classes, similarity), "minhash-pairs")
    links = verified(pairs, keyed, similarity).select("a", "b").unionByName(shared_ids(marks.where("k1 is not null"), classes))
    groups = components(materialize(links, "minhash-links"))
    more = materialize(open_links(classes, groups, keyed, similarity), "minhash-open-links")
    groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.select("k1", "k2", "rep", "n_copies").join(groups, F.col("rep") == F.col("id"), "left")
    named = named.select("k1", "k2", "n_copies", F.coalesce("component", "rep").alias("class_id"))
    worded = marks.where("k1 is not null").select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id", "n_copies")
    rest = marks.where("k1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    out = worded.unionByName(rest).unionByName(unnamed)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
