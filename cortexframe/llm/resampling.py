"""Importance resampling towards a target distribution, with an exact cutoff.

Features are runs of 1 to ``longest`` consecutive words, hashed to ``buckets`` by crc32.
What the corpus and the target hold in each bucket gives the bucket's gain, a log ratio;
a document's weight is the mean gain of its features, looked up in one array of gains,
whose length is fixed and which is therefore broadcast.  Weight plus a Gumbel number drawn
from the document's id is its score, and the highest scores are a weighted draw without
replacement.

The cutoff is found without sorting all documents.  A quantile sketch proposes a bracket of
scores around the wanted rank; counting the rows above and inside it is exact, and says
whether the cutoff lies inside or the bracket has to be widened.  Only the bracket is then
sorted, over range partitions, and the row of the wanted rank read from it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, documents, frugal, materialize

BUCKETS = 10_000
SEED = 2024
#: what the sketch keeps: ranks are off by at most the number of rows over this
ACCURACY = 10_000
#: upper case to lower case, and all that isn't part of a word to spaces
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: different features whose buckets a task remembers
KNOWN = 200_000


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a to z (A to Z lower-cased) and characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Hasher(dict):
    """Buckets of features; forgets when it holds ``KNOWN`` of them."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = at = crc32(feature) % self.buckets
        return at

    def of(self, text: str | None, longest: int) -> tuple[np.ndarray, int]:
        """Buckets of a text's features, repeats counted, and the number of its words."""
        found = words(text)
        grams = list(found)
        for n in range(2, longest + 1):
            grams += [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
        return np.fromiter(map(self.__getitem__, grams), np.int64, len(grams)), len(found)


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hasher = np.zeros(buckets, np.int64), Hasher(buckets)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.concatenate([hasher.of(text, longest)[0] for text in batch.column(0).to_pylist()]), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(frugal(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # at most one a bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1,000 times the logarithm of how much likelier a bucket is in the target, rounded down; every bucket counts one more than it has."""
    s, t, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """1,000 times a Gumbel number drawn from an id, rounded down; null counts as an empty id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # as long as there are buckets
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(shared.value))
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                at, n_words = hasher.of(text, longest)
                weight = int(shared.value[at].sum()) // len(at) if len(at) else 0
                out.append((n_words, len(at), weight, weight + gumbel(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)]], names=names)

    schema = StructType([StructField(c, LongType()) for c in names])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), schema)


def _best_first() -> list:
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def ordered(rows: DataFrame, name: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``rows`` best first over range partitions, with ``_part`` and ``_place`` in it, and each part's number, size and rows before it.

    The parts' sizes are all that reaches the driver.  Repeated rows are told apart by
    nothing but their place, and are dealt out over parts.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *_best_first(), F.col("_tie")).sortWithinPartitions(*_best_first(), "_tie")
    # the number that Spark gives to rows of a partition: its upper bits are the partition, the others count
    placed = dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    table = materialize(placed.select(*rows.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), name)
    sizes = sorted((r["_part"], r["n"]) for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect())
    out, before = [], 0
    for part, n in sizes:
        out.append((part, n, before))
        before += n
    return table, out


def cutoff(rows: DataFrame, wanted: int, total: int, accuracy: int = ACCURACY) -> tuple[int, int | None]:
    """Score and doc_id of the row that is number ``wanted`` (from 1) of ``rows(doc_id, score)``, best first.

    ``total`` is the number of rows.  The sketch only proposes; exact counts decide.
    """
    slack = 2.0 / accuracy
    while True:
        share = 1 - wanted / total
        # the sketch's own error on both sides, or the whole range once the slack reaches it
        asked = [max(0.0, share - slack), min(1.0, share + slack)]
        low, high = rows.agg(F.percentile_approx("score", asked, F.lit(accuracy)).alias("q")).first()["q"]
        low, high = (None if asked[0] == 0 else low), (None if asked[1] == 1 else high)
        over = F.lit(False) if high is None else F.col("score") > high
        inside = ~over & (F.lit(True) if low is None else F.col("score") >= low)
        n = rows.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)).alias("over"), F.coalesce(F.sum(inside.cast("long")), F.lit(0)).alias("inside")).first()
        if n["over"] < wanted <= n["over"] + n["inside"]:
            break
        slack *= 8
    table, parts = ordered(rows.where(inside), "resample-bracket")
    place = wanted - n["over"] - 1
    part, _, before = next(p for p in parts if p[2] <= place < p[2] + p[1])
    row = table.where((F.col("_part") == part) & (F.col("_place") == place - before)).first()
    return row["score"], row["doc_id"]


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, accuracy: int = ACCURACY) -> DataFrame:
    """Draw ``percent`` in 100, rounded down, of the ``N`` rows of ``docs(doc_id, text)`` that have ``min_words`` words, likelier the more they are like ``target(text)``.

    Returns ``doc_id, n_features, weight, score, rank`` of every row, rank from 1 for the
    drawn and null for the others.  Null and empty texts have no features and weight 0; a
    null doc_id draws its number as an empty one and is last among ties; rows of one doc_id
    are each a row of the draw.  Texts of any length are read whole, other columns are
    left out, and empty tables give no rows.
    """
    bounded_batches(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = materialize(scores(docs, gains, longest, seed), "resample-scores")
    out = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= min_words)
    total = able.count()
    wanted = percent * total // 100
    if wanted == 0:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    score, doc_id = cutoff(able.select("doc_id", "score"), wanted, total, accuracy)
    tie = F.lit(True) if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(False))
    best = (F.col("n_words") >= min_words) & ((F.col("score") > score) | ((F.col("score") == score) & tie))
    table, parts = ordered(scored.where(best).select(*out), "resample-drawn")
    before = F.broadcast(scored.sparkSession.createDataFrame([(p, b) for p, _, b in parts], "_part long, _before long"))  # a row a partition
    rank = F.col("_before") + F.col("_place") + 1
    drawn = table.join(before, "_part").select(*out, F.when(rank <= wanted, rank).alias("rank"))  # rows that repeat the last one have no rank
    return drawn.unionByName(scored.where(~best).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


def _sql() -> str:
    """The query in SQL; crc32 is worked out bit by bit for each different word."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = "regexp_extract_all(" + lower + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    bit = "case when {c} & 1 = 1 then xor({c} >> 1, 3988292384) else {c} >> 1 end"
    byte = f"list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, z: {bit.format(c='c')}, xor(s, x))"
    crc = f"xor(list_reduce([('0x' || hex(encode(w))[2 * i - 1:2 * i])::bigint for i in range(1, octet_length(encode(w)) + 1)], lambda s, x: {byte}, 4294967295::bigint), 4294967295)"
    return f"""with d as (select row_number() over () id, doc_id, {found.format("coalesce(text, '')")} ws from documents), b as (select {found.format("coalesce(text, '')")} ws from benchmark),
    dw as (select id, unnest(ws) w from d), bw as (select unnest(ws) w from b),
    h as (select w, {crc} % {BUCKETS} k from (select w from dw union select w from bw)),
    dk as (select id, k from dw join h using (w)), s as (select k, count(*) s from dk group by 1), t as (select k, count(*) t from bw join h using (w) group by 1),
    g as (select s.k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + {BUCKETS}) / ((s + 1)::double * ((select count(*) from bw) + {BUCKETS}))))::bigint gain from s left join t using (k)),
    m as (select id, floor(sum(gain)::double / count(*))::bigint weight from dk join g using (k) group by 1),
    x as (select doc_id, len(ws) n, coalesce(weight, 0) weight, ('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[1:8])::ubigint h from d left join m using (id)),
    z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint score from x),
    r as (select *, case when n >= 20 then row_number() over (partition by n >= 20 order by score desc, doc_id nulls last) end place from z)
    select doc_id, n::bigint n_features, weight, score, case when place <= 10 * (select count(*) from r where n >= 20) // 100 then place end::bigint as rank from r"""


SQL = _sql()
