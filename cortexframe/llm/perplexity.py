"""Document quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over characters (lower case, digits as 0, white space as one space),
order 5, one for each language, trained on all trusted text.  The 4,095 most
frequent characters of the corpus are symbols of their own, rarer ones share one.  A
5-gram is packed into one 64-bit number, so contexts and shorter n-grams are bit
operations and everything from raw counts to probabilities is groupings and joins of
count tables, sharded by n-gram: counts and continuation counts, discounts from
counts of counts, context totals, and the interpolation from one order to the next.
Probabilities are computed for the distinct 5-grams of the whole corpus, seen or not.

Documents' counts meet the table of log-probabilities in shards of at most
``shard_rows`` rows, one after the other: each is broadcast, every document's 5-grams
that fall into it are weighed by their counts, and the partial sums are added by
document.  Sums are of whole numbers, so the number of shards doesn't change them.

The threshold of a language is a quantile of the trusted documents that the model was
not trained on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, discard, documents, frugal, give_back, materialize, pack_texts, unpack_texts

ORDER = 5
SYMBOL = 12  # bits of a character
CLASSES = 1 << SYMBOL
SHARD_ROWS = 4_000_000  # of a language, a 5-gram and its log-probability: 24 bytes or less
UNIT = 1 << 30  # log-probabilities are whole numbers of 1 / UNIT
QUANTILE = 0.998
_DIGIT, _SPACE = re.compile(r"\d"), re.compile(r"\s+")


def normalized(text: str | None) -> str:
    return _SPACE.sub(" ", _DIGIT.sub("0", (text or "").lower())).strip()


class Alphabet:
    """Symbols of characters: 1 is the space, 0 any character that isn't listed."""

    def __init__(self, codes: list[int]):
        self.codes = np.array([32, *(c for c in codes if c != 32)][: CLASSES - 1], np.uint32)
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"codes": self.codes, "_table": None}

    def grams(self, text: str | None) -> np.ndarray:
        """Packed 5-grams, one for each character of the normalized text, which follows ORDER - 1 spaces."""
        if self._table is None:
            self._table = np.zeros(0x110000, np.int64)
            self._table[self.codes] = np.arange(1, len(self.codes) + 1)
        t = normalized(text)
        c = self._table[np.frombuffer((" " * (ORDER - 1) + t).encode("utf-32-le", "surrogatepass"), np.uint32)]
        out = np.zeros(len(t), np.int64)
        for k in range(ORDER):
            out = (out << SYMBOL) | c[k : k + len(t)]
        return out


def alphabet(docs: DataFrame) -> Alphabet:
    """The most frequent characters of all texts; at most ``CLASSES - 1`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                whole = "".join(t.lower() for t in batch.column(0).slice(at, 256).to_pylist() if t)
                total += np.bincount(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["code", "n"])

    counts = docs.select("text").mapInArrow(frugal(run), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return Alphabet([r["code"] for r in counts.orderBy(F.desc("n"), "code").limit(CLASSES - 1).collect()])


def corpus_grams(docs: DataFrame, letters: Alphabet) -> DataFrame:
    """``lang, g, c``: distinct 5-grams of ``docs(z, lang, trusted)``, whose texts are packed, and their count in trusted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str | None, list] = {}
            held = 0
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = unpack_texts(part.column(0).to_pylist())
                for t, lang, trusted in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    g = letters.grams(None if t is None else t.decode("utf-8", "surrogatepass"))
                    by.setdefault(lang, []).append((g, bool(trusted)))
                    held += len(g)
                    if held > 4_000_000:
                        yield from settle(by)
                        by, held = {}, 0
            yield from settle(by)

    def settle(by: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in by.items():
            g = np.concatenate([p[0] for p in parts])
            seen, at = np.unique(g, return_inverse=True)
            weight = np.concatenate([np.full(len(p[0]), p[1], np.int64) for p in parts])
            c = np.bincount(at, weight, minlength=len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(c)], names=["lang", "g", "c"])

    raw = docs.select("z", "lang", "trusted").mapInArrow(frugal(run), "lang string, g long, c long")
    return raw.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "g").agg(F.sum("c").alias("c"))


def _low(g, order: int):
    return g.bitwiseAND(F.lit((1 << (SYMBOL * order)) - 1))


def kneser_ney(corpus: DataFrame) -> DataFrame:
    """``lang, g, logp`` for all rows of ``corpus(lang, g, c)``: natural logarithm of each 5-gram's interpolated probability, in parts of ``UNIT``.

    A language without trusted text gets uniform probabilities.
    """
    counts = {ORDER: corpus.where("c > 0").select("lang", "g", "c")}
    asked = {ORDER: corpus.select("lang", "g")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = materialize(counts[n + 1].groupBy("lang", _low(F.col("g"), n).alias("g")).agg(F.count("*").alias("c")), f"kn-count{n}")
        asked[n] = materialize(asked[n + 1].select("lang", _low(F.col("g"), n).alias("g")).distinct(), f"kn-asked{n}")
    alphabet = counts[1].groupBy("lang").agg((F.count("*") + 1).alias("v"))
    below = None
    for n in range(1, ORDER + 1):
        t = counts[n]
        tally = t.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # Chen and Goodman's discounts, with a floor where a small text lacks a count of counts
        cuts = tally.select("lang", *[
            F.coalesce(F.when(F.col(f"n{k}") > 0, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(k - 0.05))), F.lit(0.5)).alias(f"d{k}")
            for k in (1, 2, 3)
        ])
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = t.join(F.broadcast(cuts), "lang").withColumn("ctx", F.shiftright("g", SYMBOL)).withColumn("cut", cut)  # cuts: a row a language
        context = seen.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("held"))
        rows = asked[n].join(seen.select("lang", "g", (F.col("c") - F.col("cut")).alias("own")), ["lang", "g"], "left")
        rows = rows.withColumn("ctx", F.shiftright("g", SYMBOL)).join(context, ["lang", "ctx"], "left")
        if below is None:
            rows = rows.join(F.broadcast(alphabet), "lang", "left").withColumn("low", 1.0 / F.coalesce("v", F.lit(CLASSES)))
        else:
            rows = rows.withColumn("suffix", _low(F.col("g"), n - 1)).join(below.withColumnRenamed("g", "suffix"), ["lang", "suffix"])
        p = F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("held") / F.col("total"), F.lit(1.0)) * F.col("low")
        used = [below] if below is not None else []
        below = materialize(rows.select("lang", "g", p.alias("low")), f"kn-p{n}")
        discard(*used)
    discard(*(table[n] for table in (counts, asked) for n in range(1, ORDER)))
    return below.select("lang", "g", F.round(F.log("low") * UNIT).cast("long").alias("logp"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, lang, text)`` with ``_k1`` and ``_k2``, hashes of the three; equal rows have equal keys."""
    parts = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))]
    return docs.withColumn("_k1", F.xxhash64(*parts)).withColumn("_k2", F.xxhash64(F.lit(1), *parts))


def weigh(rows: DataFrame, letters: Alphabet, shard: dict[str, tuple[np.ndarray, np.ndarray]], number: int) -> DataFrame:
    """``_k1, _k2, shard, logp, chars``: of each row of ``rows`` what its 5-grams in one shard of the model sum to."""
    shared = rows.sparkSession.sparkContext.broadcast(shard)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sums, sizes = [], []
                for t, lang in zip(part.column(3).to_pylist(), part.column(2).to_pylist(), strict=True):
                    keys, values = shared.value.get(lang or "", none)
                    seen, times = np.unique(letters.grams(t), return_counts=True)
                    at = np.searchsorted(keys, seen)
                    inside = at < len(keys)
                    inside[inside] = keys[at[inside]] == seen[inside]
                    sums.append(int((values[at[inside]] * times[inside]).sum())), sizes.append(int(times[inside].sum()))
                cols = [part.column(0), part.column(1), pa.array([number] * len(sums), pa.int32()), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["_k1", "_k2", "shard", "logp", "chars"])

    return rows.select("_k1", "_k2", "lang", "text").mapInArrow(frugal(run), "_k1 long, _k2 long, shard int, logp long, chars long")


def document_sums(docs: DataFrame, letters: Alphabet, model: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows of ``docs(doc_id, lang, text)`` without their text, with ``logp`` (in parts of ``UNIT``) and ``chars``."""
    rows = keyed(docs)
    # hashes deal shards evenly; a tenth is left for chance
    shards = max(1, math.ceil(model.count() / (0.9 * shard_rows)))
    sums = None
    for k in range(shards):
        table = model.where(F.pmod(F.xxhash64("g", "lang"), F.lit(shards)) == k).orderBy("lang", "g").toArrow()
        langs = table.column("lang").dictionary_encode().combine_chunks()
        code, g, logp = langs.indices.to_numpy(), table.column("g").to_numpy(), table.column("logp").to_numpy()
        shard = {lang: (g[code == i], logp[code == i]) for i, lang in enumerate(langs.dictionary.to_pylist())}
        part = materialize(weigh(rows, letters, shard, k), "kn-sums")
        sums = part if sums is None else sums.unionByName(part)
        del table, langs, code, g, logp, shard
        give_back()
    # equal rows have equal sums, and count once a shard
    once = sums.groupBy("_k1", "_k2", "shard").agg(F.max("logp").alias("logp"), F.max("chars").alias("chars"))
    total = once.groupBy("_k1", "_k2").agg(F.sum("logp").alias("logp"), F.sum("chars").alias("chars"))
    return rows.drop("text").join(total, ["_k1", "_k2"]).drop("_k1", "_k2")


def perplexities(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: ``doc_id, lang, n_scored, perplexity, threshold, kept``.

    Trusted are rows with quality 1 in ``labels(doc_id, quality)``; those whose crc32(doc_id)
    mod 4 is 3 set the thresholds, the others train the model.  Texts without characters
    have a null perplexity and are kept, as are languages (null is one) without trusted
    rows to set a threshold.  Rows with a null or repeated doc_id are scored each by its own
    text; texts of any length are scored whole; other columns are left out.  Empty tables
    give empty results.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    base = docs.select("doc_id", "text", "lang")
    letters = alphabet(base)
    # labels are two numbers a row; texts meet them by doc_id without being collected
    ids = base.select("doc_id").distinct().join(marks, "doc_id").where("good = 1").select(F.col("doc_id").alias("_id"))
    trusted = pack_texts(base, ["doc_id", "lang"]).hint("merge").join(ids, F.col("doc_id") == F.col("_id"), "left")
    trusted = trusted.withColumn("trusted", F.col("_id").isNotNull() & (crc_mod("doc_id", 4) != 3))
    corpus = materialize(corpus_grams(trusted, letters), "kn-corpus")
    model = kneser_ney(corpus)
    discard(corpus)
    sums = document_sums(base, letters, model, shard_rows)
    scored = sums.select("doc_id", "lang", F.col("chars").alias("n_scored"), F.when(F.col("chars") > 0, F.exp(-F.col("logp") / F.lit(UNIT) / F.col("chars"))).alias("perplexity"))
    scored = materialize(scored, "kn-scored")
    held = scored.join(ids, F.col("doc_id") == F.col("_id")).where(crc_mod("doc_id", 4) == 3)
    limits = held.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("threshold"))
    out = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")  # limits: a row a language
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexities(documents(spark, sf_dir).select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
