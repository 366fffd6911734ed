"""Toxicity by subword-bag embeddings and a linear softmax, trained in numpy.

A word is the bag of its character n-grams (with ``<`` and ``>`` at its ends)
and itself, hashed to rows of an embedding table; their mean goes through a
linear softmax, and table and softmax are trained together.  Labels belong to
documents, so training is by multiple instances: it starts from words with the
labels of their documents, then lets only the highest-scoring words of each
document speak for it.  A document's score is its highest word's, calibrated on
labelled documents left out of the training.  Misspelt or newly coined words
share n-gram rows with the words they come from.

Training takes a bounded sample (``max_docs`` labelled documents, those with the
least hash of doc_id, half of them toxic if there are enough); scoring is one
pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, documents, frugal, give_back

WORDS = re.compile(r"\w+")
N_MIN, N_MAX = 3, 6
BITS = 18
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def subwords(words: list[str], chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``words``, one word after the other, and how many each has (1 at least)."""
    parts = [_subwords(words[i : i + chunk]) for i in range(0, len(words), chunk)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # letters to the word's end
    found, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, N_MAX + 1):
            shifted = np.zeros_like(codes)
            shifted[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
            h = (h ^ shifted) * PRIME
            h ^= h >> np.uint64(29)
            if n >= N_MIN:
                ok = left >= n
                found.append(h[ok])
                owners.append(owner[ok])
        # the whole word: a sum of position-dependent terms, under another seed
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        mixed = (codes + np.uint64(1)) * (PRIME ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        mixed ^= mixed >> np.uint64(31)
        whole = np.add.reduceat(mixed, np.cumsum(lengths) - lengths) if len(words) else np.zeros(0, np.uint64)
        found.append(whole * PRIME)
        owners.append(np.arange(len(words)))
        h, o = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(o, kind="stable")
        return ((h[order] * PRIME) >> np.uint64(64 - BITS)).astype(np.int32), np.bincount(o, minlength=len(words))


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(counts):
        return np.zeros((0, *values.shape[1:]), dtype=values.dtype)
    starts = np.cumsum(counts) - counts
    sums = np.add.reduceat(values, starts, axis=0)
    return sums / (counts if values.ndim == 1 else counts[:, None])


@dataclass
class ToxicityModel:
    """Embedding rows already multiplied by the softmax's weights, and a calibration."""

    row: np.ndarray  # float32, one logit share for each bucket
    bias: float
    slope: float
    offset: float

    def logits(self, words: list[str]) -> np.ndarray:
        buckets, counts = subwords(words)
        return _means(self.row[buckets], counts) + self.bias

    def score(self, sets: list[set[str]]) -> list[float]:
        """Calibrated score of each set of words; a set without words scores 0."""
        known = list(set().union(*sets)) if sets else []
        by = dict(zip(known, self.logits(known).tolist(), strict=True)) if known else {}
        top = np.array([max(map(by.__getitem__, s)) if s else -np.inf for s in sets])
        z = self.slope * top + self.offset
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(top), 0.0, 1.0 / (1.0 + np.exp(-z))).tolist()


def train(pairs: Iterable[tuple[set[str], int]], prior: float = 0.1, dim: int = 8, warm: int = 12, rounds: int = 60, seed: int = 7) -> ToxicityModel:
    """Fit on (set of words, label) of documents; ``prior`` is the share of toxic documents where scores are used.

    Without both classes the model scores everything by ``prior``.
    """
    at: dict[str, int] = {}
    ids, marks = [], []
    for s, label in pairs:
        if s:
            ids.append(np.fromiter((at.setdefault(w, len(at)) for w in sorted(s)), dtype=np.int32, count=len(s)))
            marks.append(label)
    toxic = np.array(marks, dtype=np.int64)
    flat = np.zeros(1 << BITS, dtype=np.float32)
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel(flat, 0.0, 0.0, float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    held = rng.random(len(ids)) < 0.25
    vocab = list(at)
    buckets, counts = subwords(vocab)
    starts = np.cumsum(counts) - counts
    e = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    w = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    b = np.zeros(2, dtype=np.float32)
    seen_e, seen_w, seen_b = np.full(len(e), 1e-4, np.float32), np.full_like(w, 1e-3), np.full_like(b, 1e-3)

    def grams_of(types: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Ranges of ``types``, their n-grams' rows one word after the other, and how many each word has."""
        for at in range(0, len(types), 20_000):
            n = counts[types[at : at + 20_000]]
            flat = np.repeat(starts[types[at : at + 20_000]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield slice(at, at + 20_000), buckets[flat], n

    def step(types: np.ndarray, good: np.ndarray, bad: np.ndarray, rate: float) -> None:
        """One AdaGrad step of the cross-entropy; good and bad weigh the two labels of each word."""
        nonlocal w, b
        v = np.empty((len(types), dim), np.float32)
        for part, rows, n in grams_of(types):
            v[part] = _means(e[rows], n)
        z = v @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        total = (good + bad)[:, None]
        g = (p * total - np.stack([good, bad], 1)).astype(np.float32) / np.float32(total.sum())
        gv = (g @ w.T) / counts[types][:, None].astype(np.float32)
        gw, gb = v.T @ g, g.sum(0)
        sums = np.zeros((dim, len(e)))
        for part, rows, n in grams_of(types):
            share = np.repeat(gv[part], n, axis=0)
            for k in range(dim):
                sums[k] += np.bincount(rows, share[:, k], minlength=len(e))
        ge = sums.T.astype(np.float32)
        seen_e[:] += (ge**2).mean(1) * len(types)
        seen_w[:] += gw**2
        seen_b[:] += gb**2
        e[:] -= rate * ge * np.float32(np.sqrt(len(types))) / np.sqrt(seen_e)[:, None]
        w -= rate * gw / np.sqrt(seen_w)
        b -= rate * gb / np.sqrt(seen_b)

    fit = np.flatnonzero(~held)
    bad = np.bincount(np.concatenate([ids[i] for i in fit if toxic[i]] or [np.zeros(0, np.int32)]), minlength=len(vocab)).astype(float)
    good = np.bincount(np.concatenate([ids[i] for i in fit if not toxic[i]] or [np.zeros(0, np.int32)]), minlength=len(vocab)).astype(float)
    types = np.flatnonzero(bad + good >= 2)
    for _ in range(warm if len(types) else 0):
        step(types, good[types], bad[types], 0.3)
    sizes = np.array([len(x) for x in ids])
    flat_ids, firsts = np.concatenate(ids), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(ids)), sizes)

    def tops() -> tuple[np.ndarray, np.ndarray]:
        row = e @ (w[:, 1] - w[:, 0])
        z = _means(row[buckets], counts) + (b[1] - b[0])
        each = z[flat_ids]
        top = np.maximum.reduceat(each, firsts)
        hit = np.flatnonzero(each == top[owner])
        first = hit[np.unique(owner[hit], return_index=True)[1]]
        return flat_ids[first], top

    weight = np.where(toxic == 1, 1.0, max(1.0, (toxic == 1).sum()) / max(1.0, (toxic == 0).sum()))
    for _ in range(rounds):
        word, _top = tops()
        g = np.bincount(word[fit], weight[fit] * (toxic[fit] == 0), minlength=len(vocab))
        t = np.bincount(word[fit], weight[fit] * (toxic[fit] == 1), minlength=len(vocab))
        types = np.flatnonzero(g + t > 0)
        step(types, g[types], t[types], 0.3)
    row = (e @ (w[:, 1] - w[:, 0])).astype(np.float32)
    top = tops()[1]
    on = held if len(set(toxic[held].tolist())) == 2 else np.ones(len(ids), bool)
    share = np.where(toxic[on] == 1, prior / max(1, (toxic[on] == 1).sum()), (1 - prior) / max(1, (toxic[on] == 0).sum()))
    slope, offset = _platt(top[on], toxic[on], share)
    return ToxicityModel(row, float(b[1] - b[0]), slope, offset)


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Weighted logistic fit of ``y`` on ``x`` by Newton steps, with a small ridge on the slope."""
    scale = float(np.std(x)) or 1.0
    x = (x - (mean := float(np.mean(x)))) / scale
    a, c = 1.0, float(np.log(np.sum(weight * y) / max(1e-12, np.sum(weight * (1 - y)))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        r, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([np.sum(r * x) + ridge * a, np.sum(r)])
        hess = np.array([[np.sum(h * x * x) + ridge, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-9]])
        move = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, c = a - move[0], c - move[1]
    a = max(float(a), 1e-3)
    return a / scale, float(c) - a * mean / scale


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, max_docs: int = 5000) -> ToxicityModel:
    """Train on at most ``max_docs`` labelled documents of ``docs(doc_id, text)``.

    Rows of ``labels(doc_id, toxic)`` whose crc32(doc_id) mod 4 is ``held_out`` are not
    looked at.  Null labels and ids are left out; of a doc_id's several labels the highest
    counts, and of its several texts the last in order.  Without both labels the model
    scores everything by their share.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    if held_out is not None:
        known = known.where(crc_mod("doc_id", 4) != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = min(0.9, max(0.01, by.get(1, 0) / max(1, sum(by.values()))))
    picks = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_docs // 2)
        picks = some if picks is None else picks.unionByName(some)
    # bounded by max_docs rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    model = train(((words_of(r["text"]), r["toxic"]) for r in rows.orderBy("doc_id").toLocalIterator()), prior)
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``_toxicity`` double appended, instead of a column of that name; null and wordless texts score 0.

    Texts of any length are read whole; repeated rows and null ids are rows like others; an
    empty table gives no rows.  The model has a fixed size (one float for each of 2^18 buckets) and is broadcast.
    """
    docs = docs.drop("_toxicity")
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                scores = shared.value.score([words_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "_toxicity"])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add("_toxicity", DoubleType())
    return docs.mapInArrow(frugal(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= 0.3).cast("int").alias("predicted"),
    )
