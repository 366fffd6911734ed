"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of machine words: bit ``l`` of a slot belongs to language ``l``'s Bloom
filter, so looking an n-gram up at its hash positions and taking AND gives the
mask of all languages that contain it.  Set bits per language over a text's
n-grams, corrected for each filter's rate of false positives, are its counts; the
language with the highest share of its n-grams in the text wins.

The filters are built from a bounded sample (``per_language`` documents of each
language, those of least hash); the table has a fixed size and is broadcast.
Scoring is one pass over whole texts, cut to slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import bounded_batches, crc_mod, documents, frugal, give_back

GRAMS = (2, 3, 4, 5)
BITS = 22
SLICE = 400_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters, runs of anything else as one space, a space at both ends."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower()
    codes = np.frombuffer(f" {kept} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if text.isascii():
        codes = np.where((codes >= 97) & (codes <= 122), codes, 32)
    space = codes == 32
    return codes[~(space & np.append(False, space[:-1]))]


def gram_hashes(codes: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Hashes of n-grams of all orders that start in the range; those that span a whole space between words are left out."""
    stop = len(codes) if stop is None else stop
    found = []
    with np.errstate(over="ignore"):
        window = codes[start : stop + max(GRAMS)]
        h = np.zeros(len(window), np.uint64)
        inner = np.zeros(len(window), bool)  # a space strictly inside
        for n in range(1, max(GRAMS) + 1):
            last = window[n - 1 :]
            if not len(last):
                break
            h = (h[: len(last)] ^ last) * PRIME
            h ^= h >> np.uint64(29)
            if n > 2:
                inner = inner[: len(last)] | (window[n - 2 : n - 2 + len(last)] == 32)
            if n in GRAMS:
                ok = ~inner[: len(last)] if n > 2 else np.ones(len(last), bool)
                ok = ok & (np.arange(len(last)) < stop - start)
                found.append((h[ok] ^ np.uint64(n)) * PRIME)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), ((hashes >> np.uint64(64 - 2 * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray  # (2**BITS, words of 64 languages)
    false_rate: np.ndarray
    hit_rate: np.ndarray  # share of a language's own n-grams that its filter holds

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Looked-up n-grams that tell languages apart, per language, and their number."""
        codes = letters(text)
        total, n = np.zeros(len(self.languages)), 0
        rest = np.zeros(len(self.languages))
        for at in range(0, len(codes), SLICE):
            one, two = slots(gram_hashes(codes, at, min(len(codes), at + SLICE)))
            masks = self.table[one] & self.table[two]
            each = np.stack([((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(self.languages))])
            some = each.sum(0)
            tells = (some > 0) & (some < len(self.languages))
            total += each[:, tells].sum(1)
            rest += each.sum(1)
            n += int(tells.sum())
        return (total, n) if n else (rest, len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not any(map(str.isalpha, text[:200])) and not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if not self.languages:
            return UNKNOWN, 0.0
        counts, n = self.counts(text)
        true = np.maximum(0.0, (counts - n * self.false_rate) / (1 - self.false_rate)) / self.hit_rate
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true.sum() > 0 else 1.0 / len(self.languages)


def build(texts: dict[str, list[str]]) -> LanguageFilters:
    """Filters from texts by language; an n-gram counts if two texts have it (or it is the only text)."""
    languages = sorted(texts)
    table = np.zeros((1 << BITS, max(1, (len(languages) + 63) // 64)), np.uint64)
    rates, hit = [], []
    for k, language in enumerate(languages):
        own = [np.unique(gram_hashes(letters(t))) for t in texts[language]]
        seen, times = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0))
        seen = seen[times >= min(2, len(own))]
        bit = np.uint64(1 << (k % 64))
        for s in slots(seen):
            np.bitwise_or.at(table[:, k // 64], s, bit)
        fill = float(((table[:, k // 64] & bit) != 0).mean())
        rates.append(min(0.9, fill**2))
        inside = [(seen[np.minimum(np.searchsorted(seen, o), len(seen) - 1)] == o).mean() for o in own if len(o) and len(seen)]
        hit.append(max(0.05, float(np.mean(inside)) if inside else 1.0))
    return LanguageFilters(languages, table, np.array(rates), np.array(hit))


def fit_languages(docs: DataFrame, per_language: int = 300) -> LanguageFilters:
    """Filters from at most ``per_language`` rows of each language of ``docs(doc_id, text, lang)``.

    Rows are picked by hash of doc_id and learnt from whole.  Null texts and languages are left out.
    """
    ranked = docs.where("text is not null and lang is not null").select(
        "doc_id", "lang", "text", F.xxhash64("doc_id", F.lit(5)).alias("_h")
    )
    # the least of each language among the least of each of its 64 parts: no task ranks a whole language
    ids = ranked.select("doc_id", "lang", "_h", F.pmod(F.xxhash64("_h"), F.lit(64)).alias("_part"))
    for group in (["lang", "_part"], ["lang"]):
        ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_h", "doc_id"))).where(F.col("_r") <= per_language).drop("_r")
    picks = ids.select("doc_id", "lang")
    rows = ranked.drop("_h").join(F.broadcast(picks), ["doc_id", "lang"])  # at most per_language rows a language
    texts: dict[str, list[tuple]] = {}
    for r in rows.toLocalIterator():
        texts.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    model = build({k: [t for _, t in sorted(v, key=lambda x: (x[0] is None, x[0], x[1]))] for k, v in texts.items()})
    del texts
    give_back()
    return model


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` appended, instead of columns of these names if it has them.

    A null text and one without a letter (so an empty one) give ``und`` and 0; ties go to the
    first language by name.  Texts of any length are read whole, in slices; repeated rows and
    null ids are rows like others; an empty table gives no rows; without a learned language
    all are ``und``.
    """
    docs = docs.drop("lang_pred", "lang_score")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            got = [shared.value.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names
            )

    return docs.mapInArrow(frugal(run), schema)


def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod("doc_id", 3) == 1
    model = fit_languages(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
