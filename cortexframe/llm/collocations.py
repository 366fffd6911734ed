"""Phrases whose words stand together more often than chance would have them.

Everything is counted within a language, in one pass over the texts for each length.  A
phrase can be frequent only if the two phrases that it holds, one word shorter, are; so a
pass counts only occurrences both of whose shorter phrases are in a filter of the last
pass's frequent ones.  The filter is a Bloom filter of bounded size: what it lets through
by mistake is counted like the rest and falls below the threshold.

A task counts in a HAT-trie.  Word ids are 64-bit hashes; a shallow trie leads from the
first two words (the prefix partition) on to containers, in which phrases are kept in the
order of a hash of theirs with their counts, beside a buffer of new occurrences.  A
container that outgrows ``BURST`` becomes a node whose children go by the words that
follow.  When a task's trie outgrows ``limit``, its largest subtrees leave as sorted runs;
Spark shuffles runs by prefix partition and each partition's runs are merged.  A phrase is
kept as the id of the phrase without its last word and that word's id, so frequent phrases
get their words from joins with the last length's, and no text is shuffled to count.

Ids are checked: two frequent words or phrases of one id, or two phrases that share an
entry's hash, make the whole count start again with other hashes.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, bounded_batches, discard, documents, frugal, materialize

MIN_COUNT, LONGEST, TOP = 100, 5, 2_000
#: phrases in a task's trie; in a container before it bursts; different words that a task remembers
LIMIT, BURST, KNOWN = 1_000_000, 32_768, 300_000
BLOCK = 400_000  # words that are looked at together
PARTITIONS = 256  # prefix partitions at least, and one for so many words:
WORDS_A_PARTITION = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd; hashes of phrases are sums of words' over its powers
_END = b"."  # stands for the end of a piece, as no word holds it
_FOLD = bytes(c + 32 if 65 <= c <= 90 else ord(".") if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A to Z lower-cased, with ``_END`` between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).replace(_END, b" . ").split()


def _lang():
    return F.coalesce("lang", F.lit("und")).alias("lang")


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` of all words of ``docs(text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def settle() -> Iterator[pa.RecordBatch]:
            for lang, seen in held.items():
                seen.pop(_END, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "f"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, held.values())) > KNOWN:
                    yield from settle()
        yield from settle()

    rows = docs.select("text", _lang()).mapInArrow(frugal(run), "lang string, word binary, f long")
    return rows.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("f").alias("f"))


def _seeds(lang: str, seed: int) -> tuple[int, int]:
    return tuple(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 2 * seed + k) for k in (0, 1))


class Words(dict):
    """Numbers of a language's words in order of appearance, and two hashes of each."""

    def __init__(self, lang: str, seed: int):
        self.seeds, self.hashes = _seeds(lang, seed), (array("Q"), array("Q"))

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        for seed, kept in zip(self.seeds, self.hashes, strict=True):
            kept.append(xxhash.xxh64_intdigest(word, seed))
        return at

    def of(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of a list of words, and which are ends of pieces."""
        at = np.fromiter(map(self.__getitem__, found), np.int32, len(found))
        a, b = (np.array(h, np.uint64) for h in self.hashes)
        return a[at], b[at], at == self[_END] if _END in self else np.zeros(len(at), bool)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each place on; the last places have too few."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _STEP + h[j : j + n]
    return out


class Filter:
    """A Bloom filter of phrases' second hashes, two bits each."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for shift in (0, 32):
            p = (h >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            out &= ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def phrase_filter(phrases: DataFrame, seed: int, count: int) -> Filter:
    """Of ``phrases(lang, phrase)``: 16 bits a phrase, ``2**FILTER_BITS`` bits at most."""
    bits = min(FILTER_BITS, max(10, (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                parts = phrase.encode("utf-8", "surrogatepass").split(b" ")
                h = np.array([xxhash.xxh64_intdigest(w, _seeds(lang, seed)[1]) for w in parts], np.uint64)
                out[i] = chain(h, len(parts))[0]
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    hashed = phrases.select("lang", "phrase").mapInArrow(run, "h long")
    mask = F.lit((1 << bits) - 1)
    place = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
    rows = hashed.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(words, bits)


def folded(parent: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Each phrase once, in order of its hash, with the sum of its counts; and whether two phrases share a hash."""
    full = parent * _STEP + word
    order = np.argsort(full)
    full, parent, word = full[order], parent[order], word[order]
    same = full[1:] == full[:-1]
    clash = bool((same & ((parent[1:] != parent[:-1]) | (word[1:] != word[:-1]))).any())
    first = np.flatnonzero(np.concatenate([[len(full) > 0], ~same])) if len(full) else np.zeros(0, np.int64)
    return parent[first], word[first], np.add.reduceat(count[order], first) if len(first) else count[:0], clash


_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Node:
    """A container of phrases, or once it has burst a node of 16 children."""

    __slots__ = ("depth", "kept", "new", "n_new", "children")

    def __init__(self, depth: int = 0):
        self.depth, self.kept, self.new, self.n_new, self.children = depth, _NONE, [], 0, None

    def add(self, parent: np.ndarray, word: np.ndarray, count: np.ndarray) -> bool:
        if self.children is not None:
            return self._deal(parent, word, count)
        self.new.append((parent, word, count))
        self.n_new += len(parent)
        return self.fold() if self.n_new > max(1024, len(self.kept[0])) else False

    def fold(self) -> bool:
        *kept, clash = folded(*(np.concatenate(c) for c in zip(self.kept, *self.new, strict=True)))
        self.kept, self.new, self.n_new = tuple(kept), [], 0
        if len(kept[0]) > BURST and self.depth < 16:
            self.children = [Node(self.depth + 1) for _ in range(16)]
            whole, self.kept = self.kept, _NONE
            clash |= self._deal(*whole)
        return clash

    def _deal(self, parent: np.ndarray, word: np.ndarray, count: np.ndarray) -> bool:
        # a node's children go by the words before the last, the next by the last word, by turns
        bits = (parent if self.depth % 2 == 0 else word) >> np.uint64(4 * (self.depth // 2)) & np.uint64(15)
        clash = False
        for i, child in enumerate(self.children):
            mine = bits == i
            if mine.any():
                clash |= child.add(parent[mine], word[mine], count[mine])
        return clash

    def __len__(self) -> int:
        return len(self.kept[0]) + self.n_new + (sum(map(len, self.children)) if self.children else 0)

    def phrases(self) -> tuple[list, bool]:
        """What the subtree holds, a part for each container."""
        if self.children is None:
            clash = self.fold() if self.new else False
            if self.children is None:
                return [self.kept], clash
        else:
            clash = False
        out = []
        for child in self.children:
            more, bad = child.phrases()
            out += more
            clash |= bad
        return out, clash


def write_run(parent: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    """A run sorted by the words before the last, then the last."""
    order = np.lexsort((word, parent))
    return zstandard.ZstdCompressor(level=3).compress(parent[order].tobytes() + word[order].tobytes() + count[order].astype(np.uint32).tobytes())


def read_run(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(run)
    n = len(raw) // 20
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint64, n, 8 * n), np.frombuffer(raw, np.uint32, n, 16 * n).astype(np.int64)


class Trie:
    """Counts phrases of one length; ``spill`` gives runs ``(prefix partition, run, clash)``."""

    def __init__(self, partitions: int, limit: int):
        self.partitions, self.limit, self.roots, self.clash = partitions, limit, {}, False

    def add(self, prefix: np.ndarray, parent: np.ndarray, word: np.ndarray) -> None:
        spread = prefix ^ (prefix >> np.uint64(29))
        at = ((spread * _STEP) >> np.uint64(33)) % np.uint64(self.partitions)
        order = np.argsort(at, kind="stable")
        at, parent, word = at[order], parent[order], word[order]
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
        ones = np.ones(len(at), np.int64)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            root = self.roots.setdefault(int(at[low]), Node())
            self.clash |= root.add(parent[low:high], word[low:high], ones[low:high])

    def spill(self, to: int | None = None) -> Iterator[tuple[int, bytes, bool]]:
        """The largest subtrees, until at most ``to`` phrases are left; counts of over 32 bits leave in parts."""
        sizes = {k: len(root) for k, root in self.roots.items()}
        left = sum(sizes.values())
        for k in sorted(sizes, key=sizes.get, reverse=True):
            if to is not None and left <= to:
                break
            parts, clash = self.roots.pop(k).phrases()
            parent, word, count = (np.concatenate(c) for c in zip(*parts, strict=True))
            self.clash |= clash
            left -= sizes[k]
            yield k, write_run(parent, word, count), self.clash

    def full(self) -> bool:
        return sum(map(len, self.roots.values())) > self.limit


def count_runs(docs: DataFrame, k: int, shorter: Filter, partitions: int, limit: int, seed: int) -> DataFrame:
    """``part, run, clash``: runs of phrases of ``k`` words both of whose shorter phrases are in ``shorter``."""
    shared = docs.sparkSession.sparkContext.broadcast((shorter.words, shorter.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = {}, {}
        frequent = Filter(*shared.value)
        trie = Trie(partitions, limit)

        def look(lang: str) -> None:
            words = known.setdefault(lang, Words(lang, seed))
            a, b, end = words.of(held.pop(lang))
            if len(words) > KNOWN:
                del known[lang]
            n = len(a) - k + 1
            if n < 1:
                return
            ends = np.concatenate([[0], np.cumsum(end)])
            inside = ends[k:] == ends[:n]
            likely = frequent.holds(chain(b, k - 1))
            at = np.flatnonzero(inside & likely[:n] & likely[1 : n + 1])
            # hashes of the whole block are cheap beside looking words up
            trie.add(chain(a, 2)[at], chain(a, k - 1)[at], a[at + k - 1])

        def sent(runs: Iterator[tuple[int, bytes, bool]]) -> Iterator[pa.RecordBatch]:
            for part, one, clash in runs:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([one], pa.binary()), pa.array([clash])], names=["part", "run", "clash"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = held.setdefault(lang, [])
                mine += tokens(text)
                mine.append(_END)
                if len(mine) > BLOCK:
                    look(lang)
                    if trie.full():
                        yield from sent(trie.spill(limit // 2))
        for lang in list(held):
            look(lang)
        yield from sent(trie.spill())

    return docs.select("text", _lang()).mapInArrow(frugal(run), "part int, run binary, clash boolean")


def merged(runs: DataFrame, min_count: int) -> DataFrame:
    """``key, parent, word, a`` of phrases with ``min_count`` occurrences; a row of negative ``a`` says that hashes clash.

    A partition's runs arrive together and are folded as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, bad = None, [], 0, False

        def fold() -> None:
            nonlocal held, size, bad
            *one, clash = folded(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, size, bad = [tuple(one)], len(one[0]), bad | clash

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                fold()
                parent, word, count = held[0]
                keep = count >= min_count
                parent, word, count = parent[keep], word[keep], count[keep]
                if bad:
                    parent, word, count = (np.concatenate([x, np.array([y], x.dtype)]) for x, y in ((parent, 0), (word, 0), (count, -1)))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (parent * _STEP + word, parent, word, count)], names=["key", "parent", "word", "a"])

        for batch in batches:
            for p, one, clash in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    yield from settle()
                    part, held, size, bad = p, [], 0, False
                held.append(read_run(one))
                bad |= clash
                size += len(held[-1][0])
                if size > 2 * LIMIT and len(held) > 1 and size > 2 * len(held[0][0]):
                    fold()
        yield from settle()

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(frugal(run), "key long, parent long, word long, a long")


class Clash(Exception):
    """Two phrases of one hash."""


def _frequent(docs: DataFrame, words: DataFrame, total: int, min_count: int, longest: int, limit: int, seed: int) -> list[DataFrame]:
    """``lang, phrase, f, n_words`` of frequent words and phrases, a table for each length."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), _seeds(lang, seed)[0]) for lang, w in rows], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=["lang", "phrase", "f", "key"])

    single = words.where(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), "f")
    single = materialize(single.mapInArrow(keys, "lang string, phrase string, f long, key long"), "phrases-1")
    levels = [single]
    partitions = max(PARTITIONS, 1 << math.ceil(math.log2(max(1, total / WORDS_A_PARTITION))))
    for k in range(1, longest + 1):
        level = levels[-1]
        n, distinct = level.agg(F.count("*"), F.count_distinct("key")).first()
        if n != distinct:
            raise Clash
        if k == longest or n == 0:
            break
        found = materialize(merged(count_runs(docs, k + 1, phrase_filter(level, seed, n), partitions, limit, seed), min_count), f"phrases-{k + 1}-ids")
        if found.where("a < 0").limit(1).count():
            raise Clash
        first = level.select(F.col("key").alias("parent"), "lang", F.col("phrase").alias("_first"))
        last = single.select(F.col("key").alias("word"), F.col("phrase").alias("_last"))
        named = found.join(first, "parent").join(last, "word").select("lang", F.concat_ws(" ", "_first", "_last").alias("phrase"), F.col("a").alias("f"), "key")
        levels.append(materialize(named, f"phrases-{k + 1}"))
        discard(found)
    return [t.select("lang", "phrase", "f", F.lit(k).alias("n_words")) for k, t in enumerate(levels, 1)]


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, absorb: int = 100, limit: int = LIMIT, seed: int = 0) -> DataFrame:
    """The ``top`` phrases of each language of ``docs(text, lang)`` by score: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase has 2 to ``longest`` words within a piece and ``a >= min_count`` occurrences.  Cut
    after some of its words, its parts occur ``l`` and ``r`` times, and the score is
    ``1000 * a * n / (l * r)`` rounded down, of the cut that gives the lowest, the first of
    equals; ``n`` counts the language's words.  Phrases inside a longer candidate with
    ``absorb`` percent of their occurrences go.  Order: score and ``a`` descending, phrase.

    A null language is ``und``; null and empty texts have no words; texts of any length are
    read whole; repeated rows count each; other columns are left out; empty tables give none.
    """
    bounded_batches(docs.sparkSession)
    words = materialize(word_counts(docs), "phrase-words")
    totals = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    for attempt in range(8):
        try:
            levels = _frequent(docs, words, total, min_count, longest, limit, seed + attempt)
            break
        except Clash:
            continue
    else:
        raise RuntimeError("hashes of phrases clash with eight different seeds")
    counted = levels[0]
    for more in levels[1:]:
        counted = counted.unionByName(more)
    candidates = counted.where("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), "n_words")
    parts = candidates.withColumn("_w", F.split("phrase", " ")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    some = lambda start, n: F.array_join(F.slice("_w", start, n), " ")
    cuts = parts.select("lang", "phrase", "a", F.col("_k").alias("k"), some(F.lit(1), F.col("_k")).alias("_left"), some(F.col("_k") + 1, F.col("n_words") - F.col("_k")).alias("_right"))
    f = lambda name, to: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    cuts = cuts.join(f("_left", "l"), ["lang", "_left"]).join(f("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.expr("(1000BD * wa * wn) div (wl * wr)")
    scored = cuts.withColumns({"wa": wide("a"), "wn": wide("n"), "wl": wide("l"), "wr": wide("r")}).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    # a phrase inside one longer by several words is inside one longer by one, which has as many occurrences or more
    longer = parts.where("n_words > 2 and _k = 1").select("lang", F.explode(F.array(some(F.lit(1), F.col("n_words") - 1), some(F.lit(2), F.col("n_words") - 1))).alias("phrase"), F.col("a").alias("_a"))
    most = longer.groupBy("lang", "phrase").agg(F.max("_a").alias("_most"))
    stay = best.join(most, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (F.col("_most") * 100 < F.col("a") * absorb))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = stay.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir).select("text", "lang"))


SQL = f"""with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') ws from p),
g as ({" union all ".join(f"select lang, {k} k, unnest([array_to_string(ws[i:i + {k - 1}], ' ') for i in range(1, len(ws) - {k - 2})]) phrase from w where len(ws) >= {k}" for k in range(1, LONGEST + 1))}),
c as materialized (select lang, k, phrase, count(*) f from g group by all),
t as (select lang, sum(f) n from c where k = 1 group by 1),
cand as materialized (select lang, k, phrase, f a, string_split(phrase, ' ') ws from c where k > 1 and f >= {MIN_COUNT}),
cut as materialized (select cand.*, unnest(range(1, k)) j from cand),
sx as materialized (select cut.*, x.f l from cut join c x on x.lang = cut.lang and x.phrase = array_to_string(ws[:j], ' ')),
sy as materialized (select sx.*, y.f r from sx join c y on y.lang = sx.lang and y.phrase = array_to_string(ws[j + 1:], ' ')),
s as (select sy.*, n, 1000::hugeint * a * n // (l::hugeint * r) score from sy join t using (lang)),
b as materialized (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
q as (select * from b where not exists (select 1 from cand z where z.lang = b.lang and z.k > b.k and z.a >= b.a and contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' '))),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as place from q)
select lang, place::bigint as rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from o where place <= {TOP}"""
