"""Toxicity, language and perplexity: held-out accuracy, brute force, odd inputs."""

import collections
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cortexframe.llm import langid, perplexity, toxicity
from cortexframe.llm.common import crc_mod

DATA = "/root/testdata/sf0.01"


def odd(spark):
    rows = [(None, "some words here", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, "ab " * 30_000, "en", "a"), (4, "ab " * 30_000, "en", "a"), (5, "123 456 !!", "de", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit(1)).withColumn("z", F.lit("x"))


def test_subwords_are_those_of_each_word():
    words = ["ab", "idiot", "é", "idiots"]
    buckets, counts = toxicity.subwords(words)
    parts = np.split(buckets, np.cumsum(counts)[:-1])
    for w, got in zip(words, parts, strict=True):
        one, n = toxicity.subwords([w])
        assert sorted(one) == sorted(got) and n[0] == sum(max(0, len(w) + 2 - k + 1) for k in range(3, 7)) + 1
    assert len(set(parts[1].tolist()) & set(parts[3].tolist())) > 8


def test_toxicity_held_out(spark):
    """On rows whose labels were not looked at; the smaller tables hold too few of them."""
    large = "/root/testdata/sf0.1"
    out = toxicity.op2_toxicity(spark, large).toPandas().set_index("doc_id")
    labels = pq.read_table(f"{large}/labels.parquet").to_pandas().set_index("doc_id")
    assert len(out) == 10_000 and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    both = out.join(labels, how="inner")
    held = both[both["held_out"]]
    toxic, rest = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert len(toxic) > 80 and toxic["predicted"].mean() > 0.8 and rest["predicted"].mean() < 0.04
    assert (toxic["score"].to_numpy()[:, None] > rest["score"].to_numpy()).mean() > 0.93


def test_scores_match_a_word_by_word_sum():
    """The vectorized score against each word's n-grams averaged one by one."""
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.3, 1.7, -2.0)
    sets = [{"some", "words"}, {"idiots", "é", "x" * 50}, set()]

    def one(word):
        buckets, n = toxicity.subwords([word])
        assert len(buckets) == n[0]
        return float(np.mean([model.row[b] for b in buckets])) + model.bias

    want = [1 / (1 + math.exp(-(model.slope * max(map(one, s)) + model.offset))) if s else 0.0 for s in sets]
    assert np.allclose(model.score(sets), want, rtol=1e-5)


def test_toxicity_generalises_to_misspellings():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    pairs = []
    for i in range(600):
        words = set(rng.choice(plain, 40).tolist())
        pairs.append((words | ({str(rng.choice(["zylwort", "quxxor"]))} if i % 3 == 0 else set()), int(i % 3 == 0)))
    model = toxicity.train(pairs, 0.3)
    clean, bad, misspelt = model.score([set(plain[:40]), {*plain[:40], "zylwort"}, {*plain[:40], "zylworts"}])
    assert clean < 0.3 < bad and misspelt > clean


def test_toxicity_odd_inputs(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd(spark), labels, None)
    out = toxicity.score_toxicity(odd(spark), model).collect()
    assert len(out) == 7 and all(0 <= r["_toxicity"] <= 1 for r in out)
    assert toxicity.score_toxicity(odd(spark).limit(0), model).count() == 0


def test_language_held_out(spark):
    out = langid.op6_language_bitmask(spark, DATA).toPandas().set_index("doc_id")
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pandas().set_index("doc_id")
    both = out.join(docs)
    assert len(out) == 1000 and out["score"].between(0, 1).all()
    assert (both[both["held_out"]]["lang"] == both[both["held_out"]]["lang_pred"]).mean() > 0.97


def test_language_odd_inputs(spark):
    model = langid.build({"en": ["the cat and the dog", "the dog and a cat"], "de": ["der hund und die katze", "die katze und der hund"]})
    out = {(r["doc_id"], r["text"]): r["lang_pred"] for r in langid.identify(odd(spark), model).collect()}
    assert out[(1, None)] == out[(2, "")] == out[(3, " \n\t")] == out[(5, "123 456 !!")] == "und"
    assert model.predict("the dog")[0] == "en" and model.predict("die katze")[0] == "de"
    assert langid.build({}).predict("words") == ("und", 0.0)
    assert langid.identify(odd(spark).limit(0), model).count() == 0
    clash = langid.identify(odd(spark).withColumn("lang_pred", F.lit(1)), model)
    assert clash.columns.count("lang_pred") == 1 and dict(clash.dtypes)["lang_pred"] == "string"


def test_language_counts_match_sets():
    """Corrected popcounts of the filters against exact sets of n-grams."""
    rng = np.random.default_rng(2)
    words = {k: ["".join(rng.choice(list(a), rng.integers(2, 8))) for _ in range(400)] for k, a in (("a", "abcdefgh"), ("b", "efghijkl"), ("c", "ijklmnop"))}
    texts = {k: [" ".join(rng.choice(w, 60)) for _ in range(30)] for k, w in words.items()}
    model = langid.build(texts)
    known = {}
    for k, own in texts.items():
        grams = [set(langid.gram_hashes(langid.letters(t)).tolist()) for t in own]
        known[k] = {g for g in set().union(*grams) if sum(g in s for s in grams) >= 2}
        assert model.hit_rate[model.languages.index(k)] == pytest.approx(np.mean([len(s & known[k]) / len(s) for s in grams]))
    for k in texts:
        text = " ".join(rng.choice(words[k], 80))
        grams = langid.gram_hashes(langid.letters(text)).tolist()
        exact = np.array([sum(g in known[x] for g in grams if 0 < sum(g in known[y] for y in known) < 3) for x in model.languages])
        counts, n = model.counts(text)
        assert (counts >= exact).all() and np.abs(counts - n * model.false_rate - exact).max() <= 0.02 * len(grams) + 2
        assert model.predict(text)[0] == k


def test_language_masks_hold_every_gram():
    texts = {"a": ["alpha beta gamma", "alpha beta gamma"], "b": ["delta epsilon beta", "delta epsilon beta"]}
    model = langid.build(texts)
    for k, language in enumerate(model.languages):
        one, two = langid.slots(langid.gram_hashes(langid.letters(texts[language][0])))
        assert ((model.table[one, 0] & model.table[two, 0]) >> np.uint64(k) & np.uint64(1)).all()


def brute_kneser_ney(trusted: list[str], asked: list[str]):
    """Straight from the definitions, with strings."""
    n = perplexity.ORDER
    pad = lambda t: " " * (n - 1) + t
    top = collections.Counter(pad(t)[i : i + n] for t in trusted for i in range(len(t)))
    counts = {n: top}
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cuts, totals, held = {}, {}, {}
    for k, c in counts.items():
        t = collections.Counter(c.values())
        y = t[1] / (t[1] + 2 * t[2])
        cuts[k] = [min(max(j - (j + 1) * y * t[j + 1] / t[j], 0.1), j - 0.05) if t[j] else 0.5 for j in (1, 2, 3)]
        totals[k], held[k] = collections.Counter(), collections.Counter()
        for g, v in c.items():
            totals[k][g[:-1]] += v
            held[k][g[:-1]] += cuts[k][min(v, 3) - 1]
    v = len(counts[1]) + 1

    def p(g: str) -> float:
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / v
        c, total = counts[k][g], totals[k][g[:-1]]
        if not total:
            return low
        own = (c - cuts[k][min(c, 3) - 1]) / total if c else 0.0
        return own + held[k][g[:-1]] / total * low

    return [math.exp(-sum(math.log(p(pad(t)[i : i + n])) for i in range(len(t))) / len(t)) for t in asked]


@pytest.fixture(scope="module")
def small(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "zzzz qqqq xxxx", "the mat and the log"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in (0, 1, 2, 4)] + [(3, 0)], "doc_id long, quality int")
    train = [r["text"] for r in docs.where((crc_mod("doc_id", 4) != 3) & (F.col("doc_id") != 3)).collect()]
    return texts, docs, labels, train


@pytest.mark.parametrize("rows", [10_000, 40])
def test_perplexity_is_kneser_ney(spark, small, rows):
    """With the table of probabilities in one shard and in several."""
    texts, docs, labels, train = small
    out = perplexity.perplexities(docs, labels, shard_rows=rows).orderBy("doc_id").collect()
    assert np.allclose([r["perplexity"] for r in out], brute_kneser_ney(train, texts), rtol=1e-5)


def test_perplexity_odd_inputs(spark):
    """Nulls, repeats and one doc_id with several texts; alike whatever the number of shards."""
    labels = spark.createDataFrame([(1, 1), (4, 1), (None, 1), (2, 0), (2, None)], "doc_id long, quality int")
    more = [(None, "other text of no number", "en"), (None, "abab", "de"), (4, "quite different words", "en"), (4, "ab ab ab", "de"), (0, "some words here", "en")]
    docs = odd(spark).select("doc_id", "text", "lang", "z").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string").withColumn("z", F.lit("y")))

    def rows(bound):
        out = [r.asDict() for r in perplexity.perplexities(docs, labels, shard_rows=bound).collect()]
        return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_scored"], r["lang"] or ""))

    one, several = rows(10_000), rows(20)
    assert len(one) == 12 and [r["n_scored"] for r in one if r["doc_id"] == 4] == [8, 21, 89_999, 89_999]
    assert all(r["kept"] and r["perplexity"] is None for r in one if r["n_scored"] == 0)
    assert one == several
    assert perplexity.perplexities(docs.limit(0), labels).count() == 0


def test_symbols_of_large_alphabets_differ(spark):
    """Frequent Han characters have symbols of their own, those beyond the last symbol share one."""
    frequent = [chr(0x4E00 + i) for i in range(4000)]
    docs = spark.createDataFrame([(1, "".join(frequent) * 2), (2, "".join(chr(0xAC00 + i) for i in range(3000)))], "doc_id long, text string")
    letters = perplexity.alphabet(docs)
    got = letters.grams("".join(frequent)) & (perplexity.CLASSES - 1)
    assert len(set(got.tolist())) == 4000 and 0 not in got
    rare = letters.grams("".join(chr(0xAC00 + i) for i in range(3000))) & (perplexity.CLASSES - 1)
    assert (rare == 0).sum() > 2000


def test_junk_scores_high(spark):
    out = perplexity.op10_kneser_ney(spark, DATA).toPandas().set_index("doc_id")
    labels = pq.read_table(f"{DATA}/labels.parquet").to_pandas().set_index("doc_id")
    both = out.join(labels, how="inner")
    assert both[both["quality"] == 1]["kept"].mean() > 0.98 and both[both["quality"] == 0]["kept"].mean() < 0.5
