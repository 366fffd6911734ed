"""Collocations, resampling and personal data: SQL, brute force, odd inputs."""

import collections
import math
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexframe.llm import collocations, pii, registry, resampling

DATA = "/root/testdata/sf0.001"


def odd(spark):
    rows = [(None, "some words here", "en"), (1, None, None), (2, "", "en"), (3, " \n\t", "en"), (4, "ab " * 30_000, "en"), (4, "ab " * 30_000, "en"), (5, "123 456 !!", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("rank", F.lit("y"))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    fix = lambda df: df.apply(lambda c: c.astype("Int64") if c.dtype.kind == "f" else c)
    assert key(fix(got)) == key(fix(want))


def brute_phrases(rows, min_count, longest, top):
    found, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    found[(lang or "und", tuple(words[i : i + n]))] += 1
    out = collections.defaultdict(list)
    often = {k: a for k, a in found.items() if a >= min_count and len(k[1]) > 1}
    for (lang, w), a in often.items():
        cuts = [(1000 * a * total[lang] // (found[(lang, w[:k])] * found[(lang, w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(lg == lang and len(z) > len(w) and b >= a and any(z[i : i + len(w)] == w for i in range(len(z))) for (lg, z), b in often.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(w).encode(), found[(lang, w[:k])], found[(lang, w[k:])], total[lang]))
    return sorted((lang, i, p.decode(), -a, left, right, n, -s) for lang, rows in out.items() for i, (s, a, p, left, right, n) in enumerate(sorted(rows)[:top], 1))


def texts(seed, n=300):
    rng = np.random.default_rng(seed)
    words = [*"abcdefgh", "Été", "\x00x", "\x1cy", "é"]
    join = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]
    out = []
    for i in range(n):
        chosen = rng.choice(words, rng.integers(1, 60), p=np.array([0.3, *[0.7 / 11] * 11]))
        out.append(("".join(w + rng.choice(join) for w in chosen), ["en", "de", None, "und"][i % 4]))
    return out + [("new york city hall " * 20, "en")] * 3


@pytest.mark.parametrize(("limit", "burst"), [(1_000_000, 32_768), (60, 8)])
def test_phrases_match_brute_force(spark, monkeypatch, limit, burst):
    """Also where every task spills its trie again and again and containers burst."""
    monkeypatch.setattr(collocations, "BURST", burst)
    monkeypatch.setattr(collocations, "BLOCK", 200 if limit < 100 else 400_000)
    rows = texts(1)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.mine(docs, min_count=12, top=40, limit=limit).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 12, 5, 40)


def test_trie_counts_what_it_is_given(monkeypatch):
    """Bursts and spills in this process: runs hold every phrase's count, sorted, of its prefix's partition only."""
    monkeypatch.setattr(collocations, "BURST", 32)
    rng = np.random.default_rng(3)
    trie, want, runs = collocations.Trie(16, 500), collections.Counter(), []
    for _ in range(20):
        a, b = (rng.integers(1, 60, 3000).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) for _ in range(2))
        want.update(zip(a.tolist(), b.tolist(), strict=True))
        trie.add(a, a, b)
        runs += [*trie.spill(250)] if trie.full() else []
    assert any(root.children for root in trie.roots.values()) or len(runs) > 16
    runs += [*trie.spill()]
    got, home = collections.Counter(), {}
    for part, run, clash in runs:
        parent, word, count = collocations.read_run(run)
        assert not clash and (np.diff(parent.astype(object)) >= 0).all()
        for p, w, c in zip(parent.tolist(), word.tolist(), count.tolist(), strict=True):
            got[(p, w)] += c
            assert home.setdefault(p, part) == part
    assert got == want


def test_shared_hashes_are_noticed():
    step = int(collocations._STEP)
    parent, word = np.array([1, 2], np.uint64), np.array([step, 0], np.uint64)
    assert collocations.folded(parent, word, np.ones(2, np.int64))[3]
    assert not collocations.folded(parent, np.array([5, 6], np.uint64), np.ones(2, np.int64))[3]


def test_phrases_odd_inputs(spark):
    got = {(r["lang"], r["phrase"]): r for r in collocations.mine(odd(spark), min_count=50).collect()}
    # "ab" 60,000 times in two texts; the longest phrase is in two places less a word each, so the shorter ones stay
    assert {k[0] for k in got} == {"en"} and len(got) == 4
    assert got[("en", "ab ab")]["a"] == 59_998 and got[("en", "ab ab")]["n"] == 60_003
    assert collocations.mine(odd(spark).limit(0)).count() == 0
    assert collocations.mine(odd(spark), min_count=10**6).count() == 0


def test_big_products_are_exact(spark):
    """1000 * a * n beyond 64 bits."""
    df = spark.createDataFrame([(10**12 + 7, 10**13 + 9, 10**12 + 7, 10**12 + 11)], "wa long, wn long, wl long, wr long")
    df = df.select(*[F.col(c).cast("decimal(38,0)").alias(c) for c in df.columns])
    (got,) = df.select(F.expr("(1000BD * wa * wn) div (wl * wr)")).first()
    assert got == 1000 * (10**12 + 7) * (10**13 + 9) // ((10**12 + 7) * (10**12 + 11))


def brute_resample(rows, target, percent=10, buckets=10_000, seed=2024):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    import hashlib
    import zlib

    at = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = collections.Counter(at(w) for _, x in rows for w in find(x)), collections.Counter(at(w) for x in target for w in find(x))
    ns, nt = s.total(), t.total()
    out = []
    for doc_id, text in rows:
        found = find(text)
        gains = [math.floor(1000 * math.log((t[at(w)] + 1) * (ns + buckets) / ((s[at(w)] + 1) * (nt + buckets)))) for w in found]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return out


@pytest.mark.parametrize("accuracy", [10_000, 10])
def test_resampling_matches_brute_force(spark, accuracy):
    """With a sketch of ten values too, whose bracket is often wrong and is widened."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["Haus", "été", "x1", "the", "of-the", " ", "q"], rng.integers(0, 60)))) for i in range(1500)]
    target = ["the the of x1", None, "été"]
    docs, like = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, like, percent=13, accuracy=accuracy).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, brute_resample(rows, target, 13)), key=lambda r: r[0])


def test_wrong_brackets_are_widened(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(1000)], "doc_id long, score long")
    for accuracy in (1, 2, 10_000):
        for wanted in (1, 2, 499, 999, 1000):
            assert resampling.cutoff(rows, wanted, 1000, accuracy)[0] == 1000 - wanted


def test_resampling_odd_inputs(spark):
    like = spark.createDataFrame([("some words",), (None,)], "text string")
    out = resampling.resample(odd(spark), like, percent=50)
    rows = {(r["doc_id"], r["n_features"]): r for r in out.collect()}
    assert out.count() == 7 and rows[(1, 0)]["weight"] == 0 and rows[(None, 3)]["rank"] is None
    # two rows of one doc_id are long enough; one of them is drawn
    assert sorted(str(r["rank"]) for r in out.where("doc_id = 4").collect()) == ["1", "None"]
    assert resampling.resample(odd(spark).limit(0), like).count() == 0
    copies = spark.createDataFrame([(7, "w " * 30)] * 500 + [(8, "w " * 30)], "doc_id long, text string")
    ranks = [r["rank"] for r in resampling.resample(copies, like, percent=60).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 301))
    assert resampling.resample(copies, like.limit(0), longest=2).where("n_features = 59").count() == 501


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_brute_force(spark):
    rng = np.random.default_rng(11)
    parts = ["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "0255.1.1.256", "300.1.2.3", "+1 (132) 555-1352", "+49", "4111 1111 1111 1111", "4111111111111112", " ", "-", "é", "😀", "x", "\n", "%", "(", "1", "5555-5555-5555-4444", "a.b.c@x-y.z."]
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 30)))) for i in range(2000)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    base = [k.name for k in pii.KINDS if k.base]
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in base] == brute_spans(r["text"])


def test_checks_and_words_nearby(spark):
    rows = [
        (1, "IBAN: DE89 3704 0044 0532 0130 00."), (2, "DE88 3704 0044 0532 0130 00"), (3, "GB29NWBK60161331926819 GB29NWBK60161331926818"), (4, "my SSN is 123-45-6789"), (5, "part 123-45-6789"),
        (6, "ssn 000-45-6789 ssn 123-00-6789 ssn 923-45-6789 ssn 1123-45-6789"), (7, "amex card 378282246310005"), (8, "378282246310005"), (9, "write to a@b.de"), (10, "a@b.de"),
    ]
    out = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["score"]) for s in r["spans"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == [("iban", 6, 33, 100)] and out[2] == [] and out[3] == [("iban", 0, 22, 75)]
    assert out[4] == [("ssn", 10, 21, 55)] and out[5] == [] and out[6] == []
    assert out[7] == [("shortcard", 10, 25, 55)] and out[8] == []
    assert out[9][0][3] > out[10][0][3] == 90


def test_masking(spark):
    rows = [(1, "a@b.c and a@b.c, 1.2.3.4 or 1.2.3.400", 5), (2, None, 5), (3, "", 5)]
    out = {r["doc_id"]: r for r in pii.mask_personal_data(spark.createDataFrame(rows, "doc_id long, text string, n int"), pii.KINDS[:2]).collect()}
    assert out[1]["text"] == "<email> and <email>, <ip> or 1.2.3.400" and out[2]["text"] is None and out[3]["text"] == "" and out[1]["n"] == 5


def test_personal_data_odd_inputs(spark):
    out = pii.find_personal_data(odd(spark))
    assert out.count() == 7 and all(r["spans"] == [] for r in out.collect()) and out.columns.count("spans") == 1
    assert pii.find_personal_data(odd(spark).limit(0)).count() == 0


def test_long_runs_take_linear_time(spark):
    """Texts of 300,000 characters for which plain patterns take quadratic time or a deep stack."""
    n = 300_000
    rows = [(i, t) for i, t in enumerate(["a" * n, "1" * n, "1 " * (n // 2), "a@" * (n // 2), "a@b" + ".c" * (n // 2), "+1" + " " * n, "1." * (n // 2), "a@b.c " * (n // 60)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    docs.count()
    began = time.perf_counter()
    got = {r["doc_id"]: r["n"] for r in pii.find_personal_data(docs).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got[7] == n // 60 and got[4] == 1 and got[0] == 0
    assert time.perf_counter() - began < 60
