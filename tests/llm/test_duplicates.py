"""Near duplicates, repeated passages and near vectors against brute force, and odd inputs."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from cortexframe.llm import minhash, neardup_vectors, suffixes

DATA = "/root/testdata/sf0.001"


def test_alignment_counts_common_runs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = minhash.labelled_shingles(rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64))
        b = a.copy() if rng.random() < 0.5 else minhash.labelled_shingles(rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64))
        b = np.delete(b, rng.integers(0, len(b))) if len(b) > 1 else b
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        common = table[-1, -1]
        want = common / (len(a) + len(b) - common)
        assert minhash.aligned_similarity(a, b) == pytest.approx(want if want >= 0.8 else 0.0)


def classes_by_brute_force(rows):
    known = {}
    for (d, _), w in zip(rows, minhash.word_hashes([t for _, t in rows]), strict=True):
        known.setdefault(d, minhash.labelled_shingles(w))
    ids = sorted(known)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if minhash.aligned_similarity(known[a], known[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == classes_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(1000)}" for _ in range(300)]
    rows = []
    for i in range(700):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10_000)}" for _ in range(80))) for i in range(50)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in out if r["doc_id"] < 700} == {0} and sum(r["kept"] for r in out) == 51


def template_family(families: int) -> list[tuple[int, str]]:
    """Two near copies a family, far apart by id; families are one template's six passages in different orders, alike by 0.7 at most."""
    rng = random.Random(3)
    passages = [[f"v{i}w{k}" for k in range(20)] for i in range(6)]
    rows, later = [], rng.sample(range(families), families)
    for i, order in enumerate(rng.sample(list(itertools.permutations(range(6))), families)):
        words = [w for p in order for w in passages[p]]
        rows.append((i, " ".join(words)))
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((families + later[i], " ".join(words)))
    return rows


def test_pairs_within_a_template_match_brute_force(spark):
    """In large buckets most members are neither linked to the head nor to the neighbour by length."""
    rows = template_family(550)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = minhash.sketches(docs).select(minhash.F.explode("bands").alias("band")).groupBy("band").count()
    assert buckets.agg(minhash.F.max("count")).first()[0] > 500
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == classes_by_brute_force(rows) and len(set(got.values())) == 550


def test_common_shingles_are_counted():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(12)]
    assert (minhash.common_shingles(sets) == [[len(np.intersect1d(a, b)) if i != j else (np.isin(a, np.concatenate(sets[:i] + sets[i + 1 :]))).sum() for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()


def test_texts_of_ids(spark, monkeypatch):
    """Just the ids asked for, each with all its texts, through a filter of ample size and a full one."""
    from cortexframe.llm import common

    rows = [(i, f"text {i}") for i in range(400)] + [(5, "another"), (5, "another"), (7, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in [*range(0, 400, 7), 5, 999]], "id long")
    for bits in (28, 6):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = sorted((r["id"], t.decode()) for r in common.texts_of(docs, ids).collect() for t in common.unpack_texts([r["z"]]))
        assert got == sorted([(i, f"text {i}") for i in [*range(0, 400, 7), 5]] + [(5, "another")])


def test_near_duplicates_of_a_repeated_id(spark):
    """Any text of a doc_id links it."""
    rng = random.Random(9)
    one, two = ([f"{k}{rng.randrange(500)}" for _ in range(80)] for k in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one[:-1], "x"])), (3, " ".join([*two[:-1], "y"])), (4, "alone")]
    got = {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_texts_under_one_id_are_one_class(spark):
    """An id with two texts joins both classes; of an id that stands for two texts, pairs within a bucket are looked for with each."""
    x, y = (" ".join(f"{k}{i}" for i in range(40)) for k in "xy")
    rows = [(3, x), (5, x), (5, y), (9, y), (12, "alone"), (12, None)]
    got = {(r["doc_id"], r["class_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (12, 12, True)}
    # each pair of a template's families under two ids that also have a text of their own
    family = template_family(300)
    rows = family + [(d, f"another text of {d}") for d, _ in family]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_brute_force(family) and len(set(got.values())) == 300


def test_no_text_is_wanted_by_its_whole_bucket(spark):
    """A bucket's first member meets its subgroup and the firsts of the other subgroups."""
    classes = spark.range(5000).select(minhash.F.col("id").alias("rep"), minhash.F.lit(100).alias("n"), minhash.F.array(minhash.F.lit(7).cast("long")).alias("bands"))
    pairs = minhash.candidate_pairs(classes, group=50)
    ends = pairs.select(minhash.F.explode(minhash.F.array("a", "b")).alias("id")).groupBy("id").count()
    assert ends.agg(minhash.F.max("count")).first()[0] < 300 and ends.count() == 5000
    assert minhash.components(pairs).select("component").distinct().count() == 1


def test_near_duplicates_odd_inputs(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, "  "), (4, "a b"), (5, "A  b"), (6, "x y z u v w " * 5000), (7, "x y z u v w " * 5000), (7, "x y z u v w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", minhash.F.lit(1)).withColumn("band", minhash.F.lit(2))
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == 9
    by = {r["doc_id"]: r["class_id"] for r in out}
    assert by == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def removed_by_brute_force(rows, length):
    """Rows of (doc_id, text) with distinct ids, in any order."""
    first, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in first:
                gone[i : i + length] = True
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [5000, 1])
@pytest.mark.parametrize("length", [50, 9])
def test_passages_match_brute_force(spark, length, hot):
    """With buckets refined in sorted tasks, and all as if they were hot."""
    rng = random.Random(length)
    phrases = ["".join(rng.choice("ab é") for _ in range(rng.randint(5, 120))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(phrases) if rng.random() < 0.5 else "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200, "a" * 400), (201, "b" + "a" * 300), (202, None), (203, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_passages(docs, length, hot).collect()}
    assert got == removed_by_brute_force(rows, length)


@pytest.mark.parametrize("length", [50, 33, 20, 9, 8])
def test_pointers_are_equal_where_windows_are(length):
    """For windows of several documents; a bucket of several texts has one document only."""
    rng = random.Random(length)
    phrases = ["".join(rng.choice("ab") for _ in range(70)) for _ in range(5)]
    texts = [rng.choice(phrases)[rng.randrange(10) :] if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(length + rng.randrange(30))) for _ in range(300)]
    docs = np.array([rng.randrange(40) for _ in texts])
    owner, place, pointer = suffixes.bucket_pointers([t.encode() for t in texts], docs, length)
    assert len(owner) == sum(max(0, len(t) - length + 1) for t in texts)
    by_text, by_pointer = {}, {}
    for i, k, p in zip(owner.tolist(), place.tolist(), pointer.tolist(), strict=True):
        window = texts[i][k : k + length]
        by_text.setdefault(window, set()).add((int(docs[i]), p))
        by_pointer.setdefault(p, set()).add((int(docs[i]), window))
    assert all(len({p for _, p in of}) == 1 for of in by_text.values() if len({d for d, _ in of}) > 1)
    assert all(len({d for d, _ in of}) == 1 for of in by_pointer.values() if len({w for _, w in of}) > 1)


@pytest.mark.parametrize("hot", [5000, 1])
def test_passages_of_repeated_ids_match_brute_force(spark, hot):
    """Rows of one doc_id with different texts: each loses what its own text shares with smaller ids."""
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, tail = part(70), part(70), part(20)
    rows = [(1, a), (2, a + tail), (2, b + tail), (2, "short"), (3, b), (3, b), (3, part(30) + tail + b), (4, a + b), (4, b + part(90)), (4, ""), (5, None), (5, tail + a)]
    phrases = [part(rng.randint(20, 100)) for _ in range(8)]
    rows += [(rng.randrange(10, 20), "".join(rng.choice(phrases) + part(rng.randint(0, 9)) for _ in range(rng.randint(1, 6)))) for _ in range(40)]
    want = []
    for d, t in rows:
        lower = {x[i : i + 50] for e, y in rows if e < d for x in [(y or "").encode()] for i in range(len(x) - 49)}
        text = (t or "").encode()
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 49):
            if text[i : i + 50] in lower:
                gone[i : i + 50] = True
        want.append((d, len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50, hot).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_passages_odd_inputs(spark):
    long = "word " * 20_000
    rows = [(None, long), (1, long), (1, long), (2, long), (3, None), (4, "é" * 30), (5, "x" + "é" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", suffixes.F.lit(1)).withColumn("z", suffixes.F.lit(2))
    out = [r.asDict() for r in suffixes.repeated_passages(docs, with_text=True).collect()]
    assert len(out) == 7
    by = {(r["doc_id"], r["n_bytes"]): r for r in out}
    assert by[(None, 100_000)]["n_removed"] == 0 and by[(1, 100_000)]["n_removed"] == 0
    assert by[(2, 100_000)]["n_removed"] == 100_000 and by[(2, 100_000)]["kept_text"] == ""
    assert by[(3, 0)]["kept_text"] is None and by[(5, 61)]["kept_text"] == "x"
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    k = np.sort(rng.integers(0, 1 << 48, 1000).astype(np.uint64))
    d, f = rng.integers(-5, 1 << 40, 1000), rng.random(1000) < 0.5
    got = suffixes.decode_block(suffixes.encode_block(k, d, f))
    assert all((a == b).all() for a, b in zip(got, (k, d, f), strict=True))


def links_by_brute_force(x, least=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[near[i]].min() if near[i].any() else label[i]) for i in range(len(x))])
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize(("rows", "planned"), [(6000, 1500), (50, 1500), (6000, 5_000_000), (50, 200_000_000)])
def test_vectors_match_brute_force(spark, rows, planned):
    """Cells whole and split, and named as they are among more vectors."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 64))
    x[300:600] = x[rng.integers(0, 50, 300)] + rng.normal(0, 0.12, (300, 64))
    x[600:640] = x[0]
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    plan = neardup_vectors.plan_for(planned)
    distinct = frame.groupBy(neardup_vectors.F.col("embedding").alias("v")).agg(neardup_vectors.F.min("vec_id").alias("id"), neardup_vectors.F.count("*").alias("copies"))
    found = neardup_vectors.vector_links(distinct, plan, rows).groupBy("id").agg(neardup_vectors.F.sum("links").alias("n")).collect()
    degree, label = links_by_brute_force(x.astype(np.float64))
    want = {i: int(n) for i, n in enumerate(degree) if not 600 <= i < 640}
    want[0] -= 40
    total = sum(want.values())
    got = {r["id"]: r["n"] for r in found}
    assert all(n <= want[i] for i, n in got.items()) and sum(got.values()) >= 0.97 * total
    out = {r["vec_id"]: r for r in neardup_vectors.near_duplicate_vectors(frame).collect()}
    assert sum(out[i]["n_links"] == degree[i] for i in out) >= 0.97 * len(out)
    assert sum(out[i]["component_id"] == label[i] for i in out) >= 0.99 * len(out)
    assert all(out[i]["n_links"] >= 39 for i in range(600, 640))


@pytest.mark.parametrize("planned", [10_000, 100_000_000])
def test_pairs_at_the_threshold_are_caught(spark, planned):
    """The worst case: all pairs have a cosine just above 0.95."""
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=(600, 64)), rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(i, 1, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    found = neardup_vectors.vector_links(spark.createDataFrame(rows, "id long, copies long, v array<double>"), neardup_vectors.plan_for(planned))
    assert found.count() >= 0.96 * 1200


def test_components_with_hubs(spark, monkeypatch):
    """Hubs of least, middle and greatest id, joined, and broadcast."""
    from cortexframe.llm import common

    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 300)] + [(1500, i) for i in range(1000, 2000) if i != 1500] + [(9000, i) for i in range(3000, 3300)]
    edges += [(i, i + 1) for i in range(4000, 4200)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(150)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    frame = spark.createDataFrame(edges, "a long, b long")
    for hot in (100_000, 60):
        monkeypatch.setattr(common, "HOT_EDGES", hot)
        got = {r["id"]: r["component"] for r in common.components(frame).collect()}
        assert got == want


def test_vectors_odd_inputs(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 0.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", neardup_vectors.F.lit(0)).withColumn("v", neardup_vectors.F.lit(0))
    out = neardup_vectors.near_duplicate_vectors(frame).collect()
    assert len(out) == 12
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out} == {
        1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (3, 7, True), 8: (3, 7, False), 9: (3, 7, False), 10: (0, 10, True), None: (0, None, True)
    }
    assert neardup_vectors.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_passages_of_a_whole_table(spark):
    """Many blocks of runs, dealt by adaptive plans: all bytes of 20 MB of texts against brute force, with columns carried along."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    again = docs.where("doc_id % 50 = 0").withColumn("doc_id", suffixes.F.col("doc_id") - 7).withColumn("source", suffixes.F.lit("again"))
    docs = docs.unionByName(again)
    rows = docs.collect()
    texts = [np.frombuffer((r["text"] or "").encode(), np.uint8) for r in rows]
    names = []
    with np.errstate(over="ignore"):
        for data in texts:
            start = np.arange(max(0, len(data) - 49))
            names.append(suffixes.range_hash(suffixes.prefix_sums(data), start, start + 50))
    who = np.repeat([r["doc_id"] for r in rows], [len(n) for n in names])
    every = np.concatenate(names)
    order = np.lexsort((who, every))
    first = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
    known, least = every[order][first], who[order][first]
    want = []
    for r, data, own in zip(rows, texts, names, strict=True):
        edge = np.zeros(len(data) + 51, np.int64)
        at = np.flatnonzero(least[np.searchsorted(known, own)] < r["doc_id"])
        edge[at] += 1
        edge[at + 50] -= 1
        gone = np.cumsum(edge)[: len(data)] > 0
        want.append((r["doc_id"], r["source"], len(data), int(gone.sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
    got = suffixes.repeated_passages(docs, carry=("source",)).select("doc_id", "row.source", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_vectors_under_one_id_are_kept_apart(spark):
    """Two vectors of vec_id 1, one with one link and one with two."""
    rng = np.random.default_rng(8)
    a, b, c = np.linalg.qr(rng.normal(size=(16, 3)))[0].T
    near = lambda x, e: (x + e * c).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a, 0.01)), (3, near(b, 0.01)), (4, near(b, 0.02)), (9, c.tolist())]
    out = neardup_vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (9, 0, 9)]


@pytest.mark.parametrize("planned", [400, 10_000, 1_000_000, 100_000_000])
def test_pairs_at_the_threshold_are_caught(spark, planned):
    """The worst case, cosine 0.9502, under plans for other numbers of vectors than there are."""
    rng = np.random.default_rng(planned)
    x, z = rng.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9502 * x + np.sqrt(1 - 0.9502**2) * z
    rows = [(i, 1, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    found = neardup_vectors.vector_links(spark.createDataFrame(rows, "id long, copies long, v array<double>"), neardup_vectors.plan_for(planned))
    caught = {r["id"] % 1500 for r in found.collect()}
    assert len(caught) >= 0.99 * 1500


def test_order_minhash_finds_every_link_of_a_table(spark):
    """All pairs of different texts of sf0.01 by brute force: classes are the components of those at 0.8 or more."""
    got = {r["doc_id"]: r["class_id"] for r in minhash.op8_order_minhash(spark, "/root/testdata/sf0.01").collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    same: dict[bytes, int] = {}
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kept = []
    for d, w in sorted(zip([d for d, _ in docs], minhash.word_hashes([t for _, t in docs]), strict=True), key=lambda p: p[0]):
        if len(w):
            first = same.setdefault(w.tobytes(), d)
            root[d] = first
            if first == d:
                kept.append((d, minhash.labelled_shingles(w)))
    kept.sort(key=lambda p: len(p[1]))
    links = 0
    for i, (a, x) in enumerate(kept):
        for b, y in kept[i + 1 :]:
            if len(x) < 0.8 * len(y):
                break
            if minhash.aligned_similarity(x, y) > 0:
                links += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert links > 0 and all(got[d] == find(d) for d, _ in docs)
