"""Mixing, media, pages, packing and the pipeline."""

import collections
import hashlib
import itertools
import re
import time
import weakref
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cortexframe.llm import common, htmltext, media, mixing, packing

DATA = "/root/testdata/sf0.001"


def targets_by_brute_force(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, total = {}, share * sum(sizes.values())
    while True:
        rest = [n for n in names if n not in full]
        left = total - sum(full.values())
        got = {n: left * w[n] / sum(w[m] for m in rest) for n in rest}
        above = [n for n in rest if got[n] > cap * sizes[n]]
        if not above:
            return full | got
        full |= {n: cap * sizes[n] for n in above}


def test_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = mixing.op1_mix_sources(spark, DATA).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert len(out) == len(texts)
    sizes, taken, largest = {}, {}, {}
    for r in out:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]["text"] or ""))
        s = texts[r["doc_id"]]["source"]
        assert r["size"] == n and 0 <= r["taken"] <= 2 * n
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), n)
    want = targets_by_brute_force(sizes)
    for r in out:
        s = texts[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in out}


def test_mix_expectation_and_hot_source(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 9}", "w " * (1 + i % 5)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(docs, fan_in=16).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in out) == 6000 and all(abs(r["t"] - r["g"]) <= 5 for r in out)


def test_mix_odd_inputs(spark):
    rows = [(None, None, "a b"), (1, None, None), (2, "a", ""), (3, "b", "x " * 50_000), (4, "b", "y"), (4, "b", "y"), (5, "c", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(9)).withColumn("src", F.lit("q"))
    out = mixing.mix_sources(docs).collect()
    assert len(out) == 7 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    want = targets_by_brute_force({"a": 0, "b": 50_002, "c": 0, None: 2})
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in out)
    taken = mixing.take_copies(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in out)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_open_tags_take_linear_time():
    """A hundred thousand elements that are never closed, and as many blocks below them."""
    n = 100_000
    for page, length in (("<b>x " * n, 2 * n - 1), ("<b>" * n + "<p>x</p>" * n, 2 * n - 1), ("<i>" * n + "</u>x " * n, 2 * n - 1), ("<p><b>x " * n, 2 * n - 1)):
        began = time.perf_counter()
        assert len(htmltext.main_text(page)) == length
        assert time.perf_counter() - began < 5


def test_paragraphs_of_links_stay_and_menus_go():
    text = "<p>" + "Some words of the text, and more of them. " * 4 + "</p>"
    page = f"<div>{text}<p><a href=x>A paragraph that is a link</a></p>{text}<p><a>one</a></p><p><a>two</a></p><p><a>three</a></p>{text}</div>"
    got = htmltext.main_text(page)
    assert "A paragraph that is a link" in got and "three" not in got


def test_repeated_rows_meet_their_target(spark):
    """One row of 100 words fifty times beside ten small ones; the rows that are written follow the decisions."""
    rows = [(1, " ".join(["w"] * 100), "a", 7)] * 50 + [(i, "x y z", "a", 7) for i in range(10, 20)] + [(i, "w " * 500, s, 7) for i, s in enumerate(["b", "c"] * 5, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    out = mixing.mix_sources(docs).collect()
    for source in "abc":
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert len(out) == len(rows)
    taken = mixing.take_copies(docs).groupBy("doc_id").count().collect()
    want = collections.Counter()
    for r in out:
        want[r["doc_id"]] += r["copies"]
    assert {r["doc_id"]: r["count"] for r in taken} == {k: v for k, v in want.items() if v}


def test_images_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (3, 4, 3), (1, 1), (9, 3, 3)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode_bmp(image)) == image).all()
        if image.ndim == 2:
            assert (media.decode(media.encode_pgm(image)) == image).all()
        head = f"{'P6' if image.ndim == 3 else 'P5'}\n# a comment\n{shape[1]} {shape[0]}\n255\n".encode()
        assert (media.decode(head + image.tobytes()) == image).all()
        plain = f"{'P3' if image.ndim == 3 else 'P2'} {shape[1]} {shape[0]} 255\n{' '.join(map(str, image.ravel()))}".encode()
        assert (media.decode(plain) == image).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0").tolist() == media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    for broken in (b"", b"P5", b"P5 2 2 255\n\x00", b"BM", b"P7 1 1 255\n\x00"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_area_resize_is_exact():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    fine = np.repeat(np.repeat(image, 12, 0), 12, 1).astype(float)  # 60 x 84
    want = fine.reshape(4, 15, 3, 28).mean((1, 3))
    assert np.allclose(media.area_resize(image, 4, 3), want)


def area_means(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By the share of each pixel that each cell covers."""

    def shares(n, out):
        edge = np.arange(out + 1) * n / out
        return np.clip(np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n)), 0, None) / (n / out)

    return shares(image.shape[0], height) @ image @ shares(image.shape[1], width).T


def test_media_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = media.op3_media_columns(spark, DATA).collect()
    assert len(out) == len(texts)
    kinds = set()
    for r in out:
        raw = texts[r["doc_id"]]
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        image = np.frombuffer(padded, np.uint8).reshape(-1, 24)
        stored = (media.encode_bmp if zlib.crc32(raw) % 2 else media.encode_pgm)(image)
        kinds.add(stored[:2])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-32:]) and r["media_sha256"] == hashlib.sha256(stored).hexdigest() and r["media_bytes"] == len(stored)
        across, down = np.round(area_means(image, 8, 9), 6), np.round(area_means(image, 9, 8), 6)
        bits = [*(across[:, 1:] > across[:, :-1]).ravel(), *(down[1:] > down[:-1]).ravel()]
        assert r["feature"] == f"{int(''.join('01'[int(b)] for b in bits), 2):032x}"
        tile = np.load(__import__("io").BytesIO(r["tile"]))
        assert tile.shape == (16, 16) and np.abs(tile - area_means(image, 16, 16)).max() <= 0.5 + 1e-9
    assert kinds == {b"P5", b"BM"}


def test_media_odd_inputs(spark):
    rows = [(1, None), (2, b""), (3, b"P5 1 1 255\n\x07"), (4, b"junk")]
    out = {r["doc_id"]: r for r in media.media_features(spark.createDataFrame(rows, "doc_id long, m binary").withColumn("tile", F.lit(1)), "m", ["doc_id"]).collect()}
    assert out[1]["error"] == "null" and out[4]["dhash"] is None and out[3]["error"] is None and out[2]["media_bytes"] == 0
    assert np.load(__import__("io").BytesIO(out[3]["tile"])).tolist() == [[7] * 32] * 32
    long = "é" * 300_000
    rows = [(1, None), (None, ""), (2, long), (2, long), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    stored = media.text_as_media(docs).collect()
    assert [len(r["media"]) for r in stored[:2]] == [576 + 13] * 2 and [r["n_bytes"] for r in stored] == [0, 0, 600_000, 600_000, 5]
    assert stored[2]["media"] == stored[3]["media"] and media.decode(stored[2]["media"]).tobytes()[:600_000] == long.encode()
    assert media.text_as_media(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="header">Site name</div><nav><a href=1>Home</a></nav>
<div class="cookie-notice">We use cookies on this site, as all do.</div><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>text, with
 white   space&nbsp;inside.<p>Second paragraph.<aside>Related things to read.</aside><ul><li>one<li>two</ul><form><input>Sign up here</form><p>Last.</p>
<section class="comments"><p>I disagree with all of this, said a reader at length.</p></section></article><aside>Sidebar</aside><footer>&copy; all</footer><script>var a="</p>";</script></body></html>"""


def test_page():
    assert htmltext.main_text(PAGE) == "Head & line First boldtext, with white space inside. Second paragraph. one two Last."


BARE = [
    ("<div class=menu><a href=x>Home</a> <a href=y>About us and more</a></div><div><p>A first long paragraph of the text.</p><p>And a second one, as long as that.</p></div><div id=footer>copyright notice 2020</div>",
     "A first long paragraph of the text. And a second one, as long as that."),
    ("<div>Home News About</div><div><div><p>The first paragraph stands in a division of its own, as some pages have it.</p></div><div><p>Short.</p></div><div><p>The last paragraph is a long one again, and ends the text of the page.</p></div></div><div>All rights reserved</div>",
     "The first paragraph stands in a division of its own, as some pages have it. Short. The last paragraph is a long one again, and ends the text of the page."),
    ("<div><a href=1>One</a><a href=2>Two</a></div><table><tr><td>Log in</td><td><h2>A title</h2><p>Text in a table's cell, on a page laid out by tables, with a link <a href=3>inside</a> of it.<p>More of it.</td><td>Weather: fine</td></tr></table>",
     "A title Text in a table's cell, on a page laid out by tables, with a link inside of it. More of it."),
    ("<div class=sidebar-page><p>All of this page stands in a container with the name of a sidebar.</p><p>It is read all the same.</p></div>", "All of this page stands in a container with the name of a sidebar. It is read all the same."),
]


@pytest.mark.parametrize(("page", "text"), BARE)
def test_page_without_landmarks(page, text):
    assert htmltext.main_text(page) == text


def test_surge_and_dive_decide(spark):
    """Pages stripped of article, nav, footer and names; with no threshold for a surge every page has its furniture."""
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h).replace(' class="ad"', "") for h in rows]
    want = [htmltext.main_text(h) for h in rows]
    assert np.mean([htmltext.main_text(h) == w for h, w in zip(bare, want, strict=True)]) > 0.93
    assert all(htmltext.main_text(h, share=0) != w for h, w in zip(bare, want, strict=True))
    assert all(htmltext.main_text(h, share=0) != w for h, w in zip(rows, want, strict=True))


def test_light_blocks_of_an_article_stay():
    page = "<article><p>A long first paragraph, which has most of the article's text in it.</p><div class=notice><p>One.</p><p>Two.</p></div><section><p>End.</p></section></article><div>Other words.</div>"
    assert htmltext.main_text(page) == "A long first paragraph, which has most of the article's text in it. End."
    assert len(htmltext.main_text(f"<article>{'<p>' + 'word ' * 30}" * 3000)) == 3000 * 150 - 1


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<article></article>", "<nav>menu</nav>", "<script>x", '<p title="'])
def test_pages_without_text(page):
    assert htmltext.main_text(page) == ""


def test_pages_query(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r["page_id"]: r for r in htmltext.op7_line_blocks(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        text = re.sub(r"<[^>]*>", "", re.sub(r"<(?:p|/p|h1|/h1|br)>", " ", inner))
        want = " ".join(__import__("html").unescape(text).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def thue_morse(n: int) -> str:
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("known_bits", [packing.KNOWN_BITS, 6, 2])
def test_tokenizer_gives_the_librarys_ids(known_bits):
    """Also where the store is full of a few pieces, on special tokens' strings, and on pieces with one hash."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab 's\n\t .'12é_—²日relvdtm"), rng.integers(0, 60))) for _ in range(1500)] + ["", " ", "'s", "don't  we'll\n\n x", "a" * 5000]
    one = thue_morse(4096)
    texts += ["hello <|endoftext|> world", "<|endoftext|>", one, one.translate(str.maketrans("ab", "ba")), f"{one} {one.translate(str.maketrans('ab', 'ba'))}"]
    tok = packing.PieceTokenizer(packing.TOKENIZER, known_bits)
    want = [e.ids for e in Tokenizer.from_file(packing.TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert 50256 in want[-5]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode_batch(texts)] == want


def test_tokenizer_goes_when_its_worker_gets_another_kind_of_task():
    """Workers take turns, so a tokenizer left in each stayed through all later steps."""
    held = weakref.ref(packing.tokenizer(packing.TOKENIZER))
    assert list(common.frugal(lambda batches: batches, keeps=packing.TOKENIZER)(iter([1]))) == [1]
    assert held() is packing.tokenizer(packing.TOKENIZER)
    assert list(common.frugal(lambda batches: batches)(iter([1]))) == [1]
    assert held() is None


def test_tokenizer_ends_on_more_distinct_pieces_than_it_keeps():
    rng = np.random.default_rng(4)
    long = " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 700_000).tolist())
    tok = packing.PieceTokenizer(packing.TOKENIZER)
    got = tok.encode_batch([long, "short"])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.inner.encode(t, add_special_tokens=False).ids for t in (long, "short")]


@pytest.mark.parametrize("seed", range(8))
def test_sum_index_finds_what_fills_a_gap(seed):
    """While counts fall, against trying all combinations."""
    rng = np.random.default_rng(seed)
    capacity = 40
    left = rng.integers(0, 3, capacity + 1) * (rng.random(capacity + 1) < 0.4)
    left[0] = 0
    index = packing.SumIndex(left, capacity)
    for _ in range(200):
        free = left.copy()
        here = np.flatnonzero(left)
        if not len(here):
            break
        free[rng.choice(here)] -= 1
        gap = int(rng.integers(1, capacity + 1))
        pool = [x for x in here.tolist() for _ in range(free[x])]
        want = min((k for k in (1, 2, 3) for c in itertools.combinations(pool, k) if sum(c) == gap), default=None)
        got = index.fill(gap, free)
        assert (got is None) == (want is None)
        if got:
            assert len(got) == want and sum(got) == gap and all(free[x] >= got.count(x) for x in got)
            if rng.random() < 0.4:
                for x in got:
                    left[x] -= 1


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    rows = packing.op9_best_fit_packing(spark, DATA).collect()
    used, total = check_packing(rows, 1024), sum(r["length"] for r in rows)
    assert used <= -(-total // 1024) + 3
    tok = Tokenizer.from_file(packing.TOKENIZER)
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = 50
    counts = np.bincount(rng.integers(1, [8, 20, 51, 51, 30, 51][seed], 500), minlength=capacity + 1)
    plan = packing.plan_patterns(counts, capacity)
    used = np.zeros_like(counts)
    for uses, times in plan:
        assert sum(k * n for k, n in uses.items()) <= capacity and times > 0
        for k, n in uses.items():
            used[k] += n * times
    assert (used == counts).all()
    table = packing.place_table(plan)
    length = np.repeat(np.arange(capacity + 1), counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = packing.place(table, length, rank)
    n = check_packing([{"sequence_id": a, "offset": b, "length": c} for a, b, c in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True)], capacity)
    bound = -(-int((np.arange(capacity + 1) * counts).sum()) // capacity)
    assert n <= max(bound + 2, int(np.ceil(bound * 1.25)))


def test_packing_odd_inputs(spark):
    rows = [(None, "a"), (1, None), (1, None), (2, ""), (3, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("offset", F.lit(1))
    out = packing.pack(packing.token_pieces(docs)).collect()
    assert len([r for r in out if r["doc_id"] == 1]) == 2 and check_packing(out, 1024) == 3
    assert packing.pack(packing.token_pieces(docs.limit(0))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "minhash", "suffixes", "mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("band", F.lit(1))
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = p.materialize(stage(spark, docs, DATA), f"test-{name}")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= seen and len(ids) > 0.8 * len(seen) * (0.5 if name == "mixing" else 1)
        docs, seen = out, ids
    check_packing(p.pack(spark, docs, DATA).collect(), 1024)


def test_pipeline_stages_keep_odd_rows(spark):
    import corpus_pipeline as p

    rows = [(None, "some text", "en", None, 9), (1, None, None, "a", 0), (2, "", "en", "a", 0), (3, "hello there", "en", "b", 11), (3, "hello there", "en", "b", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shared = "a passage of more than fifty bytes that two of the documents have"
    more = spark.createDataFrame([(7, shared, "en", "a", len(shared)), (8, f"own words, {shared}é", "de", "b", 0), (9, shared, "en", "a", 0), (9, shared, "en", "a", 0), (None, shared, "fr", None, 3)], docs.schema)
    kept = p.drop_repeated_passages(spark, docs.unionByName(more), DATA)
    assert sorted(map(tuple, kept.where("length(text) > 20 or lang = 'de'").collect()), key=str) == sorted([(7, shared, "en", "a", len(shared)), (8, "own words, é", "de", "b", 12), (None, shared, "fr", None, 3)], key=str)
    assert kept.count() == 8
    for stage, n in ((p.drop_toxic, 5), (p.drop_near_duplicates, 4), (p.drop_repeated_passages, 5)):
        assert stage(spark, docs, DATA).count() == n
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
