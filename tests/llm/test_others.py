import base64
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tributary.llm import embedding_dedup as E
from tributary.llm import html_text as H
from tributary.llm import toxicity as T
from tributary.llm import warc as W

# Toxicity


def corpus(n, seed):
    """Texts of made-up words; those of label 1 hold a few words of two stems with endings of their own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "ri", "mo", "ne", "lu", "sa", "ko"]) for _ in range(r.randint(1, 4)))
    out = []
    for _ in range(n):
        words, y = [word() for _ in range(r.randint(20, 200))], int(r.random() < 0.3)
        if y:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(["zwexi", "brofk"]) + word())
        out.append((" ".join(words), y))
    return out


def test_model_finds_unseen_endings():
    learn, held = corpus(1200, 1), corpus(300, 2)
    m = T.train([t for t, _ in learn], [y for _, y in learn])
    p = m.scores([t for t, _ in held]) >= 0.5
    assert np.mean(p == np.array([y for _, y in held], bool)) > 0.95
    assert (m.scores(["", None, " \n "]) < 0.5).all()


def test_portions_don_t_change_scores(monkeypatch):
    m = T.Model(np.random.default_rng(1).normal(size=T.BUCKETS).astype(np.float32), 0.1)
    texts = [t for t, _ in corpus(20, 3)] + ["", "one", "a  b\n\tc"]
    whole = m.scores(texts)
    monkeypatch.setattr(T, "PORTION", 50)
    assert np.allclose(m.scores(texts), whole, atol=1e-6)


def test_toxicity_report(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(corpus(600, 4))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (10_000, None), (10_001, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity_report(docs, labels).collect()}
    assert len(got) == 603
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_held_out_labels_are_never_learnt(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(corpus(200, 5))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = T.fit(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
    empty = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert (empty.scores(["a", ""]) < 0.5).all()
    assert T.toxicity_report(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more of them. Accept?</p></div>
<div class="content"><h2>The title</h2><p>First   paragraph, with <b>some</b> text; really.<p>Second&nbsp;one has <a href="x">a link</a> &amp; &eacute; &#x41;.</p>
<ul><li>item one, here<li>item two</ul><blockquote>Quoted: words.</blockquote><!-- <p>no</p> --></div>
<aside><p>Side story, long enough to look like text. Really long.</p></aside><div id="ad-1" class="ad">Buy this now, it is good. Very good!</div>
<section class="comments"><p>Great post, thanks. I read it all, twice.</p></section><form><p>Name, please.</p><textarea>x</textarea></form>
<div style="display:none">Hidden text, never seen.</div><footer>&copy; 2020, all rights.</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE) == "The title\nFirst paragraph, with some text; really.\nSecond one has a link & é A.\nitem one, here\nitem two\nQuoted: words."
    article = "<body><div class='ad'>A very long advert, with punctuation; and so on. And on.</div><article><h1>Hi</h1><p>Yo.</article><footer>f</footer>"
    assert H.main_text(article) == "Hi\nYo."
    for empty in (None, "", "<html></html>", "<script>x</script>", "<nav>menu</nav>"):
        assert H.main_text(empty) == ""
    for broken in ("<p>open <b", "<div 'x>text</div>", "a < b and c > d", "</p></div>x", "<p" * 500 + ">x", "<a b=\"" * 300 + "x"):
        assert isinstance(H.main_text(broken), str)


NEWS = """<html><body><div id="masthead" class="site-header"><a href="/">The Paper</a> <span>Daily, since 1900.</span></div>
<div role="navigation"><a href="/w">World</a><a href="/m">Markets</a></div><main class="story"><h1>Shares rise</h1>
<p class="share-price">Shares rose today, he said.</p><p class="subscribe">We subscribe to this view, for now; it may change.</p>
<div class="share-bar"><a href="#">Share</a> <a href="#">Mail</a></div><p>Prices of bread, milk and oil rose as well, by 3&nbsp;% or so.</p>
<table><thead><tr><th>Good<th>Rise<tbody><tr><td>Bread<td>2<tr><td>Milk<td>4</table><p>More is to come, they say. Nobody knows.</p>
<section class="comments"><h3>Comments</h3><p>Nonsense, all of it.</p></section></main>
<div class="related"><h3>Related</h3><p>Old news, of old times.</p></div><footer>About, contact.</footer></body></html>"""
WIKI = """<body class="mw"><div id="content"><h1>Bee</h1><p>A bee is an insect, and it flies; it makes honey, wax and noise.</p>
<h2>Kinds</h2><ul><li>Honey bee, kept by man.</li><li>Bumble bee, which is not.</li></ul><table class="facts"><tr><td>Legs</td><td>6</td></tr><tr><td>Wings</td><td>4</td></tr></table>
<p>Bees see colours, but not red. Their sight is good, and so is their smell.</p></div>
<div id="sidebar"><ul><li><a href="/r">Random page</a></li><li><a href="/h">Help</a></li></ul></div><div class="footer-links"><a href="/p">Privacy</a></div></body>"""
BLOG = """<div class=wrap><div class=top><a href=/>Home</a> | <a href=/a>About</a></div><div class=post><div class=t>On soup</div>
<div class=b>Soup is hot, mostly. I cook it on Sundays, when it rains; then we eat.<br>All of it.</div><div class=b>Cold soup is soup, too, though few agree with that, and fewer cook it.</div></div>
<div class=comment-list><div class=comment>First! Nice soup, really.</div></div><form><input name=q><button>Go</button></form></div>"""


def test_other_templates():
    assert H.main_text(NEWS) == "Shares rise\nShares rose today, he said.\nWe subscribe to this view, for now; it may change.\nPrices of bread, milk and oil rose as well, by 3 % or so.\nGood\nRise\nBread\n2\nMilk\n4\nMore is to come, they say. Nobody knows."
    assert H.main_text(WIKI) == "Bee\nA bee is an insect, and it flies; it makes honey, wax and noise.\nKinds\nHoney bee, kept by man.\nBumble bee, which is not.\nLegs\n6\nWings\n4\nBees see colours, but not red. Their sight is good, and so is their smell."
    assert H.main_text(BLOG) == "On soup\nSoup is hot, mostly. I cook it on Sundays, when it rains; then we eat. All of it.\nCold soup is soup, too, though few agree with that, and fewer cook it."


def test_large_tables_stay_in_their_article():
    cells = "".join(f"<tr><td>n{i}</td><td>{i}</td></tr>" for i in range(3000))
    text = H.main_text(f"<article><p>{'Some words, in a long paragraph. ' * 30}</p><table>{cells}</table></article>")
    assert text.count("\n") == 6000


@pytest.mark.parametrize(
    "page",
    [
        "".join(f"<p class='{i:b}x q{'abcdefghij'[i % 10]}'>Some text.</p>" for i in range(30_000)), "<div>" * 30_000 + "x", "".join(f"<div>t{i}, x." for i in range(30_000)), "<b>" * 30_000 + "x" + "</u>" * 30_000,
        "<a " * 300_000, "<a \"" * 150_000 + ">x", "<div " + "a" * 300_000 + ">x", "<!--" * 100_000, "<script>" * 50_000, "<ul><li>" * 20_000,
    ],
    ids=["classes", "levels", "text at levels", "end tags", "no end", "quotes", "attribute", "comments", "scripts", "lists"],
)
def test_time_follows_length(page):
    start = time.monotonic()
    H.main_text(page)
    assert time.monotonic() - start < 10


def test_extract_report(spark):
    d = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "<p>" + "é, " * 50_000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = H.extract_report(d).collect()
    assert [r["n_chars"] for r in rows] == [len(r["text"]) for r in rows] and len(rows) == 5
    assert {r["page_id"]: r["text"] for r in rows}[3] == " ".join(["é,"] * 50_000)
    assert H.extract_report(d.limit(0)).count() == 0


def test_paths_of_generated_pages(spark):
    """The driver's pages: exactly the text of the article element."""
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r["html"].split("<article>")[1].split("<footer>")[0]
        parts = re.split(r"<[^>]+>", re.sub(r"</?b>", "", body).replace("<br>", " "))
        assert H.main_text(r["html"]) == "\n".join(x for p in parts if (x := " ".join(html.unescape(p).split())))


# Embeddings


def brute_vectors(rows):
    def unit(v):
        if v is None or not v or any(x is None for x in v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and np.linalg.norm(x) > 0 else None

    units = [unit(v) for _, v, _ in rows]
    n = len(rows)
    near = [[i != j and rows[i][0] is not None and rows[j][0] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= E.COSINE for j in range(n)] for i in range(n)]
    low = [r[0] for r in rows]
    for _ in range(n):
        low = [min([low[i], *(low[j] for j in range(n) if near[i][j])]) if low[i] is not None else None for i in range(n)]
    return sorted((str(rows[i][0]), sum(near[i]), str(low[i]), str(None if low[i] is None else rows[i][0] == low[i])) for i in range(n))


@pytest.mark.parametrize("block", [512, 4])
def test_vector_report(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    r = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, None):
        for size in (1, 1, 1, 2, 5, 30):
            centre = r.normal(size=16)
            for k in range(size):
                v = centre + r.normal(size=16) * (0.07 if k else 0)
                rows.append((i, [float(x) for x in v.astype(np.float32)], label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, [x * 3 for x in rows[0][1]], 0), (i + 2, None, 0), (i + 3, [0.0] * 16, 0), (i + 4, [float("nan"), *[1.0] * 15], 0), (i + 5, [None, *[1.0] * 15], 0), (i + 6, [], 0), (i + 7, [1.0, 2.0], 0), (None, rows[0][1], 0), (i, rows[0][1], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"]), str(x["kept"])) for x in E.near_vectors_report(d).collect())
    assert got == brute_vectors([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows])
    assert E.near_vectors_report(d.limit(0)).count() == 0


def test_recall_on_the_driver_s_vectors(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in d.collect()]
    got = sum(r["n_links"] for r in E.near_vectors_report(d).collect())
    assert got >= 0.95 * sum(x[1] for x in brute_vectors(rows))


# WARC

PAYLOADS = [
    (1, "u", None), (2, None, ""), (3, "a\r\nWARC/1.1\r\nb", "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\nend"),
    (4, "z", "WARC/1.1\r\n"), (5, "z", "WARC/1.1\r\n"), (6, "q", "\r\n\r\n"), (7, "q", "é" * 3000 + "WARC/1.1\r\nContent-Length: 999999999999999999999\r\n\r\nü"),
    (None, "n", "zz"), (8, "n", "zz"), (9, "n", "zz"), (10, "e", "tail WARC/1.1\r"), (2, None, ""), (11, "r", "HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"),
]


def brute_warc(rows):
    first, out = {}, []
    for i, _, h in rows:
        if i is not None:
            k = (h or "").encode()
            first[k] = min(first.get(k, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b, i)
        again = i is not None and f != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "700"])
def test_warc_report(spark, split):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        d = spark.createDataFrame(PAYLOADS, "page_id long, url string, html string").withColumn("first", F.lit("clash"))
        for parts in (1, 3):
            assert sorted(map(tuple, W.warc_report(d.repartition(parts)).collect()), key=str) == brute_warc(PAYLOADS)
        assert W.warc_report(d.limit(0)).count() == 0
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_warc_bytes_are_records(spark, tmp_path):
    d = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>")], "page_id long, url string, html string").coalesce(1)
    W.write_warc(d, f"file://{tmp_path}/w")
    (f,) = (tmp_path / "w").glob("part-*")
    data, at, kinds = f.read_bytes(), 0, []
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        kinds.append(fields[b"WARC-Type"])
        at += len(head) + 4 + int(fields[b"Content-Length"]) + 4
    assert at == len(data) and kinds == [b"response", b"revisit"]


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "best_fit_packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    (tmp_path / "empty").mkdir()
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
