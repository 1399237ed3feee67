"""HTML extraction, fingerprints, the quality classifier and URL filters."""

import hashlib
import html
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import fingerprint, html_extract, quality, url_filter


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b)))).strip() for b in re.split(r"</?(?:p|h1|article|footer)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_extract.op7_html_extract(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == {k: article(p) for k, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("just words", "just words"), ("<p>a &amp; b&nbsp;c", "a & b c"),
        ("<nav>x</nav><main><h1>T</h1><p>One  two</p><aside>no</aside><div class='comments'>no</div><p>three</main><footer>f</footer>", "T\n\nOne two\n\nthree"),
        ("<body><div class='cookie-notice'>no no no</div><div id=content><p>Long enough to be a content line of a page.</p><form>no</form><ul><li>item</li></ul></div></body>", "Long enough to be a content line of a page.\n\nitem"),
        ("<script>var a = '</p>';</script><style>p{}</style><article>ok<textarea>no</textarea></article>", "ok"),
    ],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_long_page():
    assert len(html_extract.main_text("<article>" + "<p>line of words</p>" * 20000 + "</article>").split("\n\n")) == 20000


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<html><head><title>T</title><meta charset=x><body><p>Some text.</p></body></html>", "Some text."),
        ("<head><title>T</title><p>Some text.<p>More.", "Some text.\n\nMore."),
        ("<head><noscript><link rel=x></noscript><script>a < b</script><h1>Some text.</h1></head><p>More.</p>", "Some text.\n\nMore."),
        ("<head><title>T<body><p>Some text.</p>", "Some text."),
        ("<head><title>T</title>Some text.<p>More.</p>", "Some text.\n\nMore."),
        ("<body><p>Some text.</p><datalist><option>A<option>B</datalist><p>More.</p></body>", "Some text.\n\nMore."),
        ("<body><div><p>Some text.</p><option>A</div><p>More.</p></body>", "Some text.\n\nMore."),
        ("<body><div><p>Some text.</p><select><option>A<option>B</div><p>More.</p></body>", "Some text.\n\nMore."),
        ("<body><p>Some text.</p><select><option>A<option>B</select><button><p>C</p></button><p>More.</p></body>", "Some text.\n\nMore."),
        ("<head><title>T</title><noscript><img src=x></noscript></head><body><p>Some text.</p></body>", "Some text."),
    ],
)
def test_elements_whose_end_is_left_out(page, expected):
    assert html_extract.main_text(page) == expected


SOUP = "<body><div><ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul></div><div><h1>A title of some words</h1>" + "".join(f"<p>{'Paragraph of many words. ' * 9}</p>" for _ in range(2)) + "</div><div>" + "".join(f"<p>{'Paragraph of many words. ' * 9}</p>" for _ in range(2)) + "<p>Short end.</p></div><div><ul>" + "".join(f"<li><a href='/x{i}'>More {i}</a></li>" for i in range(9)) + "</ul></div></body>"


def slow_cluster(lines, sigma):
    """Ratio, smoothing and threshold by their definitions."""
    ratio = [len(text) / max(1, tags) for text, tags, *_ in lines]
    reach, smooth = max(1, math.ceil(3 * sigma)), []
    for i in range(len(ratio)):
        weights = {j: math.exp(-0.5 * ((i - j) / sigma) ** 2) for j in range(max(0, i - reach), min(len(ratio), i + reach + 1))}
        smooth.append(sum(w * ratio[j] for j, w in weights.items()) / sum(weights.values()))
    mean = sum(smooth) / len(smooth)
    bound = min(mean, math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)))
    return [x >= bound for x in smooth]


@pytest.mark.parametrize("sigma", [0.5, 1.0, 2.0])
def test_clusters_by_definition(spark, sf, sigma):
    pages = [SOUP, *(r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(20).collect())]
    for page in pages:
        lines = html_extract.read_lines(page).lines
        got = html_extract.content_cluster(np.array([len(x[0]) for x in lines]), np.array([x[1] for x in lines]), sigma)
        assert got.tolist() == slow_cluster(lines, sigma)


def test_clusters_choose_the_text(monkeypatch):
    """Without names to go by, menus before and after the text go by their ratios; other clusters give other texts."""
    text = "\n\n".join(["A title of some words", *["Paragraph of many words. " * 8 + "Paragraph of many words."] * 4, "Short end."])
    assert html_extract.main_text(SOUP) == text
    for fake in (lambda n, t, s: n > 0, lambda n, t, s: n < 0, lambda n, t, s: np.arange(len(n)) % 2 == 0, lambda n, t, s: n < 30):
        monkeypatch.setattr(html_extract, "content_cluster", fake)
        assert html_extract.main_text(SOUP) != text


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<article><p>One.</p><div class='social-science'><p>Two.</p></div><ul id='share-prices'><li>3</ul><div class='x cookie-notice'>no</div><div id='comments'>no</div><header><h2>Own</h2></header></article>", "One.\n\nTwo.\n\n3\n\nOwn"),
        ("<header>no</header><article><p>One.</p></article><div class='site-header'>no</div>", "One."),
        ("<body><button>Click<p>Some text.</p><p>More.</p></body>", "Some text.\n\nMore."),
        ("<body><p>Some text.<button>no</button> On.</p><p>More.<svg><text>no</p><p>End.</body>", "Some text. On.\n\nMore.\n\nEnd."),
    ],
)
def test_names_and_unclosed_buttons(page, expected):
    assert html_extract.main_text(page) == expected


def test_deep_nests_take_linear_time():
    import time

    began = time.process_time()
    deep = html_extract.main_text("<div>" * 100_000 + "<p>Some text.</p>" + "</div>" * 100_000)
    unmatched = html_extract.main_text("<div>" * 50_000 + "</section>" * 50_000 + "<p>Some text.</p>")
    buttons = html_extract.main_text("<p>Some text.</p>" + "<button>a<select>b<svg>" * 20_000)
    assert deep == unmatched == "Some text." and buttons.startswith("Some text.") and time.process_time() - began < 20


def test_pages_table(spark):
    rows = [(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (None, None, None), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS __html")
    for df in (pages, clash):
        assert sorted(map(tuple, html_extract.extract_main_text(df).collect()), key=repr) == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0), (3, "u", "", 0)], key=repr)
    assert html_extract.extract_main_text(pages.where("false")).count() == 0
    with pytest.raises(ValueError):
        html_extract.extract_main_text(clash, keep=("text",))


def test_fingerprints(spark, docs, rows):
    order = sorted((r for r in rows if r[0] is not None and r[0] != 90005), key=lambda r: -r[0])
    df = spark.createDataFrame(order, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(df.repartition(5)).collect()}
    texts = [(k, t or "") for k, t in order]
    for (k, t), (_, u) in zip(texts, texts[1:] + texts[:1]):
        cut, r = len(t) // 3, got[k]
        edited = t[: len(t) - cut] + u[:cut]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint.digest(t.encode()) and r.edited_fingerprint == fingerprint.digest(edited.encode())
        assert r.near_edited == fingerprint.likeness(r.fingerprint, r.edited_fingerprint) and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (edited == t)
    assert np.mean([r.near_edited > r.near_next for r in got.values() if r.n_chars > 200]) > 0.97
    repeated = fingerprint.fingerprint_documents(docs).collect()
    assert len(repeated) == len(rows)


def slow_digest(raw):
    """The digest by its definition: a dictionary of bucket counts, one triplet after another."""
    padded, check = raw.ljust(5, b"\0") if raw else b"", zlib.crc32(raw)
    counts = [0] * 256
    for i in range(max(0, len(padded) - 4)):
        w = padded[i : i + 5]
        for salt, (a, b, c) in ((0x1B873593, (0, 1, 2)), (0x2545F491, (0, 1, 3)), (0x5851F42D, (0, 2, 4)), (0x14057B7E, (0, 1, 4))):
            mixed = (w[a] * 0x9E3779B1 + w[b] * 0x85EBCA77 + w[c] * 0xC2B2AE3D) % 2**32
            counts[((mixed ^ salt) * 0x27D4EB2F % 2**32) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
    quartile = [sum(c > q for q in (q1, q2, q3)) for c in counts]
    packed = bytes(sum(quartile[i + k] << 2 * k for k in range(4)) for i in range(0, 256, 4))
    return f"{min(255, int(math.log2(len(raw) + 1) * 8)):02x}{q1 * 255 // max(1, q3):02x}{q2 * 255 // max(1, q3):02x}{check:08x}{packed.hex()}", quartile, (q1 * 255 // max(1, q3), q2 * 255 // max(1, q3))


def test_fingerprints_by_definition(rows):
    texts = [b"", b"a", b"abc", b"abcd", b"abcde", b"wxyz", "é漢".encode(), b"a" * 300, *((t or "").encode()[:3000] for _, t in rows[:40])]
    slow = [slow_digest(t) for t in texts]
    assert [fingerprint.digest(t) for t in texts] == [d for d, *_ in slow]
    for (a, qa, ra), ta in zip(slow, texts):
        for (b, qb, rb), tb in zip(slow, texts):
            bound = min(640.0, sum(x * x for x in qa) + sum(y * y for y in qb))
            score = sum((x - y) ** 2 for x, y in zip(qa, qb)) / max(1.0, bound)
            score += min(8, abs(int(a[:2], 16) - int(b[:2], 16))) / 160 + sum(min(64, abs(x - y)) for x, y in zip(ra, rb)) / 2560 + 0.005 * (ta != tb)
            expected = 1.0 if ta == tb else max(0.0, 1 - score)
            assert fingerprint.likeness(a, b) == pytest.approx(expected, abs=1e-12)
    assert fingerprint.likeness(fingerprint.digest(b""), fingerprint.digest(b"abc")) < 0.1
    assert fingerprint.likeness(fingerprint.digest(b"abcd"), fingerprint.digest(b"wxyz")) < 0.1


def test_a_hot_key_is_split(spark):
    """Half of all rows share a key: order by key, then hash of the text; every row once, each with its next one."""
    rows = [(7, f"text number {i}") for i in range(300)] + [(None, f"null {i}") for i in range(100)] + [(i, f"other {i}") for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", fingerprint.F.xxhash64("text"))
    order = sorted(((r.doc_id, r.text, r.h) for r in df.collect()), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[2]))
    got = sorted((r.doc_id is None, r.doc_id, r.edited_sha256) for r in fingerprint.fingerprint_documents(df).collect())
    edited = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest()
    assert got == sorted((k is None, k, edited(t, u)) for (k, t, _), (_, u, _) in zip(order, order[1:] + order[:1]))


def test_fingerprint_of_few_rows(spark, none):
    assert fingerprint.fingerprint_documents(none).count() == 0
    r = fingerprint.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=7), rng.normal(size=(2, 2))
    doc = np.array([0, 0, 0, 0, 1, 1, 2])
    total, z = np.zeros(7), 0.0
    for y in itertools.product((0, 1), repeat=7):
        w = np.exp(sum(emit[i] * y[i] for i in range(7)) + sum(move[y[i - 1], y[i]] for i in (1, 2, 3, 5)))
        z += w
        total += w * np.array(y)
    assert quality.marginals(emit, move, doc)[0] == pytest.approx(total / z)


def test_line_features_see_their_neighbours():
    f, length, doc = quality.line_features(*quality.flat_bytes(pa.array(["one two\nTWO!! TWO!!\n\nx | y", "", "the the the"])))
    assert doc.tolist() == [0, 0, 0, 1, 2] and length.tolist() == [7, 11, 5, 0, 11]
    k = (f.shape[1] - 1) // 3
    assert f[1, 1 + k : 1 + 2 * k].tolist() == f[0, 1 : 1 + k].tolist() and not f[3, 1 + k :].any()
    assert f[4, 9] == pytest.approx(2 / 3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.op9_quality(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_quality_of_odd_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(k, i % 2) for i, (k, _) in enumerate(rows)] + [(None, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, most_docs=40)
    got = quality.with_score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["__score"] <= 1 for r in got)
    assert quality.train(docs, labels.where("quality = 1")).constant == 1.0
    assert quality.train(none, labels.where("false")).constant == 0.5
    assert quality.with_score(none, model).count() == 0
    few = quality.train(docs, labels, most_docs=40, most_lines=30)
    assert few.weights.shape == model.weights.shape or few.constant is not None


def test_lines_are_labelled(spark):
    """A document of good lines with a block of junk: the field tells the lines apart."""
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(documents, labels)
    text = {r.quality: r.text for r in documents.join(labels, "doc_id").where("n_chars between 800 and 3000").select("quality", "text").collect()}
    whole = text[1].replace("\n", " ")
    lines = [whole[i : i + 150] for i in range(0, len(whole), 150)]
    junk = ["| $$ ## || %% $$ | >>> 88 77 || ## $$ @@ {{ }} [[ ]]"] * len(lines)
    found, count, good = quality.scores(model, pa.array(["\n".join(lines + junk), text[1], text[0]]))
    assert count[0] == 2 * len(lines) and 1 <= good[0] < count[0] and found[1] > 0.5 > found[2]


URLS = [None, "", "no scheme/", "http://", "HTTP://A.NET", "http://a.NET/", "http://net/x", "http://xnet/x", "http://example.net/en/1?q", "http://b.example.net/en", "http://example.net/EN/", "http://example.com/de/#x", "http://my-example.com/de/", "http://x.org/fr/", "http://x.org?/fr/", "http://x.com/a.net/", "http://net/" + "a" * 100000, "ftp://u@h.net:80/", "http://É.net/é"]


def test_url_verdicts_match_sql(spark):
    rows = list(enumerate(URLS)) + [(3, "http://a.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(map(tuple, url_filter.filter_urls(df, url_filter.RULES).collect()), key=repr)
    c = duckdb.connect()
    c.sql("create table pages (page_id bigint, url varchar)")
    c.executemany("insert into pages values (?, ?)", rows)
    assert got == sorted(c.sql(url_filter.OP10_SQL).fetchall(), key=repr)
    assert url_filter.filter_urls(df.where("false"), url_filter.RULES).count() == 0


def test_many_globs_cross_words():
    globs = [f"*.host{i}.net/p{i}/**" for i in range(40)] + ["a*c/**", "*.x"]
    auto = url_filter.compile_globs(globs)
    assert len(auto.first) > 5
    texts = [".host7.net/p7/x", ".a.host39.net/p39/", ".host7.net/p8/", "abbc/q", "ab/c/", ".q.x"]
    state = url_filter.run_automaton(auto, *quality.flat_bytes(pa.array(texts)))
    hit = [[i for i, e in enumerate(auto.ends) if state[k, e // 64] >> np.uint64(e % 64) & np.uint64(1)] for k in range(len(texts))]
    assert hit == [[7], [39], [], [40], [], [41]]
