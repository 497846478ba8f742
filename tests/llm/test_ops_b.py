"""Pages, lines, top-k: brute force, edge cases."""

from __future__ import annotations

import html
import re
import time
from collections import Counter

import numpy as np
import pytest

from weaksift.llm import lines, pages, topk

PAGES = "page_id long, url string, html string, host string, template int, text string"
DOCS = "doc_id long, text string, lang string, i int, h1 long, starts int"


def page_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.extract_text(page_frame(spark, rows)).collect()}


def test_pages_of_the_tables(spark):
    """Their articles are marked; a plain reading of the mark-up gives the text."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in pages.extract_text(table).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = r["html"].split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_pages_elements(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>x{}</style></head><body>
    <header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use cookies</div><main><article class="post header-less">
    <header><h1>Head &amp; line</h1></header><p>One <b>bold</b>
      &nbsp;line<br>more<p>Two <a href="x>y">link</a><script>var a = "</p>";</script> end</p><aside>See also</aside>
    <ul><li>first<li>second</ul><table><tr><td>a<td>b</table><pre>x  y</pre><blockquote>said &lt;so&gt; &#233;</blockquote><form>mail<input></form>
    <div id="ad-7">buy</div><div class="comments"><p>nice!</p></div><!-- gone --><div class=shadow>kept</div></article></main>
    <footer>&copy; x</footer></body></html>"""
    rows = [(1, "http://a.example.com/1", page), (2, None, None), (None, "http://b.example.com/", ""), (4, "not a url", "plain text only"),
            (5, "http://a.example.com/5", "<body><nav>menu</nav><p>no article here<p>but text</body>"), (5, "http://a.example.com/5", "<p>a < b && c</p>"),
            (6, "u", "<article><p>cut of")]
    got = pages.extract_text(page_frame(spark, rows)).collect()
    texts = Counter((r["page_id"], r["text"]) for r in got)
    main = "Head & line\nOne bold line more\nTwo link end\nfirst\nsecond\na\nb\nx y\nsaid <so> é\nkept"
    assert texts == Counter([(1, main), (2, ""), (None, ""), (4, "plain text only"), (5, "no article here\nbut text"), (5, "a < b && c"), (6, "cut of")])
    assert pages.extract_text(page_frame(spark, [])).count() == 0


def test_pages_template_without_marks(spark):
    """Blocks that all pages of a host have are its template, whatever their elements are called."""
    def page(i):
        return f"<html><body><div><div>Daily News</div><div>Home World</div></div><div><p>Story {i} begins<p>and ends {i * 7}</div><div>Follow us today</div></body></html>"

    rows = [(i, f"https://News.example.org/{i}", page(i)) for i in range(40)] + [(100 + i, "https://few.example.org/x", page(i)) for i in range(3)]
    got = extracted(spark, rows)
    assert all(got[i] == f"Story {i} begins\nand ends {i * 7}" for i in range(40))
    assert all(got[100 + i].startswith("Daily News\nHome World\nStory") for i in range(3))


def test_pages_names(spark):
    """Names that only hold a word for menus and the like, or stand on headings or around an article, set nothing aside."""
    story = "<h2 id=side-effects>A</h2><p>b<h2 id='how-to-share'>C</h2><h3 class=social-history>D</h3><section id=menu-planning>e</section>"
    others = "<div class=sidebar-left>x</div><div class='cookie-notice'>x</div><div id=ad-slot-7>x</div><div class=post__share-buttons>x</div>"
    bodies = [
        f"<div class='content-sidebar-wrap'><main>{story}{others}</main></div>",
        f"<div class='layout-with-sidebar'><article>{story}{others}</article></div>",
        f"<div id=site-widget><div class=sidebar><article class='no-comments'>{story}</article></div></div>",
        f"<main><div class=page-header><article>{story}</article></div></main>",
        f"<main>{story}<div class=comments><article>nice</article></div><div class=menu>x</div></main>",
        f"<div class='post-and-comments'><article>{story}</article></div>",
        f"<div class='overflow-hidden'>{story}</div>",
        f"<article>{story}</article><aside><div class=nav><article>x</article></div></aside>",
    ]
    got = extracted(spark, [(i, f"https://{i}.example.org/", f"<body>{b}</body>") for i, b in enumerate(bodies)])
    assert set(got.values()) == {"A\nb\nC\nD\ne"}, got


def test_pages_head_left_open(spark):
    """A head ends where something begins that cannot stand in it."""
    bodies = [
        "<html><head><title>t</title><body><article><p>x",
        "<html><head><meta charset=utf-8><link rel=x><style>p{}</style><p>x</html>",
        "<head><script>var a = 1</script>\n x",
        "<head><title>t</title><b>x</b>",
        "<head><title>t</title></head><body><p>x</body>",
    ]
    got = extracted(spark, [(i, f"https://{i}.example.org/", b) for i, b in enumerate(bodies)])
    assert set(got.values()) == {"x"}, got


def test_pages_kinds_and_small_hosts(spark):
    """Layouts of part of a host's pages are templates of their own; five pages that differ are enough for one."""
    def first(i):
        return f"<html><body><div><div>Daily News</div><div>Home World</div></div><div><p>Story {i} begins<p>and ends {i * 7}</div><div>Follow us today</div></body></html>"

    def second(i):
        return f"<html><body><table><tr><td>The Archive</td><td>Old Things</td></tr></table><section><p>Piece {i} opens<p>and closes {i * 3}</section><div>Ask a clerk</div></body></html>"

    def copied(i):
        return f"<html><body><section><p>A story told at length<p>that many a page<p>of this host copies</section><p>{i}</body></html>"

    rows = [(i, "https://two.example.org/", first(i) if i % 5 < 3 else second(i)) for i in range(50)]
    rows += [(100 + i, None, first(i) if i % 5 < 3 else second(i)) for i in range(50)]
    rows += [(200 + i, "https://small.example.org/", first(i)) for i in range(5)]
    rows += [(300 + i, "https://copies.example.org/", first(i) if i % 5 < 3 else copied(i)) for i in range(50)]
    got = extracted(spark, rows)
    for at in (0, 100):
        for i in range(50):
            assert got[at + i] == (f"Story {i} begins\nand ends {i * 7}" if i % 5 < 3 else f"Piece {i} opens\nand closes {i * 3}")
    assert all(got[200 + i] == f"Story {i} begins\nand ends {i * 7}" for i in range(5))
    assert all(got[300 + i] == f"A story told at length\nthat many a page\nof this host copies\n{i}" for i in range(50) if i % 5 >= 3)


def test_pages_story_beside_cards(spark):
    """Articles that hold the lesser part of a page's text do not displace the story."""
    story = "<div><h1>Head of it</h1><p>The story stands in a plain element<p>and is long</div>"
    cards = "<article>Card one</article><article>Card two</article>"
    got = extracted(spark, [(1, "https://a.example.org/", f"<body>{story}{cards}"), (2, "https://b.example.org/", f"<body><div>Menu</div><article>{story}</article>")])
    told = "Head of it\nThe story stands in a plain element\nand is long"
    assert got == {1: f"{told}\nCard one\nCard two", 2: told}


def test_pages_of_copies(spark):
    """Copies of a page are one page, and make no template of its text."""
    def page(i, story="<h1>Head</h1><p>Same story"):
        return f"<html><body><div>Daily News</div><article>{story}</article><div>{i} views</div></body></html>"

    def plain(i):
        return f"<html><body><div><p>A story told at length<p>that many a page<p>of this host copies</div><div>{i}</div></body></html>"

    rows = [(i, "https://one.example.org/", page(0)) for i in range(10)]
    rows += [(100 + i, "https://hot.example.org/", page(0)) for i in range(90)]
    rows += [(200 + i, "https://hot.example.org/", page(i, f"<h1>Head {i}</h1><p>Story {i}")) for i in range(10)]
    rows += [(300 + i, "https://near.example.org/", page(i)) for i in range(12)]
    rows += [(400 + i, "https://plain.example.org/", plain(i)) for i in range(12)]
    got = extracted(spark, rows)
    for first, n in ((0, 10), (100, 90), (300, 12)):
        assert {got[first + i] for i in range(n)} == {"Head\nSame story"}
    assert all(got[200 + i] == f"Head {i}\nStory {i}" for i in range(10))
    assert all(got[400 + i] == f"A story told at length\nthat many a page\nof this host copies\n{i}" for i in range(12))


def test_pages_odd_quotes(spark):
    """A quote opens a value only behind the sign; one that nothing closes is no quote; without a tag's end all is text."""
    cases = {
        "<p title='it's'>World</p><p>don't stop</p>": "World\ndon't stop",
        "<p title='it's'>World": "World",
        '<p><a href="x"">two</a>': "two",
        "<p class=a'b data-x = 'y > z' checked>text</p>it's": "text\nit's",
        '<p class="x>one</p><p>two</p>': "one\ntwo",
        "<p/title='a'/>kept": "kept",
        "a < b, b > c <d": "a < b, b > c <d",
        "<p>1 <2> 3 <!-- x > y --> 4 </p junk> <?php 5 ?> 6": "1 <2> 3 4\n6",
        "<p>a</ b>c<!DOCTYPE x>d": "acd",
    }
    got = extracted(spark, [(i, f"https://{i}.example.org/", page) for i, page in enumerate(cases)])
    assert got == dict(enumerate(cases.values()))


def test_pages_read_in_linear_time():
    def took(page):
        start = time.process_time()
        list(pages.read_page(page))
        return time.process_time() - start

    for bit in ("a<b ", "<b x='", "</a ", "<!-- ", "<div>", "<p>", "<i>", "<script>", "<a href=\"'> ", "<div></i>"):
        small, large = (min(took(bit * n) for _ in range(2)) for n in (20_000, 80_000))
        assert large < 10 * small + 0.1, (bit, small, large)
    deep = "<div>" * 50_000 + "</x>" * 50_000 + "text"
    assert took(deep) < 10
    assert [t for _, t, _, _ in pages.read_page("a<b " * 300_000) if t is not None] == [("a<b " * 300_000).strip()]


@pytest.mark.parametrize("n", [20, 40])
def test_pages_article_text_is_no_template(spark, n):
    """Whatever the number of pages: what articles hold stays, what lies outside and repeats goes."""
    end = "<p>The author lives by the sea</article><div>Seen on all pages</div><div>Also this</div>"
    rows = [(i, "https://a.example.org/", f"<body><div>Daily</div><article><h1>Head {i}</h1><p>Story {i * 7}{end}") for i in range(n)]
    got = extracted(spark, rows)
    assert all(got[i] == f"Head {i}\nStory {i * 7}\nThe author lives by the sea" for i in range(n))


def test_pages_classes_against_plain_deduction(spark):
    """No marks and no telling names: only classes say what is template. Blocks of large classes that every page has go."""
    rnd = np.random.default_rng(4)
    shared = [f"Shared line {i}" for i in range(6)]
    some = [f"Sometimes {i}" for i in range(5)]  # each on its own pages: classes of one
    texts, rows = [], []
    for i in range(60):
        own = [x for x in some if rnd.random() < 0.5] + [f"Own {i} {j}" for j in range(rnd.integers(1, 4))]
        texts.append(shared[:3] + own + shared[3:])
        rows.append((i, "https://plain.example.org/", "<body>" + "".join(f"<div><p>{t}</p></div>" for t in texts[-1])))
    count = Counter(t for page in texts for t in page)
    vector = {t: tuple(page.count(t) for page in texts) for t in count}
    size = Counter(vector.values())
    template = {t for t in count if count[t] >= 0.9 * len(texts) and size[vector[t]] >= 3}
    assert template == set(shared)
    assert extracted(spark, rows) == {i: "\n".join(t for t in page if t not in template) for i, page in enumerate(texts)}


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, 2, 3) for r in rows], DOCS)


def plain_lines(rows):
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    seen, out = set(), [None] * len(rows)
    for r in order:
        own = (rows[r][1] or "").split("\n")
        gone = set()
        for i in range(len(own) - 2):
            w = tuple(own[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[r] = (rows[r][0], len(own), len(gone), "\n".join(x for i, x in enumerate(own) if i not in gone))
    return out


def test_lines_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(int(i), "\n".join(rnd.choice(list("ab "), rnd.integers(0, 12)))) for i in range(60)]
    rows += [(None, "x\ny\nz\nx\ny\nz"), (None, None), (70, ""), (71, "q\nr\ns"), (71, "q\nr\ns"), (72, "l\n" * 5000), (73, "é\n\n\nq\nr\ns")]
    got = [tuple(r) for r in lines.dedup_lines(doc_frame(spark, rows).coalesce(1)).collect()]
    assert Counter(got) == Counter(plain_lines(rows))
    assert lines.lines_query(doc_frame(spark, [])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, dim int, v int, pivot int"


def plain_top(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i is not None and i % 50 == 0:
            s = [(-int(np.dot(q, c)), j is None, j) for j, c in ok if j != i and len(c) == len(q)]
            s.sort(key=lambda t: (t[0], t[1], t[2] or 0))
            out += [(i, n + 1, t[2], -t[0]) for n, t in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("shard,leaf,block", [(4096, 256, 4096), (40, 8, 7)])
def test_top_k_brute_force(spark, monkeypatch, shard, leaf, block):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("BLOCK", block)):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(2)
    centers = rnd.normal(size=(6, 8)) * 3
    rows = [(int(i), (centers[i % 6] + rnd.normal(size=8)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(100)]  # ties
    rows += [(None, rows[0][1]), (2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2050, [1.0, 2.0]), (2051, [3.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS)
    got = sorted(tuple(r) for r in topk.top_k(frame).collect())
    assert [g[:2] + g[3:] for g in got] == [p[:2] + p[3:] for p in sorted(plain_top(rows), key=lambda t: t[:2])]
    assert sorted(got, key=repr) == sorted(plain_top(rows), key=repr)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_exact_scores_of_large_components():
    a = np.array([[float(1 << 30), 3.0]])
    assert topk.exact_scores(a, a)[0, 0] == (1 << 60) + 9


@pytest.mark.parametrize("shard", [4096, 16])
def test_top_k_large_ids_beside_null(spark, monkeypatch, shard):
    """Ids that floating-point numbers cannot hold, in one batch with null ids."""
    monkeypatch.setattr(topk, "SHARD", shard)
    rnd = np.random.default_rng(3)
    near = 1 << 53
    rows = [(near + 1 + 2 * i, rnd.normal(size=4).tolist()) for i in range(60)] + [(None, rnd.normal(size=4).tolist()) for _ in range(40)]
    rows += [(50 * (near // 50 + i), rnd.normal(size=4).tolist()) for i in range(5)] + [(0, rnd.normal(size=4).tolist())]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).coalesce(1)
    assert sorted((tuple(r) for r in topk.top_k(frame).collect()), key=repr) == sorted(plain_top(rows), key=repr)


def test_top_k_rounds_share_scores(spark, monkeypatch):
    """The k-th score of earlier rounds closes pivots, and no shard meets queries that do not ask it."""
    for name, value in (("SHARD", 20), ("LEAF", 8), ("BLOCK", 3)):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(6)
    centers = rnd.normal(size=(24, 8)) * 4
    rows = [(int(i), (centers[i % 24] + 0.3 * rnd.normal(size=8)).tolist()) for i in range(1200)]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS)
    met = []
    monkeypatch.setattr(topk, "stage", lambda df, name, real=topk.stage: met.append((name, out := real(df, name))) or out)
    got = sorted((tuple(r) for r in topk.top_k(frame).collect()), key=repr)
    assert got == sorted(plain_top(rows), key=repr)
    asked = [df.count() for name, df in met if name == "asked"]
    shards = next(df for name, df in met if name == "index").count()
    assert len(asked) == 3 and sum(asked) < 0.5 * 24 * shards
