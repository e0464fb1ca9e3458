"""Extraction of pages: known articles, alignment against a plain table, edge rows."""

import numpy as np
import pytest

from tallyguard.llm import pages

MIDDLE = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return int(table[-1][-1])


def test_alignment_is_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 6, rng.integers(0, 14)).tolist() for _ in range(2))
        places = sorted(pages.common_lines(a, b))
        assert len(places) == plain_lcs(a, b), (a, b)
        rest = iter(b)
        assert all(any(a[i] == x for x in rest) for i in places)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, lines int, host string")
    return {r["page_id"]: r["text"] for r in pages.extract(frame).collect()}


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header>"
    "<nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- ad --><div class='ad box'>Buy</div><article><h1>Head &amp; line</h1>"
    "<p><b>Bold<br><p>One\n two&nbsp;&#233; <i>in</i>side.</p><div id=\"comments\"><p>First!</p></div><form>Mail <input></form>"
    "<p>Last &lt;p&gt;</p>@END<footer>&copy; us</footer></body></html>"
)
WANT = "Head & line\nBold\nOne two é inside.\nLast <p>"


def test_markup(spark):
    rows = [(1, "http://h.example/a/1", PAGE.replace("@END", "</article>")), (2, "http://h.example/a/2", PAGE.replace("@END", ""))]
    assert run(spark, rows) == {1: WANT, 2: WANT}


def test_pages_without_an_article(spark):
    def page(body):
        return f"<html><body><div>Welcome to the site</div><p>{body}</p><p>Second of {body}</p><div>All rights reserved</div></body></html>"

    rows = [(i, f"https://h.example/x/{i}", page(f"text {i}")) for i in range(30)]
    rows += [(100, "https://other.example/x/1", page("alone")), (101, "https://copy.example/y", page("same")), (102, "https://copy.example/y/z", page("same"))]
    got = run(spark, rows)
    assert all(got[i] == f"text {i}\nSecond of text {i}" for i in range(30))
    assert got[100].split("\n")[0] == "Welcome to the site"  # nothing to compare with
    assert got[101] == got[102] and "same" in got[101]


def test_edges(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "", "plain & simple"), (None, "http://h/", "<p>a<p>b"), (4, "http://h/", "<"), (5, "http://h/", "<p>" + "w " * 100_000), (6, "http://k/", "<!-- open"), (7, "http://k/", "a < b")]
    got = run(spark, rows)
    assert got[1] == got[2] == got[6] == "" and got[3] == "plain & simple" and got[None] == "a\nb"
    assert got[5] == " ".join(["w"] * 100_000) and got[7] == "a < b" and got[4] == "<"
    twice = [(9, "u", "<p>x</p>")] * 2
    frame = spark.createDataFrame(twice, "page_id long, url string, html string")
    assert [r["text"] for r in pages.extract(frame).collect()] == ["x", "x"]
    assert pages.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize("partitions", [1, 40])
def test_neighbours_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        table = spark.read.parquet(f"{MIDDLE}/pages.parquet")
        rows = [(r["page_id"], r["url"], r["html"].replace("article", "div")) for r in table.collect()]
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seen = _seen.setdefault("texts", got)
    assert got == seen


_seen: dict = {}


def test_articles_of_the_table(spark):
    """The article of every page, cut out by a plain rule for these well-known templates."""
    import html
    import re

    table = spark.read.parquet(f"{MIDDLE}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
    for r in table.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_copies_that_differ_in_a_menu_line(spark):
    """Neighbouring copies without an article element keep their text although menus and adverts differ."""

    def page(menu):
        return f"<html><body><nav><ul><li>{menu}</li></ul></nav><div class='ad'>Buy {menu}</div><p>The first.</p><p>The second.</p></body></html>"

    got = run(spark, [(i, f"https://h.example/x/{i}", page(f"menu {i}")) for i in range(4)])
    assert got == dict.fromkeys(range(4), "The first.\nThe second.")


def test_lines_outside_the_article(spark):
    """Own lines outside the article stay, those shared with the nearest page go, article lines stay in any case."""

    def page(i):
        return f"<html><body><div>Welcome</div><div>Summary of {i}</div><article><p>Same text.</p></article><p>Note {i}.</p><div>All rights</div></body></html>"

    got = run(spark, [(i, f"https://h.example/x/{i}", page(i)) for i in range(4)])
    assert got == {i: f"Summary of {i}\nSame text.\nNote {i}." for i in range(4)}


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p title="a > b">real text</p>', [("real text", "open")]),
        ("<p title='<b>' class = \"x > y\">one</p>two", [("one", "open"), ("two", "open")]),
        ("<p>one</p><button>x<p>two</p><p>three</p>", [("one", "open"), ("two", "open"), ("three", "open")]),
        ("<p>a</p><select><option>x</select><p>b</p><title>t<p>c</p><svg><p>d</p>", [("a", "open"), ("b", "open"), ("c", "open"), ("d", "open")]),
        ("<button>a</button>b<button>c<p>d</p><button>e</button>f", [("b", "open"), ("d", "open"), ("f", "open")]),
        ("<p>a</p><script>if (a < b) '<p>no</p>'</script><p>b</p><style>x<p>no", [("a", "open"), ("b", "open")]),
        ('<article><section class="related-work"><p>kept</p></section></article>', [("kept", "article")]),
        ('<article><div class="search-engine-notice">a</div><div class="alert-systems">b</div></article>', [("a", "article"), ("b", "article")]),
        ('<article><p>a</p><p class="ad">BUY</p><p>b</p><div class="big cookie-banner">c</div></article>', [("a", "article"), ("BUY", "none"), ("b", "article"), ("c", "none")]),
        ("<p>1 < 2 &amp; 3</p><", [("1 < 2 & 3", "open"), ("<", "open")]),
    ],
)
def test_blocks_of_a_page(page, want):
    assert pages.lines(page) == want


@pytest.mark.parametrize("cells", [pages.CELLS, 1, 7])
def test_longest_common_subsequence(monkeypatch, cells):
    """Against the plain table, also with the lists halved."""
    import random

    monkeypatch.setattr(pages, "CELLS", cells)
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, left = sorted(pages.common_lines(a, b)), iter(b)
        assert len(found) == table[-1][-1] and all(any(y == a[i] for y in left) for i in found)


@pytest.mark.parametrize("text", ["<button>", "<p a=\"", "<", "<title>x", "<a b='\"", "<!-- ", "</p <"])
def test_hard_pages_take_linear_time(text):
    import time

    start = time.process_time()
    pages.lines(text * 50_000)
    assert time.process_time() - start < 10


def test_many_lines_take_bounded_memory():
    import tracemalloc

    a, b = list(range(20_000)), list(range(19_999, -1, -1))
    tracemalloc.start()
    assert len(pages.common_lines(a, b)) == 1
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
