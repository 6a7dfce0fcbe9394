"""Main-text extraction on single pages."""

import time
from html.parser import HTMLParser

import pytest

from floorops.llm import html

LONG = "The river rose in the night and the lower town was cut off until the morning, when boats came."


def text(spark, *pages):
    rows = [(i, f"http://h{i}.example/x", p) for i, p in enumerate(pages)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "main_text"]
    return [r["main_text"] for r in got.orderBy("page_id").collect()]


CASES = [
    ("<p>Hello <button>Share</button> world</p>", "Hello world"),
    ("<p>a</p><button>Subscribe now</button><p>b</p>", "a\nb"),
    ('<p>a <span class="ad">buy</span>b <span hidden>no</span>c</p>', "a b c"),
    ("<p>see <svg><title>x</title><text>label</text></svg>it</p>", "see it"),
    ("<p>Choose one <select><option>x<option>y</select> of these.</p>", "Choose one of these."),
    ("<p>one <button><div>x</div></button> two</p>", "one two"),
    (f'<div class="post hentry tag-news"><h1>T</h1><p>{LONG}</p></div>', f"T\n{LONG}"),
    (f'<div id="content" class="has-sidebar"><p>{LONG}</p></div><div class="sidebar"><p>Latest</p></div>', LONG),
    (f'<div class="page-side content"><p>{LONG}</p></div>', LONG),
    (f'<form id="all"><div class="content"><h1>T</h1><p>{LONG}</p></div></form>', f"T\n{LONG}"),
    (f'<article><p>{LONG}</p></article><section id="comments" class="content"><p>{LONG}</p><p>{LONG}</p></section>', LONG),
    (f"<article><p>{LONG}</p><form><p>Your mail</p></form></article>", LONG),
    ("<ul><li>a<li>b<p>c<li>d</ul>", "a\nb\nc\nd"),
    ("a &amp; b &#x41;&nbsp;c", "a & b A c"),
    ("<b>bold<div>x</b>y</div>", "bold\nxy"),
    # names inside values are no attributes, and headings, paragraphs and inline elements are not judged by theirs
    ('<p>one</p><p title="a hidden gem" data-x=\'class="ad"\'>Second paragraph.</p>', "one\nSecond paragraph."),
    ('<div data-note="style=\'display:none\'">kept</div><div style="display : none">gone</div>', "kept"),
    ('<h2 id="related-work">Related</h2><p>a</p><h2 id="search">Search</h2><p>b</p><h2 id="legal">Law</h2>', "Related\na\nSearch\nb\nLaw"),
    (f'<p>{LONG}</p><section id="shareholders"><p>Who holds shares.</p></section><p class="navy">Blue.</p>', f"{LONG}\nWho holds shares.\nBlue."),
    ('<p>Look for <mark class="search-hit">needles</mark> here and <span class="alert">there</span>.</p>', "Look for needles here and there."),
    (f'<div class="comments-open post"><p>{LONG}</p></div>', LONG),
    (f'<div class="comments post"><p>{LONG}</p></div>', LONG),
    (f'<p>{LONG}</p><div class="cookie-notice"><p>We use cookies.</p></div><ul class="share-links"><li>Mail</ul><p class="advertisement">Buy</p><div class="main-nav">x</div>', LONG),
    (f'<p class="a" class="ad">{LONG}</p>', LONG),
    ('<a title="x > y">in</a> <b a=\'>\' c=">">bold</b>', "in bold"),
    ('a <b class="open>left</b> c', "a left c"),
]


def test_cases(spark):
    assert text(spark, *[f"<html><body>{p}</body></html>" for p, _ in CASES]) == [t for _, t in CASES]


@pytest.mark.parametrize("piece", ["<div>x", "<b>x", "<p>x<b>", "<div><b>x</i>", "<div></b>x", "<span class=a><div>x"])
def test_deep_pages_take_time_and_room_by_their_length(piece):
    def once(n):
        t = time.process_time()
        found, paths = html.blocks(piece * n), html.Paths()
        html.container_scores(found, paths)
        places = [paths.of(e) for e, _, _ in found]
        assert len(paths.hashes) <= n * 3 + 2 and len(places) == len(found)
        return time.process_time() - t

    once(100)
    assert once(50_000) < 12


def test_other_columns_and_repeated_pages(spark):
    rows = [("a", 1, "http://h.example", f"<p>{LONG}</p>", "m"), ("b", 1, "http://h.example", f"<p>{LONG}</p>", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "_host string, page_id long, url string, html string, `_best` string")
    got = html.extract_main_text(df)
    assert got.columns == ["_host", "page_id", "url", "_best", "main_text"]
    assert sorted(((r["_host"], r["_best"], r["main_text"]) for r in got.collect()), key=repr) == sorted([("a", "m", LONG), ("b", None, LONG), (None, None, "")], key=repr)
    assert html.extract_main_text(df.filter("false")).count() == 0


@pytest.mark.parametrize("piece", ["<a ", "<p x='", "<p x=\"'", "<i '>'", "<i x='>'", "<!", "<", "<!--", "</", "<a b=\"c>", "<script>", "<title x='"])
def test_broken_markup_takes_time_by_its_length(piece):
    t = time.process_time()
    html.blocks(piece * (1_000_000 // len(piece)))
    html.blocks(piece * (1_000_000 // len(piece)) + ">")
    assert time.process_time() - t < 20
    t = time.process_time()
    if piece in ("<a ", "<p x='"):
        html.blocks(piece * (1_000_000 // len(piece)))
        assert time.process_time() - t < 2


class Plain(HTMLParser):
    """The blocks of the article of a well-formed page."""

    def __init__(self):
        super().__init__()
        self.inside, self.out, self.blocks, self.text = False, 0, [], []

    def flush(self):
        if t := " ".join("".join(self.text).split()):
            self.blocks.append(t)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "h2", "li", "ul", "div"):
            self.flush()
        self.inside |= tag == "article"
        self.out += tag in ("nav", "aside", "footer", "header", "form", "script", "style") or (tag == "div" and self.inside and ("class", "ad") in attrs)

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "h2", "li", "ul", "div"):
            self.flush()
        self.inside &= tag != "article"
        self.out -= tag in ("nav", "aside", "footer", "header", "form", "script", "style") or (tag == "div" and self.out > 0)

    def handle_data(self, data):
        if self.inside and not self.out:
            self.text.append(data)


def test_all_given_pages_as_a_plain_parser_reads_them(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["main_text"] for r in html.extract_main_text(pages).collect()}
    same = 0
    for r in pages.collect():
        p = Plain()
        p.feed(r["html"] or "")
        p.flush()
        same += got[r["page_id"]] == "\n".join(p.blocks)
    assert same == len(got) > 200
