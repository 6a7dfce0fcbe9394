"""Main-text extraction by container paths on which the pages of a host agree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from floorops.llm.common import extended, materialize, sheltered, without

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav aside footer script style noscript template iframe svg button select menu dialog head object canvas audio video map textarea title".split())
#: Elements whose names can tell that they are no main text; headings, paragraphs, cells and inline elements only by names of adverts.
NAMED = frozenset("div section ul ol dl form table fieldset header details center figure address dialog summary".split())


def _words(text: str) -> re.Pattern[str]:
    """Matches names that hold any of the words between hyphens, underscores and ends."""
    return re.compile(rf"(?:^|[_-])(?:{'|'.join(text.split())})(?:$|[_-])")


ADVERTS = "ads? advert adverts advertisement advertisements advertising advertorial adbox adslot sponsor sponsors sponsored promo promos promotion promotions"
#: Words in class, id or role that mark what is no main text, whatever its size.
ADVERT = _words(ADVERTS)
FOREIGN = _words(
    f"{ADVERTS} banner banners cookies? cookiebar cookiebanner cookieconsent consent gdpr popup modal overlay subscribe subscription newsletters? signup login comments? commentlist replies reply respond disqus"
    " discussion reactions pagination pager hidden sr-only copyright legal disclaimer contentinfo"
)
#: Words that mark it unless the element holds most of the page's text.
NOISE = _words(
    "nav navs navbar navigation navlinks navmenu topnav subnav menus? menubar mainmenu submenu breadcrumbs? sidebars? side aside footer foot masthead site-?header page-?header top-?bar toolbar notices? notifications? alerts?"
    " search searchbox searchbar searchform share shares sharebar sharebuttons sharelinks sharing socials? socialbar socialmedia related recommend recommended recommendations trending popular widgets? tags? tag-?list"
    " skip skiplinks? skipnav complementary"
)
#: Class names that say what a page has or how a post is filed, not what the element is.
ABOUT = re.compile(r"(?:has|no|with|without|is|tag|category|format|status)[_-].|comments?[_-](?:open|closed|on|off)$")
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|main\w*|content\w*|post\w*|entry\w*|story\w*|text|body|page)(?:$|[\s_-])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Attributes one after another, each with its value, so that nothing inside a value is taken for a name.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Element:
    """``path`` is a hash of the tags and classes from the root, made of the parent's; ``node`` its number in the page."""

    __slots__ = ("tag", "own", "parent", "node", "box", "article", "hard", "soft", "drop", "size", "heading", "named")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        got: dict[str, str] = {}
        for m in _ATTR.finditer(attrs) if attrs else ():
            got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of repeated attributes the first counts
        names = f"{got.get('class', '')} {got.get('id', '')} {got.get('role', '')}".lower().split()
        telling = [n for n in names if not ABOUT.match(n)]
        kept = tag in ("html", "body", "main", "article")
        foreign = not kept and any(map((FOREIGN if tag in NAMED else ADVERT).search, telling))
        noise = tag in NAMED and any(map(NOISE.search, telling))
        hidden = "hidden" in got or got.get("aria-hidden") == "true" or bool(_HIDDEN.search(got.get("style", "")))
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        dropped = tag in DROPPED or (tag == "header" and not self.article)
        self.hard = hidden or dropped or (tag not in BLOCK and foreign) or (parent is not None and parent.hard)
        #: 2: dropped if it is not the page's headline and text, 1: or if it isn't called like main text, 0: kept
        self.soft = 2 if foreign else 1 if noise or tag == "form" else 0
        self.named = bool(GOOD.search(" ".join(telling)))
        name = " ".join(sorted(_DIGITS.sub("#", got.get("class", "")).lower().split()))
        self.own = tag + ("." + name.replace(" ", ".") if name else "")
        self.box = self if tag in CONTAINERS or parent is None else parent.box
        self.size, self.heading, self.node, self.drop = 0, tag == "h1", 0, False


class Page:
    """The elements that stand open, and the blocks of text found so far.

    Places in the stack of each tag, of blocks and of scopes are kept, so that
    no tag looks through the stack, however deep it is.
    """

    def __init__(self) -> None:
        root = Element("html", "", None)
        self.elements, self.stack = [root], [root]
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = [0]
        self.scopes: list[int] = [0]
        self.blocks: list[tuple[Element, str, int]] = []
        self.text: list[str] = []
        self.links = self.linked = 0

    def open(self, tag: str, attrs: str) -> None:
        e = Element(tag, attrs, self.stack[-1])
        at = len(self.stack)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.block_places.append(at)
        if tag in SCOPES or e.hard and not self.stack[-1].hard:
            self.scopes.append(at)
        self.stack.append(e)
        self.elements.append(e)

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            at = len(self.stack) - 1
            self.places[self.stack.pop().tag].pop()
            for places in (self.block_places, self.scopes):
                if places[-1] == at:
                    places.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def add(self, piece: str) -> None:
        if not self.stack[-1].hard:
            self.text.append(piece)
            self.linked += len(piece) * bool(self.links)

    def flush(self) -> None:
        """End the block of text, unless it goes on after what is dropped here."""
        if self.stack[-1].hard:
            return
        if self.text:
            whole = _SPACE.sub(" ", unescape("".join(self.text))).strip()
            if whole:
                self.blocks.append((self.stack[self.block_places[-1]], whole, self.linked))
            self.text.clear()
        self.linked = 0

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.flush()
            scope = self.scopes[-1]
            if tag in LISTED and self.last(tag) > scope:
                self.close(self.last(tag))
            elif self.last("p") > scope:
                self.close(self.last("p"))
        if tag in VOID or tag == "html" or attrs.endswith("/") and tag not in BLOCK:
            return
        if tag == "a":
            self.links += 1
        self.open(tag, attrs)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        at = self.last(tag)
        if tag in BLOCK:
            self.flush()
        if at and (tag in BLOCK or self.block_places[-1] <= at or self.stack[at].hard):
            self.close(at)


#: Elements of which a new one ends an open one, and elements beyond which a start tag ends nothing.
LISTED = frozenset("li td th tr dd dt option".split())
SCOPES = frozenset("ul ol table div article section body dl select".split())


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" if it closes, tag in lower case, attributes) of each tag; comments and declarations have no tag.

    A tag ends at the first ``>`` outside quotes, or at the first one of all
    where quotes are left open; what begins after the last ``>`` is none. The
    search outside quotes is given up after reading the page some times over in
    vain, so the time grows with the page's length whatever is broken.
    """
    n, at, last = len(html), 0, html.rfind(">")
    room = 8 * n
    while (lt := html.find("<", at)) >= 0:
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            yield lt, at, "", "", ""
            continue
        if lt > last:
            return
        if html[lt + 1 : lt + 2] in ("!", "?"):
            at = html.index(">", lt) + 1
            yield lt, at, "", "", ""
            continue
        m = _TAG.match(html, lt) if room > 0 else None
        if m is None and (m := _PLAIN_TAG.match(html, lt)):
            room -= n - lt
        if m is None:
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if tag in RAW and not m[1]:  # with all that is inside
            stop = _RAW_END[tag].search(html, at)
            at = stop.end() if stop else n
            yield lt, at, "", "", ""
        else:
            yield lt, at, m[1], tag, m[3]


def blocks(html: str) -> list[tuple[Element, str, int]]:
    """(innermost block element, text, characters in links) of each block of text outside dropped elements, in page order.

    Tags may be left open: a block element ends an open paragraph, an end tag
    closes what stands open inside it, and end tags without a start are passed
    over. Text inside dropped inline elements is left out of its block, and the
    block goes on after them.
    """
    page = Page()
    at = 0
    for start, end, closes, tag, attrs in _tags(html):
        if start > at:
            page.add(html[at:start])
        at = end
        if not tag:
            continue
        if closes:
            page.end(tag)
        elif tag == "br":
            page.add(" ")
        else:
            page.start(tag, attrs)
    rest = html[at:]
    if rest and not re.match(r"<[a-zA-Z/!]", rest):
        page.add(rest)
    page.close(1)
    page.flush()
    return _without_noise(page)


_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _without_noise(page: Page) -> list[tuple[Element, str, int]]:
    """The blocks outside elements that are called like noise, but for those that hold most of the text.

    An element that holds half of the page's text is kept if it also has the
    page's headline, or a name of main text beside that of slight noise. If
    nothing would be left, elements with a name of main text stay.
    """
    total = 0
    for e, text, linked in page.blocks:
        own = max(0, len(text) - linked)
        e.size += own
        total += own
    for e in reversed(page.elements[1:]):
        e.parent.size += e.size
        e.parent.heading = e.parent.heading or e.heading
    for e in page.elements[1:]:
        large = 2 * e.size >= total and total > 0 and (e.heading or (e.soft == 1 and (e.named or e.tag == "form")))
        e.drop = e.parent.drop or (e.soft > 0 and not large)
    left = [b for b in page.blocks if not b[0].drop]
    if left or not total:
        return left
    for e in page.elements[1:]:
        e.drop = e.parent.drop or (e.soft > 0 and not e.named)
    return [b for b in page.blocks if not b[0].drop]


class Paths:
    """The different paths of a page as (hash, place of the parent's path), parents first."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.hashes: list[int] = []
        self.parents: list[int] = []

    def of(self, e: Element) -> int:
        """Place of an element's path; those above it are added with it."""
        todo = []
        while e is not None and not e.node:
            todo.append(e)
            e = e.parent
        for x in reversed(todo):
            up = x.parent.node - 1 if x.parent is not None else -1
            at = self.known.setdefault((up, x.own), len(self.hashes))
            if at == len(self.hashes):
                above = self.hashes[up] if up >= 0 else 0
                self.hashes.append(xxh64_intdigest(f"{above}>{x.own}".encode("utf-8", "replace")) - (1 << 63))
                self.parents.append(up)
            x.node = at + 1
        return (todo[0] if todo else e).node - 1


def container_scores(found: list[tuple[Element, str, int]], paths: Paths) -> dict[int, float]:
    """Score of each generalised container path of a page, by its place: text outside links, raised or lowered by its names."""
    scores: dict[int, float] = {}
    last: dict[int, Element] = {}
    for e, text, linked in found:
        own = max(0, len(text) - 2 * linked)
        if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "li"):
            own /= 2
        c: Element | None = e.box
        share = 1.0
        while c is not None and share > 0.1:
            at = paths.of(c)
            scores[at] = scores.get(at, 0.0) + own * share
            last[at] = c
            share /= 1.25
            c = c.parent.box if c.parent is not None else None
    for at, e in last.items():
        tag, _, names = e.own.partition(".")
        if tag in ("article", "main"):
            scores[at] *= 1.5
        elif GOOD.search(names.replace(".", " ")):
            scores[at] *= 1.3
        elif tag in ("body", "html"):
            scores[at] *= 0.9
    return scores


def _host(url_col: str):
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.coalesce(host, F.lit(""))


def read_blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Put in place of the html what later passes need.

    ``_hashes`` and ``_parents`` are the different paths of the page that hold
    text (a hash, and the place of the path above), ``_blocks`` the blocks
    (place of the path, text), ``_best`` the best container's hash, ``_score``
    its score. So a page takes no more room than its html, however deep.
    """
    names, at = pages.columns, pages.columns.index(html_col)
    rest = [i for i in range(len(names)) if i != at]
    new = ["_hashes", "_parents", "_blocks", "_best", "_score"]
    block = pa.list_(pa.struct([("path", pa.int32()), ("text", pa.string())]))
    types = [pa.list_(pa.int64()), pa.list_(pa.int32()), block, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                out: list[list] = [[] for _ in new]
                for html in some.column(at).to_pylist():
                    found, paths = blocks(html or ""), Paths()
                    rows = [{"path": paths.of(e), "text": t} for e, t, _ in found]
                    scores = container_scores(found, paths)
                    best = max(scores, key=lambda p: (scores[p], paths.hashes[p])) if scores else None
                    values = (paths.hashes, paths.parents, rows, None if best is None else paths.hashes[best], int(scores.get(best, 0)))
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in rest), *map(pa.array, out, types)], names=[*(names[i] for i in rest), *new])

    return pages.mapInArrow(run, extended(pages.drop(html_col), "_hashes array<long>, _parents array<int>, _blocks array<struct<path:int,text:string>>, _best long, _score long"))


def host_paths(read: DataFrame) -> DataFrame:
    """(_host, _path): the container path that most pages of a host score highest; ties to the higher score, then the path's hash."""
    votes = read.filter(F.col("_best").isNotNull()).groupBy("_host", "_best").agg(F.count("*").alias("n"), F.sum("_score").alias("score"))
    return votes.groupBy("_host").agg(F.max_by("_best", F.struct("n", "score", "_best")).alias("_path"))


def _texts(joined: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns and ``main_text``: the blocks under the host's path, or under the page's own best one if none is."""
    schema = extended(joined.select(*[F.col(f"`{c}`") for c in kept]), "main_text string")
    names = joined.columns
    rest = [names.index(c) for c in kept]
    hashes, parents, rows, best, path = (names.index(c) for c in ("_hashes", "_parents", "_blocks", "_best", "_path"))

    def under(page: tuple, win: int | None) -> list[str]:
        inside: list[bool] = []
        for h, up in zip(page[0], page[1], strict=True):
            inside.append(h == win or (up >= 0 and inside[up]))
        return [b["text"] for b in page[2] if inside[b["path"]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                out = []
                for *page, own, win in zip(*(some.column(i).to_pylist() for i in (hashes, parents, rows, best, path)), strict=True):
                    out.append("\n".join(under(page, win) or under(page, own)))
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in rest), pa.array(out, pa.string())], names=[*kept, "main_text"])

    return joined.mapInArrow(run, schema)


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The article of each page, by its host's consensus: ``pages`` with ``main_text`` in place of the html.

    Each page's containers are scored by their text outside links; each page
    votes for the tag-and-class path of its best container (digits in classes
    count as one sign; a 64-bit hash stands for the path); Spark counts the
    votes per host, where votes are summed before the shuffle, so a hot host is
    no burden; every page is then extracted at its host's winning path, or at
    its own best container if it has no block under that path. Menus, headers,
    footers, sidebars, notices, adverts, forms, comments, scripts and styles are
    left out, but names alone do not drop an element that holds most of the
    page's text. Blocks are trimmed, white space in them becomes one space, and
    they are joined by line feeds. The pages are parsed once; their blocks are
    written to the shared folder, and votes and extraction work on those.

    The winning paths are broadcast if a count shows them within
    ``broadcast_bytes``; beyond that they are joined by host.

    Defined cases: null or empty html gives an empty text; pages without a host
    in the url vote together; repeated pages vote each; time and memory grow
    with the html, not with its depth; an empty table gives an empty result; an
    input column called ``main_text`` is replaced, others are kept.
    """
    pages, back = sheltered(without(pages, "main_text"), url_col, html_col)
    read = materialize(read_blocks(pages, html_col), "blocks").withColumn("_host", _host(url_col))
    winners = materialize(host_paths(read), "paths")
    size = winners.agg(F.sum(F.octet_length("_host") + 24)).first()[0] or 0
    joined = read.join(F.broadcast(winners) if size <= broadcast_bytes else winners, "_host", "left")
    kept = [c for c in pages.columns if c != html_col]
    named = back(_texts(joined, kept).withColumn(html_col, F.col("main_text")))
    return named.select(*[F.col(f"`{c}`") for c in named.columns if c != html_col], F.col(f"`{html_col}`").alias("main_text"))
