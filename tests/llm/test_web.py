"""HTML extraction and WARC archives."""

import base64
import gzip
import hashlib
import math
import os
import random
import time
from html.parser import HTMLParser

import pytest

from pyspark.sql import functions as F

from tablemove.llm import html_extract, warc

P = "A first sentence, with a comma. And a second one; it is long enough to be text."
PAGES = {
    "plain": (f"<html><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{P}</p><p>{P} More.</article><footer>&copy; x.</footer>", ["Head", P, f"{P} More."]),
    "references": ("<article><p>a &amp; b &lt;c&gt; &eacute; &#8364; &amp x</p></article>", ["a & b <c> é € & x"]),
    "blanks": ("<article><p>  one\n\t two <b>three</b>four<br>five&nbsp;six </p></article>", ["one two threefour five six"]),
    "unclosed": (f"<article><p><b>Bold start.<br><p>{P}<ul><li>one<li>two</ul></article><div class='ad'>Buy, now.</div>", ["Bold start.", P, "one", "two"]),
    "scripts": (f"<article><script>var a='<p>no</p>';</script><style>p{{}}</style><p>{P}</p><!-- <p>no</p> --><form><p>Your name, please.</p></form></article>", [P]),
    "cut off": (f"<article><h1>T</h1><p>{P}</p><p>and it br", ["T", P, "and it br"]),
    "header in article": (f"<header><p>Site, name.</p></header><article><header><h1>Title</h1></header><p>{P}</p></article>", ["Title", P]),
    "comments": (f"<article><p>{P}</p><section class='comments'><p>{P}</p></section></article><aside><p>{P}</p></aside>", [P]),
    "no article": (
        f"<body><div class='top-menu'><a href=a>A</a></div><div id=content><h2>Head</h2><p>{P}</p><p>{P}</p></div><div class=box><span>x</span></div>"
        f"<div class='cookie-notice'>{P}</div><div class='links'><a href=a>one, two</a> <a href=b>three</a></div></body>", ["Head", P, P]),
    "attributes with >": (f"<article data-x='a>b' class=\"post\"><p title=\"<p>\">{P}</p></article>", [P]),
    "none": ("<html><head><title>T</title></head><body><nav>a</nav></body></html>", []),
    "text only": ("Just text, no tags.", ["Just text, no tags."]),
    "stray <": ("<article><p>a < b and 3<4, so.</p></article>", ["a < b and 3<4, so."]),
    "table of contents": (f"<article><ul><li><a href=#a>One</a><li><a href=#b>Two</a></ul><p>{P}</p></article>", [P]),
}


RAW_PAGES = {
    "less than": (f"<script>for(i=0;i<n;i++){{f(i);}}</script><article><p>{P}</p></article>", [P]),
    "no > in the script": (f"<head><script>if(a<b)f('x')</script ></head><article><p>{P}</p><style>a<b</STYLE><p>after</p></article>", [P, "after"]),
    "quotes and comments": (f"<script>a<b+\"'</script><textarea><!-- </textarea><article><p>{P}</p></article>", [P]),
    "longer name": (f"<script>a('</scripts>')</script><article><svg/><p>{P}</p></article>", [P]),
    "no end": (f"<article><p>{P}</p></article><script>a<b", [P]),
}


@pytest.mark.parametrize("name", RAW_PAGES)
def test_raw_elements_end_at_their_end_tag(name):
    page, want = RAW_PAGES[name]
    assert html_extract.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html_extract.main_text(page) == "\n\n".join(want)


LONG = ("A long paragraph of some length, with marks; it goes on, and on. " * 6).strip()
SHORT = "A hundred characters or so of running text in a container of its own, which has but one mark and ends"
UNMARKED_PAGES = {
    "short container": (f"<div class=a><p>{LONG}</p></div><div class=b><p>{SHORT}</p></div>", [LONG, SHORT]),
    "title alone": (f"<div class=title><h1>Title</h1></div><div class=body><p>{LONG}</p></div>", ["Title", LONG]),
    "title and byline": (f"<div class=t><h1>Title</h1></div><div class=by>J. D.</div><div class=body><p>{LONG}</p></div>", ["Title", "J. D.", LONG]),
    "headings": (f"<div class=t><h1>One</h1></div><div class=u><h2>Two</h2></div><div class=c><p>{LONG}</p></div><div class=v><h2>Three</h2></div>", ["One", "Two", LONG]),
    "between": (f"<div class=a><p>{LONG}</p></div><div class=b>Ah</div><div class=c><p>{LONG}</p></div><div class=d>x</div>", [LONG, "Ah", LONG]),
    "links between": (f"<div class=a><p>{LONG}</p></div><div class=b><a href=x>Ah, so.</a></div><div class=c><p>{LONG}</p></div>", [LONG, LONG]),
    "lead": (f"<div class=lead>What this page is about in one line</div><div class=body><p>{LONG}</p></div>", ["What this page is about in one line", LONG]),
    "articles": (f"<article><p>{LONG}</p></article><article><p>Short one</p></article><article><a href=x>Read, more.</a></article>", [LONG, "Short one"]),
}


@pytest.mark.parametrize("name", UNMARKED_PAGES)
def test_short_text_stays(name):
    page, want = UNMARKED_PAGES[name]
    assert html_extract.main_text(page) == "\n\n".join(want)


MARKED_PAGES = {
    "sidebar": (f"<div class='content has-sidebar'><article><h1>T</h1><p>{P}</p></article></div>", ["T", P]),
    "no comments": (f"<div class=no-comments><div class=search-page><div class=post-header><h1>T</h1></div><p>{P}</p></div></div>", ["T", P]),
    "form": (f"<body><form><nav><p>Menu, one.</p></nav><article><h1>T</h1><p>{P}</p></article><footer><p>F, f.</p></footer></form>", ["T", P]),
    "form without article": (f"<form><nav><p>Menu, one.</p></nav><h1>T</h1><p>{P}</p><div class=site-footer><p>F, f.</p></div></form>", ["T", P]),
    "form in main": (f"<main><form><div class=sidebar><p>S, s.</p></div><h1>T</h1><p>{P}</p></form></main>", ["T", P]),
    "sidebar token": (f"<div class='content sidebar'><p>{P}</p><p>{P}</p></div>", [P, P]),
    "aside only": (f"<aside><article><p>{P}</p></article></aside>", [P]),
    "teasers": (f"<article><p>{P}</p></article><aside><article><p>Teaser, one.</p></article></aside>", [P]),
    "comment articles": (f"<article><h1>T</h1><p>{P}</p></article><div id=comments>{f'<article><p>{P[:60]}</p></article>' * 9}</div>", ["T", P]),
    "long comments": (f"<article><h1>T</h1><p>{P}</p><section class=comment-list>{f'<p>{P}</p>' * 9}</section></article>", ["T", P]),
    "long consent": (f"<h1>T</h1><p>{P}</p><div class=cookie-consent>{f'<p>{P}</p>' * 9}</div>", ["T", P]),
    "inline": (f"<article><p><a class=social>Share</a> {P}</p><p>See <a class=related>the river</a>, too.</p><p><a class=share>x</a></p></article>", [P, "See the river, too."]),
}


@pytest.mark.parametrize("name", MARKED_PAGES)
def test_marks_leave_main_text(name):
    page, want = MARKED_PAGES[name]
    assert html_extract.main_text(page) == "\n\n".join(want)


FOREIGN = """comment-content comment-body comment-text user-comments post-comments related-articles sponsored-content ad-unit share-this
cookie-law-info promo-card comments__body c-comment__text userComments commentList in-article-ad article-sidebar newsletter-box social-share
sidebar-widget ad_slot js-ad comment-123""".split()


@pytest.mark.parametrize("name", FOREIGN)
def test_foreign_text_in_an_article_goes(name):
    for element in ("div", "section", "article"):
        foreign = f"<{element} class='x {name}'><p>{P}</p></{element}>"
        assert html_extract.main_text(f"<article><h1>T</h1><p>{P} More.</p>{foreign}<p>End.</p></article>") == f"T\n\n{P} More.\n\nEnd."
        assert html_extract.main_text(f"<main><h1>T</h1><p>{P} More.</p></main>{foreign}") == f"T\n\n{P} More."


@pytest.mark.parametrize("name", ["has-comments", "no-sidebar", "with-ads", "post-header", "commentary", "adverbs", "market-legal-note"])
def test_other_names_stay(name):
    assert html_extract.main_text(f"<article><h1>T</h1><p>{P}</p><div class={name}><p>Said here.</p></div></article>") == f"T\n\n{P}\n\nSaid here."


QUOTES = {
    "in a value": ("<article><p data-x=it's>Hello</p><p>World's end</p><p>End.</p></article>", "Hello\n\nWorld's end\n\nEnd."),
    "one too many": (f'<article><p><a href="x"">One</a> two, three.</p><p>{P}</p></article>', f"One two, three.\n\n{P}"),
    "never closed": (f'<article><p><a title="x>One</a> two, three.</p><p>{P}</p></article>', f"One two, three.\n\n{P}"),
    "class in a value": (f"<article><p>{P}</p><p title='class=ad' data-class=comments>Yes, stays.</p></article>", f"{P}\n\nYes, stays."),
    "odd end tags": (f"<article><p>{P}</></ p>more</p></article>", f"{P}more"),
}


@pytest.mark.parametrize("name", QUOTES)
def test_quotes(name):
    page, want = QUOTES[name]
    assert html_extract.main_text(page) == want


def test_link_lists():
    one = "<ul><li><a href={}a>One</a><li><a href={}b>Two</a></ul>"
    assert html_extract.main_text(f"<article><p>{P}</p>{one.format('/', '/')}<p>{P}</p></article>") == f"{P}\n\nOne\n\nTwo\n\n{P}"
    assert html_extract.main_text(f"<article><p>{P}</p>{one.format('#', '#')}<p>{P}</p></article>") == f"{P}\n\n{P}"
    assert html_extract.main_text(f"<div><p>{P}</p>{one.format('/', '/')}<p>{P}</p></div>") == f"{P}\n\n{P}"


@pytest.mark.parametrize("part", ["<div>x", "<div class=ad>x", "<p><button><span><div>x", "<table><tr><td>x</p>", "<a class=ad>x<div>", "</div><b>x"])
def test_deep_pages_take_linear_time(part):
    def seconds(n):
        start = time.process_time()
        html_extract.main_text(part * n)
        return time.process_time() - start

    seconds(1_000)
    few = min(seconds(8_000) for _ in range(3))
    assert few < 1 and min(seconds(32_000) for _ in range(2)) < 10 * few + 0.2


class Paths(HTMLParser):
    """Brute force: the text nodes of a well-formed page with the whole path of each, as lists."""

    def __init__(self, page):
        super().__init__()
        self.open, self.nodes = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, len(self.nodes), dict(attrs).get("class")))

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.nodes.append(([f"{t}.{c}" if c else t for t, _, c in self.open if t != "a"], data, any(t == "a" for t, _, _ in self.open), [x for x in self.open if x[0] == "article"][:1]))


def brute_scores(page):
    nodes = Paths(page).nodes
    any_article = any(n[3] for n in nodes)

    def ratio(some):
        text = sum(0 if linked else len(t) for _, t, linked, _ in some) / len(some)
        marks = sum(0 if linked else sum(c in ".,;:!?" for c in t) for _, t, linked, _ in some) / len(some)
        return math.sqrt(min(text, 500) * (1 + min(marks, 15)))

    def around(n):
        return ("article", n[3][0][1]) if n[3] else ("path", n[0][:-1])

    out = []
    for n in nodes:
        own = ratio([x for x in nodes if x[0] == n[0]])
        near = ratio([x for x in nodes if around(x) == around(n)])
        out.append((own + near) / 2 * (0.02 if any_article and not n[3] else 1))
    return out


def test_path_scores_by_brute_force():
    draw = random.Random(7)

    def inside(depth):
        got = ""
        for _ in range(draw.randint(1, 4)):
            tag = draw.choice(["div", "div class=a", "div class=b", "section", "p"])
            text = "".join(draw.choice(["word", "so", "a longer one", ",", ".", " "]) for _ in range(draw.choice([1, 5, 60, 400]))).strip() or "x"
            text = f"<a>{' '.join(text.split())}</a>" if draw.random() < 0.2 else " ".join(text.split())
            got += f"<{tag}>{inside(depth - 1) if depth and tag != 'p' and draw.random() < 0.6 else text}</{tag.split()[0]}>"
        return got

    for _ in range(150):
        page = "<body>" + "".join(draw.choice([inside(2), f"<article>{inside(2)}</article>"]) for _ in range(draw.randint(1, 3))) + "</body>"
        found = html_extract.blocks(page)
        scores, want = html_extract.path_scores(found), brute_scores(page)
        assert [scores[b.path, b.container] for b in found] == pytest.approx(want)
        assert [b.text for b in found] == [n[1] for n in Paths(page).nodes]
        kept, best = html_extract.main_text(page).split("\n\n"), max(want)
        for b, score in zip(found, want):
            assert score < 0.1 * best or b.text in kept  # all paths over the threshold stay, on pages with articles and without


def test_ratios_decide_with_articles_too():
    teasers = "".join(f"<article><a href=/{k}>Read on, number {k}.</a></article>" for k in range(3))
    assert html_extract.main_text(f"{teasers}<div class=body><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n\n{LONG}"
    assert html_extract.main_text(f"<div class=x1><p>{SHORT}</p></div><article><p>{LONG}</p></article><div class=x2><p>{SHORT}</p></div>") == LONG
    items = "".join(f"<li>item {k}</li>" for k in range(2_000))
    assert html_extract.main_text(f"<article><p>{LONG * 300}</p><ul>{items}</ul></article>").endswith("item 1998\n\nitem 1999")


def test_extract_table(spark):
    rows = [(1, None), (2, ""), (3, PAGES["plain"][0]), (3, PAGES["plain"][0]), (None, "<p>" * 3000 + "deep, text."), (4, f"<article><p>{'word, ' * 100_000}</p></article>")]
    table = spark.createDataFrame([(i, h, "old") for i, h in rows], "page_id long, html string, text string")
    got = html_extract.extract(spark, table).collect()
    assert [r.text for r in got][:3] == ["", "", "\n\n".join(PAGES["plain"][1])] and got[2].text == got[3].text
    assert got[4].text == "deep, text." and len(got[5].text) == 599_999 and list(got[0].asDict()) == ["page_id", "html", "text"]
    assert html_extract.extract(spark, table.limit(0)).count() == 0


# ------------------------------------------------------------------ WARC
ROWS = [
    (1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, "http://c", "same"), (3, "http://c", "same"), (4, None, None), (5, "http://e", ""),
    (6, "http://f", "é€\U0001f600 " * 20_000), (7, "http://g", "WARC/1.1\r\n\r\n\r\nWARC-Type: response\r\n\r\n"), (None, "http://n", "same"), (8, "u", "x" * 70_000), (9, "u", "x" * 70_000),
]
SCHEMA = "page_id long, url string, html string, id string, digest string, to string"


def written(spark, tmp, **options):
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in ROWS], SCHEMA)
    warc.write_archives(spark, table, f"{tmp}/w", **options)
    return warc.read_pages(spark, f"{tmp}/w")


@pytest.mark.parametrize("segment", [1_000, 16_384, 1 << 30])
def test_round_trip(spark, tmp, segment):
    pages = written(spark, tmp, segment=segment).collect()
    assert len(pages) == len(ROWS) and not [r for r in pages if r.problem]
    want = {1: 3, 2: 3, 4: 5, 8: 9}
    assert sorted((r.page_id, r.refers_to) for r in pages if r.record_type == "revisit") == sorted(want.items())
    html = {i: h or "" for i, _, h in ROWS}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in pages if r.record_type == "response")
    assert {r.page_id: r.url for r in pages}[2] == "http://b X: y"
    light = warc.resolve(spark, written(spark, f"{tmp}/2", segment=segment)).collect()
    for r in light:
        data = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())


def test_damaged_record_keeps_its_row(spark, tmp):
    pages = written(spark, tmp)
    hit = F.col("page_id") == 9
    damaged = pages.withColumn("problem", F.when(hit, F.lit("the payload digest differs"))).withColumn("payload", F.when(hit, F.lit(None)).otherwise(F.col("payload")))
    found = {r.page_id: r for r in warc.resolve(spark, damaged).collect()}
    assert set(found) == {i for i, _, _ in ROWS}
    assert found[9].problem == "the payload digest differs" and found[9].payload_bytes is None and found[8].payload_bytes is None
    rest = {i: (r.payload_bytes, r.problem, r.record_type, r.refers_to) for i, r in found.items() if i not in (8, 9)}
    assert [i for i, (n, p, _, _) in rest.items() if n is None or p is not None] == []


def test_least_bytes(spark, tmp):
    pages = written(spark, tmp, least_bytes=100).collect()
    assert [(r.page_id, r.refers_to) for r in pages if r.record_type == "revisit"] == [(8, 9)]


def test_empty_table(spark, tmp):
    table = spark.createDataFrame([], SCHEMA)
    warc.write_archives(spark, table, f"{tmp}/w")
    assert warc.resolve(spark, warc.read_pages(spark, f"{tmp}/w")).count() == 0


def record(kind, block, **fields):
    head = "".join(f"WARC-{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_reads_foreign_archives_and_reports_damage(spark, tmp):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"5;x=y\r\nhello\r\n3\r\n wo\r\n0\r\nTrailer: t\r\n\r\n"
    plain = b"HTTP/1.0 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    seg = [record("response", http[:20], Record_ID="<r>", Page_ID=2, Segment_Number=1)]
    seg += [record("continuation", http[40:], Record_ID="<c>", Segment_Origin_ID="<r>", Segment_Number=3, Segment_Total_Length=len(http))]
    seg += [record("continuation", http[20:40], Record_ID="<b>", Segment_Origin_ID="<r>", Segment_Number=2)]
    missing = [record("response", http[:20], Record_ID="<m>", Page_ID=3, Segment_Number=1), record("continuation", http[30:], Segment_Origin_ID="<m>", Segment_Number=3, Segment_Total_Length=len(http))]
    wrong = [record("response", http, Record_ID="<w>", Page_ID=4, Segment_Number=1, Segment_Total_Length=5)]
    cut = record("response", plain, Record_ID="<k>", Page_ID=5)[:-12]
    one = [record("warcinfo", b"x"), record("response", plain, Record_ID="<p>", Page_ID=1, Payload_Digest="sha1:AAAA"), record("response", plain, Record_ID="<q>", Page_ID=6)]
    os.makedirs(f"{tmp}/w")
    for k, part in enumerate(([*one, *seg[::-1]], missing, wrong, [cut], [b"nonsense\r\n"], [record("response", b"no head", Record_ID="<n>", Page_ID=7)])):
        with open(f"{tmp}/w/f{k}.warc.gz", "wb") as f:
            f.write(b"".join(map(gzip.compress, part)) if k % 2 == 0 else b"".join(part))
    got = {r.page_id: r for r in warc.read_pages(spark, f"{tmp}/w").collect()}
    assert bytes(got[2].payload) == b"hello wo" and got[2].problem is None
    assert bytes(got[6].payload) == b"hi"
    assert got[1].problem == "the payload digest differs" and got[1].payload is None
    assert got[3].problem == "a segment is missing" and got[4].problem == "the total length differs"
    assert got[5].problem == "the block breaks off" and got[7].problem == "no end of the HTTP head"
    assert "no record starts" in got[None].problem
