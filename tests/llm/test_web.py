"""HTML extraction and URL filters."""

from html import parser as html_parser

import duckdb
import pandas as pd
import pytest

from pagewright.llm import html, urls

P = "<p>Here is a paragraph, with commas, and enough words that it counts as text of the article itself.</p>"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>", ""), ("<p>open <b>bold", "open bold"), ("<!-- x", ""), ("<script>x", ""), ("a &lt;b&gt; &amp;amp; &#233;", "a <b> &amp; é"), ("1 < 2 <3", "1 < 2 <3"),
    (f"<nav><a href='/'>Home</a></nav><article><h1>T</h1>{P}<p>Of.</p><section class='comments'><p>first, nice, post</p></section></article><footer>(c)</footer>", f"T\n{P[3:-4]}\nOf."),
    (f"<div id='menu'>x</div><div class='content'><h2>A &amp; b</h2>{P}<div class='ad'>Buy</div><ul><li>one<li>two</ul><form>mail</form></div><div class='sidebar'>{P}</div>", f"A & b\n{P[3:-4]}\none\ntwo"),
    (f"<main><p>a<br>b&nbsp;c</p>{P}<aside>no</aside><div style='display:none'>no</div><style>p{{}}</style></main>", f"a b c\n{P[3:-4]}"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


ARTICLE = "\n".join([P[3:-4]] * 4)
SMALL = "<p>Post, nice.</p>"


@pytest.mark.parametrize(("page", "text"), [
    *((f"<nav>x</nav><div {mark}>{P * 4}</div><div class='sidebar'>{SMALL}</div>", ARTICLE) for mark in ("class='content no-sidebar'", "class='layout has-sidebar'", "id='page-search'", "class='post share-enabled'", "class='with-ads'", "class='social'")),
    (f"<div class='layout sidebar-right'><div class='story'>{P * 4}</div><div class='sidebar'>{P * 2}</div></div>", ARTICLE),
    (f"<div class='content no-sidebar'><div>{P * 4}</div><div class='post-comments'>{P * 9}</div></div>", ARTICLE),  # threads go, long as they are
    (f"<div>{P * 4}</div><div id='comments'>{P * 60}</div>", ARTICLE),
    (f"<article>{P * 2}<p class='share-price'>Ten, up.</p><div class='legal-history'>Old law.</div>{P * 2}</article>", f"{P[3:-4]}\n{P[3:-4]}\nTen, up.\nOld law.\n{P[3:-4]}\n{P[3:-4]}"),
    (f"<div class='layout has-sidebar'><article>{P * 4}</article></div>", ARTICLE),
    (f"<article><p title=it's>{P[3:]}<p data-x=\"a>b\" title='>'>{P[3:]}<p a='>{P[3:-4]}'>{P[3:]}{P}</article>", ARTICLE),
    *((f"<{tag}>{P * 4}<div>{''.join(f'<a href=/{i}>Teaser number {i}</a> ' for i in range(20))}</div></{tag}>", ARTICLE) for tag in ("main", "div", "article")),
    (f"<article>{P * 4}<p>See <a href='/'>this long text behind a link</a></p><h2><a href='/'>A title</a></h2></article>", f"{ARTICLE}\nSee this long text behind a link\nA title"),
    (f"<noscript><article>{P * 4}</article>", ARTICLE), (f"<template>{P * 4}", ARTICLE),
    (f"<article>{P}{P}<div class='share-buttons'>tell all</div><div class=\"ad-box ad_left\">buy</div>{P * 2}<div class='sidebar widget'><p>no</p></div></article>", ARTICLE),
    (f"<div id='comment-form'>x</div><section class='post-content'>{P * 4}</section>", ARTICLE),
    ("<div class='popup'>only this</div>", "only this"), ("<span class='ad'>or <b>this</b></span>", "or this"),
    (f"<div id='all'><div>{P * 4}</div><div>The end.</div><section>Or so.</section><div><a href='/'>More</a> of it</div></div>", f"{ARTICLE}\nThe end.\nOr so."),
])
def test_main_text_keeps_what_the_class_rule_would_lose(page, text):
    assert html.main_text(page) == text


class Brute(html_parser.HTMLParser):
    """The text of a page's only article, by the standard library's parser, event by event."""

    BLOCKS = {"article", "h1", "p", "div", "ul", "li", "br"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.out = 0, 0, [""]
        self.feed(page)
        self.close()
        self.text = "\n".join(x for x in (" ".join(x.split()) for x in self.out) if x)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.out[-1] += " "
        elif tag in self.BLOCKS:
            self.out.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.BLOCKS:
            self.out.append("")

    def handle_data(self, data):
        if self.inside:
            self.out[-1] += data


def test_all_pages_against_a_plain_parser(spark):
    """Every page of the table has one article, so its text is what the standard parser finds there."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: Brute(r["html"] or "").text for r in pages.collect()}
    got = html.op1_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want) and not [r["page_id"] for r in got if r["text"] != want[r["page_id"]] or r["n_chars"] != len(r["text"])]


def test_deep_and_long_pages():
    for page in ("<div>" * 20000 + "x" + "</b></p></i>" * 20000, "<article>" + "<div>" * 5000 + "<li>y" * 5000, "<p " + "a=\"b' " * 50000 + ">x", "<p " + "x='" * 50001 + ">"):
        html.main_text(page)
    assert html.main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(html.main_text("<article>" + P * 5000 + "</article>").split("\n")) == 5000


def test_extract(spark):
    rows = [(1, "u", f"<article>{P}</article>", "t"), (None, None, None, "t"), (1, "u", f"<article>{P}</article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html.extract(spark, df).collect(), key=str)
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(1, len(P) - 7), (1, len(P) - 7), (None, 0)]
    assert html.extract(spark, df.limit(0)).count() == 0


URLS = [None, "", "x", "http://", "http://Example.ORG/es/1", "https://a.b.example.org/en/123?x", "http://badexample.org/es/", "ftp://org/", "http://org", "http://a.com/fr/x#y", "http://a.com/de/", "http://a.com/frx",
        "http://casino.net/", "http://x.net/my-Casino", "http://É.com/FR/", "://com/de/", "http://a//b://c", "http://u@example.org:80/es/", "http://x.org?q=/", "http://x.org#/", "http://a.com\n/de/x", "mailto:a@b.org", "http://a.com/" + "y" * 50000]


def test_urls_match_sql(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(URLS)), "url": URLS}))
    got = sorted(map(tuple, urls.judge(df).collect()), key=str)
    assert got == sorted(con.sql(urls.oracle_sql()).fetchall(), key=str)
    assert urls.judge(df.limit(0)).count() == 0


def test_index_uses_the_rarest_token():
    found = urls.index([urls.host_rule("block", "a.example.org", "/x/"), urls.host_rule("allow", "b.example.org", "/"), urls.word_rule("block", "casino")])
    assert set(found) == {"a", "b", "casino"} or set(found) == {"x", "b", "casino"}
    with pytest.raises(ValueError):
        urls.index([urls.Rule("block", None, ".*", ())])
