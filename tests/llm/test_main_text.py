"""Pages of many templates, under priors and under weights learned from the table's pages."""

import html
import re
import time

import pytest

from textloom.llm import main_text

SF = "/root/testdata/sf0.01"
BODY = "<h1>The title</h1><p>See <a href='/x'>the linked words</a> here now.</p><ul><li>first item text</li><li><a href=/y>second item</a></li></ul><p>The last paragraph ends it well.</p>"
TEXT = "The title See the linked words here now. first item text second item The last paragraph ends it well."
AROUND = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>{}<footer>All rights reserved by nobody at all</footer>"


@pytest.fixture(scope="module")
def learned(spark):
    return main_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))


WRAPS = [
    "<article>{}</article>",
    "<main>{}</main>",
    '<main class="has-sidebar">{}</main>',
    '<article class="post comments-open">{}</article>',
    '<article><div class="legal">{}</div></article>',
    '<div class="content has-sidebar">{}</div>',
    '<div class="menu-closed"><article>{}</article></div>',
    '<div class="ad-free-reading">{}</div>',
    '<div class="right-sidebar"><div class="post-content">{}</div></div>',
    '<div class="right-sidebar"><article>{}</article><div class="sidebar">Other things to read here</div></div>',
    '<form id="aspnetForm"><div class="entry-content">{}</div></form>',
    '<div class="ad">Buy this now<article>{}</article>',
    '<div class="sidebar"><article><p>A teaser of another page</p></article></div><article>{}</article>',
    "<article>{}<section id=comments><article class=comment><p>What a fine text, I read all of it twice.</p></article></section></article>",
    '<article><header class="entry-header"></header>{}<footer>Posted in news</footer></article>',
]


@pytest.mark.parametrize("wrap", WRAPS)
def test_templates(wrap, learned):
    for body in ("", ' class="single right-sidebar"', ' class="menu-closed ad-free-reading"'):
        page = f"<html><head><title>T</title></head><body{body}>" + AROUND.format(wrap.format(BODY)) + "</body></html>"
        for weights in (main_text.Weights(), learned):
            assert main_text.main_text(page, weights) == TEXT


def test_article_and_place_are_not_one_feature(spark, learned):
    """With the mark renamed, the learned weights find the same text by its places."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        gold = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])).split())
        for tag in ("div", "section"):
            assert main_text.main_text(r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>"), learned) == gold
    assert not any("article" in k or "main" in k.split() for k in learned.places)


def test_learned_class_names(spark):
    page = '<body><div class="zq7">Wonderful offers of the week for all readers</div><article><p>Words of the article number {}</p></article></body>'
    pages = spark.createDataFrame([(i, "u", page.format(i)) for i in range(40)], "page_id long, url string, html string")
    weights = main_text.learn(pages)
    assert weights.places["class zq7"] <= -3
    assert main_text.main_text("<div class=zq7>Wonderful offers of the week</div><div><p>Some words that are the text</p></div>", weights) == "Some words that are the text"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>", "Let x=2 hold."),
        ("<article><p>a <b and c here</p><p>more</p></article>", "a <b and c here more"),
        ("<article><p title=it's>kept words</p><p>and 'these' too</p></article>", "kept words and 'these' too"),
        ('<article><a title="<b>bold</b>" href="x">link</a> text</article>', "link text"),
        ('<article><p class="x>kept</p><p class="y">also</p></article>', "kept also"),
        ("<article>1 < 2 &amp; 3 > 2</article>", "1 < 2 & 3 > 2"),
        ("<article><p>one<script>var a = '<p>no</p>';</script> two<style>p{}</style></p><textarea>no</textarea></article>", "one two"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
        ("<article><p>one<div class=ad>Buy " + "this " * 500 + "</div><p>two</article>", "one two"),
        ("<p>no mark here at all</p><div class=comments><p>nice post</p></div>", "no mark here at all"),
        ("<article><p>end of page<p", "end of page"),
        ("<div class=comments><p>only a comment</p></div>", ""),
        ("<nav>only menu</nav>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_details(page, text):
    assert main_text.main_text(page, main_text.Weights()) == text


@pytest.mark.parametrize("tags", ["<div>", "<b>", "<div class=sidebar>", "<li><b>", "<b><p>", "<td><b>", "<ul><li>"])
def test_depth_is_linear(tags):
    began = time.perf_counter()
    for page in (tags * 20_000 + "text", "<article><p>" + "<b>" * 20_000 + "<li>x</li>" * 20_000, tags * 10_000 + "text" + "</i></div>" * 10_000):
        main_text.main_text(page, main_text.Weights())
    assert time.perf_counter() - began < 4


def test_huge_page():
    words = "word " * 400_000
    assert main_text.main_text(f"<article><p>{words}</article>", main_text.Weights()) == words.strip()


@pytest.mark.parametrize(
    ("name", "kind"),
    [("sidebar", ".sidebar"), ("site-footer", ".footer"), ("ad-box", ".ad"), ("commentList", ".comment"), ("has-sidebar", ""), ("comments-open", ""), ("ad-hoc", ""), ("search-results", ""), ("post-content", "content"), ("post-comments", ".comments"), ("entry-header", ""), ("cookie_notice", ".notice"), ("wrap", "")],
)
def test_class_names_as_a_whole(name, kind):
    assert main_text.class_kind(name) == kind
