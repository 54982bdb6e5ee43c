import html
import re
import time

import pytest
from helpers import SMALL, rows_of

from sherdline.llm.html_text import extract_text, main_text

SHELL = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header>"
    '<nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, as all do, and more text here.</p></div>%s'
    '<aside><p>Side text, side text, side text, and more of it here.</p></aside><form><p>Subscribe, please, to our letter.</p><input></form>'
    '<div id="comments"><p>Nice article, thanks, I liked it, very much indeed.</p></div><footer>&copy; foot</footer></body></html>'
)
CASES = [
    ("", ""), (None, ""), ("<p>a", "a"), ("plain  text\n here", "plain text here"), ("<script>x", ""), ("<!-- <p>no</p> -->yes", "yes"), ("a < b", "a < b"), ("<div></div>", ""),
    (SHELL % "<article><h1>T</h1><p>One, two.</p><p>Short</p></article>", "T\nOne, two.\nShort"),
    (SHELL % '<div id="content"><h1>T</h1><p>A first paragraph of some length, with commas, and so on.<p>Next.<ul><li>one<li>two</ul></div>', "T\nA first paragraph of some length, with commas, and so on.\nNext.\none\ntwo"),
    (SHELL % "<main><section><p>One one one one one, two two.</p></section><section><p>Three</p></section></main>", "One one one one one, two two.\nThree"),
    (SHELL % "<article><p>x &amp; y &lt;b&gt; &#233;&nbsp;z</p><p><b>bold<br>line</b></p><pre>a\n  b</pre></article>", "x & y <b> é z\nbold\nline\na b"),
    (SHELL % "<article><p>Main, text, of the page, is this one here.</p><div class='ad'>Buy!</div><section class='comments'><article><p>long, comment, text</p></article></section></article>", "Main, text, of the page, is this one here."),
    (SHELL % "<article><p title='a>b' class=x>ok <a href='y'>link</a> end</p><p>un<i>closed <p>next</article>", "ok link end\nunclosed\nnext"),
    (SHELL % "<article><table><tr><td>c1<td>c2<tr><td>d1</table><blockquote>q</blockquote></article>", "c1\nc2\nd1\nq"),
]


TEXT = "One paragraph of the article, with commas, and of some length, as they are. " * 4
WRAPPED = [
    '<div class="content has-sidebar">%s</div>', '<div id="post" class="with-share">%s</div>', '<div class="main-header-layout">%s</div>',
    '<section class="social-studies">%s</section>', "<form action=x>%s</form>", '<svg viewBox="0 0 1 1"/>%s', '<div class="no-comments">%s</div>', "<div class=related>%s</div>",
]


@pytest.mark.parametrize("around", WRAPPED)
def test_words_and_forms_around_the_article(around):
    page = SHELL % (around % f"<p>{TEXT}</p><p>{TEXT}</p>")
    assert main_text(page) == f"{TEXT.strip()}\n{TEXT.strip()}"


def test_long_comments_do_not_replace_the_article():
    page = SHELL % (f"<div><p>{TEXT}</p></div>" + "<div class='comments'>" + f"<p>reader, {TEXT}</p>" * 9 + "</div>")
    assert main_text(page) == TEXT.strip()
    assert "reader" in main_text(f"<div class='comments'><p>reader, {TEXT}</p></div>")  # nothing else is left


@pytest.mark.parametrize("page", [
    "<div>some text" * 50_000, "<div " * 200_000, '<a x="' * 200_000, "<head>" * 50_000 + ">", "<div>" * 20_000 + "<option>x" * 20_000,
    "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<ul><li>" * 50_000, "<span>x" * 50_000 + "<p>a</p>" * 20_000,
])
def test_long_malformed_pages_are_read_once(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 8


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert main_text(page) == text


def test_supplied_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    expected = []
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body))
        text = "\n".join(b for b in blocks if b)
        expected.append((r.page_id, r.url, text, len(text)))
    assert rows_of(extract_text(pages), "page_id", "url", "text", "n_chars") == sorted(expected, key=repr)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = "<article><p>Some text.</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, None, None), (3, "v", ""), (4, "w", "<p>word " * 20_000), (5, "x", "<div>" * 3000 + "deep"), (6, "y", "<" * 50_000)]
    found = rows_of(extract_text(spark.createDataFrame([(*r, "a", "b") for r in rows], schema)), "page_id", "text", "n_chars")
    texts = {1: "Some text.", None: "Some text.", 2: "", 3: "", 4: "\n".join(["word"] * 20_000), 5: "deep", 6: "<" * 50_000}
    assert found == sorted(((i, texts[i], len(texts[i])) for i, _, _ in rows), key=repr)
    assert extract_text(spark.createDataFrame([], schema)).collect() == []
