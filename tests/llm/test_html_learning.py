"""What the page model learns, and the registered query against marked pages."""

from __future__ import annotations

import os
import re

import pytest

from carbonsplit.llm import html_text
from carbonsplit.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
LONG = "This is a long paragraph about many things, and it goes on so that nobody doubts that it is the text of the page. " * 2

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}


@pytest.fixture(scope="module")
def model(pages):
    return html_text.train(list(pages.values())[:100], rounds=20)


def marked_text(html):
    """Text of a page by the marks alone."""
    page = html_text.parsed(html)
    return html_text.text_of(page, [bool(x) for x in html_text.labels_of(page)])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article class="post has-sidebar"><p>one two three</p></article>', "one two three"),
        ('<article class="post no-comments"><p>one two</p></article>', "one two"),
        ('<article><div class="top-story"><p>one</p></div></article>', "one"),
        ('<article><p>one</p><p class="more">two</p></article>', "one\ntwo"),
        ('<article><p>one</p><div class="bottom-line">two</div></article>', "one\ntwo"),
        (f'<body><ul class="links"><li><a href="#">A</a></li><li><a href="#">B</a></li></ul><div class="wrap"><p>{LONG}</p><p>{LONG}</p></div></body>', f"{LONG}\n{LONG}".replace(" \n", "\n").strip()),
        (f'<article><h1>T</h1><p>one</p><aside><p>{LONG}</p></aside><div class="comments"><p>{LONG}</p></div><div class="advert"><p>{LONG}</p></div></article>', "T\none"),
        ("<body><header><h1>Site</h1></header><main><h1>T</h1><p>one</p><form>f</form></main><footer>foot</footer></body>", "T\none"),
    ],
)
def test_names_that_are_no_parts(model, html, text):
    assert html_text.extract(html, model) == text


def test_learning_helps_on_pages_held_out(model, pages):
    untrained = html_text.Model(dict(html_text.PRIOR), html_text.PRIOR_EDGES.copy())
    assert max(map(abs, html_text.PRIOR.values())) <= 3
    varied = [v for n, html in enumerate(list(pages.values())[100:]) if (v := html_text.varied(html, 5000 + n))]
    bare = [re.sub(' data-label="[01]"', "", v) for v in varied]
    right = [sum(html_text.extract(b, m) == marked_text(v) for b, v in zip(bare, varied, strict=True)) / len(varied) for m in (model, untrained)]
    assert right[0] >= 0.9 and right[0] >= right[1] + 0.1, right


def test_registered_query(spark, pages):
    want = {}
    for page_id, html in pages.items():
        found = html_text.labelled(html or "") or ""
        inside = re.sub(r'<(div class="ad"|aside|nav|form|footer|header|section class="comments")', r'<\1 data-label="0"', found)
        want[page_id] = marked_text(inside)
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op2_html_extraction"](spark, FOLDER).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
