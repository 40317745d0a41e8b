"""Drawings, formulas and unclosed elements in pages."""

from __future__ import annotations

import pytest

from carbonsplit.llm import html_text

MODEL = html_text.Model(dict(html_text.PRIOR), html_text.PRIOR_EDGES)


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', "one two\nthree"),
        ('<p>one <svg><path d="x"/><g><text>no</text></g></svg> two</p><p>three</p>', "one two\nthree"),
        ("<p>one <svg><svg>no</svg>no</svg> two</p>", "one two"),
        ("<p>one <svg><path></p><p>two</p>", "one\ntwo"),
        ("<p>one <svg><path><p>two", "one\ntwo"),
        ("<p>one <svg><foreignObject><div>no</div></foreignObject></svg> two</p>", "one two"),
        ("<p>one <math/> two</p><p>three</p>", "one two\nthree"),
        ("<p>one <math><mi>x</mi><mo>+</mo><mspace/><mn>2</mn></math> two</p>", "one x+2 two"),
        ("<div>one <select><option>no</div><p>two</p>", "one\ntwo"),
        ("<div>one <object><div>no</div>no</div><p>two</p>", "one\ntwo"),
        ("<div>one <canvas>no</div><p>two</p>", "one\ntwo"),
        ("<div>one <select><option>no</option></select> two</div>", "one two"),
        ("<p>one</p><script>'</article>'</script><p>two</p>", "one\ntwo"),
    ],
)
def test_text_after_and_in_foreign_elements(inner, want):
    assert html_text.extract(f"<body><article>{inner}</article></body>", MODEL) == want
