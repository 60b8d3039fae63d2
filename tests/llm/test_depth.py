"""Main text doesn't change with the depth of a page."""

import time

import pytest

from lodestone.llm import main_text


def page(depth: int) -> str:
    return "<html><body>" + "<div>" * depth + '<p>text body here and more of it</p><div class="related"><a href="a">link one</a><a href="b">link two</a></div>' + "</div>" * depth + "</body></html>"


@pytest.mark.parametrize("depth", [0, 10, 511, 512, 513, 5000])
def test_depth(depth):
    assert main_text.main_text(page(depth)) == "text body here and more of it"


def test_implied_ends_below_many_elements():
    deep = "<b>" * 600
    assert main_text.main_text(f"<div>{deep}<p>one<p>two<ul><li>three<li>four</ul></div>") == "one two three four"


def test_depth_is_not_quadratic():
    began = time.process_time()
    for source in (page(50_000), "<div><p>" * 30_000, "<b>" * 60_000 + "x", "<li>" * 30_000 + "</p>" * 30_000):
        main_text.main_text(source)
    assert time.process_time() - began < 30
