"""Features of main text do not depend on how long a page is, and formulas stay."""

from __future__ import annotations

import pytest

from usagelens.llm import html_text


@pytest.mark.parametrize("siblings", [3, 198, 199, 200, 500])
def test_siblings_of_a_tag(siblings):
    nodes = html_text.listed(html_text.parse("<main>" + "<p>some text</p>" * siblings + "<nav>links</nav></main>"))
    alike = {n.tag: html_text.features(nodes)[n.index, 12] for n in nodes}
    assert (alike["nav"], alike["p"]) == (1, siblings)


def test_formulas_are_not_removed_before_the_trees():
    nodes = html_text.listed(html_text.parse("<p>Let <math><mi>x</mi><mo>=</mo><mn>7</mn></math> be.</p>"))
    text = html_text.kept_text(nodes, [True] * len(nodes))
    assert text.split() == ["Let", "x=7", "be."]


@pytest.mark.parametrize("page", [
    "<b " * 400_000 + "'", "<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
    "<" * 1_000_000, "<a " + "x " * 500_000, '<a x="' * 200_000, "<ul>" * 50_000 + "<li>" * 100_000,
])
def test_odd_pages_are_read_forward_only(page):
    import time

    start = time.time()
    html_text.parse(page)
    assert time.time() - start < 20


def test_a_quote_that_is_never_closed_ends_with_its_tag():
    nodes = html_text.listed(html_text.parse('<p class=main id="x">Hi there <a title="unclosed>link text</a> more</p>'))
    assert nodes[1].tokens == ("main", "x")
    assert html_text.kept_text(nodes, [True] * len(nodes)) == "Hi there link text more"
