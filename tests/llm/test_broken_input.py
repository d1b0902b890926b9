"""Broken markup takes time in proportion to its length; a text too long to learn from is passed over."""

import time

import pytest

from tracewright.llm import html, quality


@pytest.mark.parametrize(
    "source",
    ["<a " * 350_000, '<a "' * 250_000, "<b>" * 40_000 + "</p>" * 40_000, "<header>" * 20_000, "<!x" * 300_000, "<p><div>" + "<b>" * 40_000 + "<p>" * 40_000, "<ul>" + "<b>" * 40_000 + "<li>x" * 40_000, "</div>" * 150_000],
    ids=["open tags", "open quotes", "stray ends", "headers", "declarations", "paragraphs", "items", "ends"],
)
def test_broken_markup_is_parsed_in_linear_time(source):
    began = time.time()
    html.Page(source).text()
    assert time.time() - began < 5


def test_ends_and_bounds():
    text = lambda s: html.Page(s).text()
    assert text("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>") == "a b c d e"
    assert text("<p>a<div>b</p>c</div>") == "a bc" and text("<table><tr><td>a<td>b<tr><td>c</table>d") == "a b c d"
    assert text("<p title='x > y' data=\"<b>\">a<br>b</p></i>c") == "a b c"
    assert text("<dl><dt>a<dd>b<dt>c</dl>") == "a b c" and text("<article><header>a</header>b</article><header>c</header>") == "a b"


def test_one_long_text_leaves_the_others(spark):
    words = {0: "bad spam junk noise ", 1: "good clear fine prose "}
    rows = [(i, words[i % 2] * 5) for i in range(200)] + [(10**6 + i, "long " * 4000) for i in range(3)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    weights, bias = quality.train(documents, labels, most=18_000)
    scored = {r.doc_id: r.s for r in quality.score(documents, (weights, bias), "s").collect()}
    assert all((scored[i] > 0.5) == bool(i % 2) for i in range(200)) and (weights != 0).any()
    nothing, zero = quality.train(documents, labels, most=10)
    assert not nothing.any() and zero == 0
