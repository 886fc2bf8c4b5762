"""Sections of a document tree: random trees written out, and the implied ends of the HTML standard."""

import html
import random

import pytest
from pyspark.sql import functions as F

from provenir.operators.dom import REMOVED, SECTIONS, dom_sections, parse


def tree(r, depth):
    """An element as (tag, children), children texts or elements, nested only where HTML allows it without an implied end."""
    inside = {"ul": ["li"], "table": ["tr"], "tr": ["td", "th"], "p": ["b", "i"], "h2": ["b"], "b": ["i"], "i": [], "script": []}
    tag = r.choice(["div", "section", "ul", "table", "p", "h2", "script"])

    def grow(tag, depth):
        if tag == "script":
            return tag, ["if (a < b) '</p><p>'"]
        allowed = inside.get(tag, ["div", "p", "ul", "table", "h2", "b", "script"])
        children = []
        for _ in range(r.randrange(1, 4) if depth else 0):
            children.append(grow(r.choice(allowed), depth - 1) if allowed and r.random() < 0.7 else ("" if tag in ("table", "tr", "ul") else r.choice(["a & b ", "  ", "1 < 2", "é "])))
        return tag, children

    return grow(tag, depth)


def written(node):
    if isinstance(node, str):
        return html.escape(node)
    tag, children = node
    inner = "".join(children) if tag in REMOVED else "".join(written(c) for c in children)
    return f"<{tag} class='x>y'>{inner}</{tag}>"


def text(node):
    return node if isinstance(node, str) else "" if node[0] in REMOVED else "".join(text(c) for c in node[1])


def sections(node):
    if isinstance(node, str) or node[0] in REMOVED:
        return []
    return ([(node[0], text(node))] if node[0] in SECTIONS else []) + [s for c in node[1] for s in sections(c)]


def test_written_trees_come_back():
    r = random.Random(3)
    for _ in range(400):
        node = ("body", [tree(r, 5) for _ in range(3)])
        assert parse("<!DOCTYPE html><!-- <p>no</p> -->" + written(node)) == sections(node), written(node)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<ul><li>a<p>b</p></li></ul>", [("li", "ab"), ("p", "b")]),
        ("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>", [("li", "abcd"), ("li", "b"), ("li", "c"), ("li", "e")]),
        ("<p>a<div>b</div>c</p>", [("p", "a"), ("p", "")]),
        ("<p>a<p>b<b>c<p>d</b>e", [("p", "a"), ("p", "bc"), ("p", "de")]),
        ("<table><tr><td>a<td><p>b<tr><th>c</table>d", [("td", "a"), ("td", "b"), ("p", "b"), ("th", "c")]),
        ("<td>x<table><tr><td>y</td></tr></table>z</td>", [("td", "xyz"), ("td", "y")]),
        ("<h1>a<h2>b</h1>c<P/>d", [("h1", "a"), ("h2", "b"), ("p", "d")]),
        ("<p>&amp;lt; &eacute;&#39;<script>var t='</p>'</script>x<iframe><p>no</p></iframe>y", [("p", "&lt; é'xy")]),
        ("<object><p>no</object><p>a<br>b<embed>c</p>", [("p", "abc")]),
        ("<p>a < b<p>cut <p", [("p", "a < b"), ("p", "cut ")]),
        ("", []),
        ("plain", []),
    ],
)
def test_ends_that_the_standard_implies(page, want):
    assert parse(page) == want


def test_numbers_count_empty_nodes_and_too_many_are_refused(spark):
    rows = [(1, "<h1>A</h1><p> </p><li>b \r\nc</li>", "x"), (2, None, "x"), (3, "", "x"), (4, "<p>" * 6, "x"), (5, "<p>" + "w " * 300_000, "x"), (1, "<h1>A</h1>", "x"), (None, "<p>n", "x")]
    got = dom_sections(spark.createDataFrame(rows, "page_id long, html string, tag string"), "page_id", F.col("html"), 5).collect()
    short = sorted([(x.page_id, x.n, x.tag, x.text, x.section) for x in got if x.page_id != 5], key=repr)
    assert short == sorted([(1, 1, "h1", "A", "h1-1"), (1, 3, "li", "b\nc", "li-3"), (1, 1, "h1", "A", "h1-1"), (4, 0, None, None, None), (None, 1, "p", "n", "p-1")], key=repr)
    assert [len(x.text) for x in got if x.page_id == 5] == [599_999]
    assert dom_sections(spark.createDataFrame([], "page_id long, html string"), "page_id", F.col("html")).count() == 0
