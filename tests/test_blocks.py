import random

import pytest
from pyspark.sql import functions as F

from provenir.functions import text as T
from provenir.operators import blocks as B


def test_csv_quotes_newlines_and_extra_cells():
    assert B.parse_csv('a,b\r\n"x ""y""",2\n"two\nlines",3,4\n') == [["a", "b"], ['x "y"', "2"], ["two\nlines", "3", "4"]]
    with pytest.raises(ValueError):
        B.parse_csv('a,"b\n')
    with pytest.raises(ValueError):
        B.parse_csv("a" * 11, max_cell=10)


def test_plain_split_offsets_and_cuts():
    r = random.Random(5)
    text = " ".join("word" * r.randint(1, 3) + r.choice(["", ".", ";", ".\n\n"]) for _ in range(900)).strip()
    pieces = list(B.split_plain(text))
    assert all(text[a:b] == t and len(t) <= 1200 for t, a, b in pieces)
    assert "".join(t for t, _, _ in pieces).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_note_blocks_keep_offsets_and_headings():
    note = "---\na: 1\n---\n### Deep\n\nfirst para\n\nsecond para\n\n## Next\nbody right below\n\n" + "x. " * 700
    got = list(B.note_blocks_of(note))
    assert all(note[a:b] == t for t, a, b, _ in got)
    assert got[0][0] == "first para\n\nsecond para" and got[0][3] == ["Deep"]
    assert got[1][3] == ["Deep", "Next"]  # a level-2 heading keeps the one heading before it
    assert all(len(t) <= 900 for t, *_ in got)
    assert [b[0] for b in B.note_blocks_of("# Only")] == ["# Only"] and not list(B.note_blocks_of("---\na: 1\n---\n  "))
    with pytest.raises(ValueError):
        list(B.note_blocks_of("x", limit=50))


def test_html_scripts_nesting_and_double_escapes(spark):
    html = '<script>var t="</p>";</script><h1>T</h1><p>a&amp;lt;b</p><li><p>in</p></li><h3>S</h3><td> c </td><p> </p><h2>U</h2><th>h</th>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    s = B.html_sections(df, "id", F.col("html"))
    assert [(r.tag, r.text) for r in s.orderBy("n").collect()] == [("h1", "T"), ("p", "a<b"), ("li", "in"), ("h3", "S"), ("td", "c"), ("h2", "U"), ("th", "h")]
    paths = {r.section: r.path for r in B.heading_paths(s, "id").collect()}
    assert paths == {"p-2": "T", "li-3": "T", "td-5": "T > S", "th-7": "T > U"}


def test_quarantine_and_containment(spark):
    df = spark.createDataFrame([("d", "a" * 10), ("e", "b" * 2000)], "doc string, text string")
    good, bad = B.quarantine(df, "doc")
    assert [r.doc for r in good.collect()] == ["d"] and bad.first().reason == "a block is too long"
    rows = spark.createDataFrame([("d", 2, "s", "", "1"), ("d", 0, None, "H > I", "2"), ("d", None, None, None, "3")], "doc string, page int, section string, path string, block_id string")
    nodes, edges = B.containment(rows, "doc")
    assert {(r.source, r.target) for r in edges.collect()} == {("document:d", "document:d:page:2"), ("document:d:page:2", "block:1"), ("document:d", "document:d:section:H > I"), ("document:d:section:H > I", "block:2"), ("document:d", "block:3")}
    assert nodes.count() == 6


def test_properties_are_typed_and_the_last_stands(spark):
    md = "---\na: true\nb: -1.5\nc: [x, 'y', ]\nd: \"q\"\na: no\n---\ntext #t [[L#h|al]] #t"
    df = spark.createDataFrame([(md,), (None,), ("",)], "m string")
    got = df.select(T.properties(F.col("m")).alias("p"), T.links(F.col("m")).alias("l"), T.tags(F.col("m")).alias("t")).first()
    assert [(p.key, p.value.kind, p.value.text) for p in got.p] == [("b", "n", "-1.5"), ("c", "list", "x, y"), ("d", "s", "q"), ("a", "s", "no")]
    assert [tuple(x) for x in got.l] == [("L", "h", "al")] and got.t == ["t"]


def test_link_rename_is_literal_and_keeps_case_of_the_rest(spark):
    df = spark.createDataFrame([("[[A.b]] [[a.B|x]] [[A.b#h]] [[Axb]] [[A.bc]]",)], "m string")
    assert df.select(T.rename_links(F.col("m"), F.lit("A.b"), F.lit("N$1"))).first()[0] == "[[N$1]] [[N$1|x]] [[N$1#h]] [[Axb]] [[A.bc]]"


def test_time_phrases(spark):
    qs = ["between 2005 and 2001", "from 1999 through 2003", "before 2000", "since 2010", "after 2010", "in 2024", "in 24", "xbetween 2001 and 2002"]
    rows = spark.createDataFrame([(q,) for q in qs], "q string").select(T.temporal_constraint(F.col("q")).alias("t")).collect()
    assert [(r.t.from_year, r.t.to_year) if r.t else None for r in rows] == [(2001, 2005), (1999, 2003), (None, 1999), (2010, None), (2010, None), (2024, 2024), None, None]
