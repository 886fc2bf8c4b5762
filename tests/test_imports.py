"""Import of files by bytes, and what is refused."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from provenir.operators import blocks as B
from provenir.operators import imports as I

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(parts)}</w:body></w:document>")
    return out.getvalue()


def para(text, style=None):
    pr = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{pr}<w:r><w:t>{text}</w:t></w:r></w:p>"


FILES = {
    "a.txt": b"\xef\xbb\xbfPlain words.\r\nNext line \xff",
    "copy-of-a.txt": b"\xef\xbb\xbfPlain words.\r\nNext line \xff",
    "b.csv": b'name,,note\n"Ann ""A""",1,"two\nlines"\n , ,\nBob,2\nCid,3,x,extra\n',
    "c.html": b"<h1>Top</h1><p>One &amp; two</p><h3>Deep</h3><td>cell</td><script>no</script>",
    "bare.htm": b"<div>just text</div>",
    "d.docx": docx(para("Title", "Heading1"), para("Body &amp; more"), f"<w:tbl><w:tr><w:tc>{para('x')}</w:tc><w:tc>{para('y')}</w:tc></w:tr></w:tbl>"),
    "bad.docx": b"not a zip",
    "open.csv": b'a,b\n"never closed',
    "wide.csv": b"a\n" + b"y" * 64_001 + b"\n",
    "long.csv": b"a\n" + b"z" * 1_500 + b"\n",
    "e.pdf": b"%PDF",
    "f.bin": b"?",
}


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (folder / name).write_bytes(content)
    i = I.import_files(I.read_files(spark, f"file://{folder}"))
    names = {r.doc_id: r.name for r in i.documents.collect()}
    blocks = {}
    for r in i.blocks.collect():
        blocks.setdefault(names.get(r.doc_id, "?"), []).append((r.section or r.row or r.start, r.path, r.text))
    return names, {k: sorted(v, key=repr) for k, v in blocks.items()}, {r.name: r.reason for r in i.refused.collect()}


def test_blocks_of_each_format(got):
    names, blocks, _ = got
    assert sorted(names.values()) == ["a.txt", "b.csv", "bare.htm", "c.html", "d.docx"] and "?" not in blocks
    assert blocks["a.txt"] == [(0, "", "Plain words.\nNext line �")]
    assert blocks["b.csv"] == [(2, "CSV row", 'name: Ann "A"\ncolumn_2: 1\nnote: two\nlines'), (4, "CSV row", "name: Bob\ncolumn_2: 2\nnote: "), (5, "CSV row", "name: Cid\ncolumn_2: 3\nnote: x")]
    assert blocks["c.html"] == [("p-2", "Top", "One & two"), ("table-td-4", "Top > Deep", "cell")]
    assert blocks["bare.htm"] == [(0, "", "just text")]
    assert blocks["d.docx"] == [("p-2", "Title", "Body & more"), ("table-td-3", "Title", "x"), ("table-td-4", "Title", "y")]


def test_refused_files_leave_no_block(got):
    _, _, refused = got
    assert sorted(refused) == ["bad.docx", "e.pdf", "f.bin", "long.csv", "open.csv", "wide.csv"]
    assert refused["open.csv"] == "a quote is not closed" and refused["long.csv"] == "a block is too long" and "64000" in refused["wide.csv"]


def test_titles_of_text_notes(spark):
    rows = [("x.md", b"intro\n# The Title \ntext"), ("My note.txt", b"## no\n#also no")]
    got = {r.title: r.markdown for r in I.text_notes(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got == {"The Title": "intro\n# The Title\ntext", "My note": "## no\n#also no"}


def test_boxes_of_pdf_items(spark):
    items = [("d", 1, i, s, x, y, w, 10.0) for i, (s, x, y, w) in enumerate([("Hello", 10.0, 700.0, 30.0), ("", 0.0, 0.0, 0.0), ("big", 45.0, 700.0, 20.0), ("world", 10.0, 688.0, 33.0)])]
    frame = spark.createDataFrame(items, "d string, page int, i int, str string, x double, y double, width double, height double")
    assert B.page_texts(frame, "d").first().text == "Hello big world"
    blocks = spark.createDataFrame([("d", 1, 1, 0, 9), ("d", 1, 2, 10, 15), ("d", 1, 3, 40, 50)], "d string, page int, n int, start int, end int")
    got = {r.n: (r.x, r.y, r.width, r.height) for r in B.block_bounds(blocks, B.item_offsets(frame, "d"), "d").collect()}
    assert got == {1: (10.0, 700.0, 55.0, 10.0), 2: (10.0, 688.0, 33.0, 10.0)}


def test_blocks_hold_what_they_say(spark):
    text = "First part. " * 300
    for a, b in B.Cutter(text, B.PLAIN_BOUNDARY, 1200, 661).stretches(0, len(text)):
        assert text[a:b] == text[a:b].strip() and b - a <= 1200
    notes = spark.createDataFrame([("n", "N", "# N\n\n" + text)], "id string, title string, markdown string")
    docs = spark.createDataFrame([("d", "D", text)], "id string, title string, text string")
    rows = B.unified_blocks(notes, docs).collect()
    assert {r.source_type for r in rows} == {"note", "document"} and all((("# N\n\n" + text) if r.source_type == "note" else text.strip())[r.start : r.end] == r.text for r in rows)
    assert not [r for r in rows if r.years]
    assert spark.range(1).select(F.lit(1)).count() == 1
