"""Sections of HTML as a document tree has them: nested ones each give their whole text, and empty ones count."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import normalize_lines

# The sections, what is taken out, and the most nodes of a page.
SECTIONS = frozenset("h1 h2 h3 h4 h5 h6 p li td th".split())
REMOVED = frozenset("script style iframe object embed".split())
MAX_NODES = 100_000
# Fixed values of the HTML standard: what ends an open paragraph, and what no implied end reaches through.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
BOUNDARY = frozenset("table td th caption button marquee template html".split())
LISTS = frozenset("ul ol menu dir".split())
VOID = frozenset("embed hr".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TRACKED = ENDS_PARAGRAPH | BOUNDARY | LISTS | TABLE | REMOVED


class _Tree(HTMLParser):
    """Open elements and the stretch of text that each section holds. Inline elements neither open nor close one, so they aren't kept."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.nodes: list[list] = []  # tag, first and last piece of text
        self.pieces: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in TRACKED:
            return
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, BOUNDARY)
        if tag == "li":
            self._end({"li"}, LISTS | BOUNDARY)
        elif tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self._pop(len(self.open) - 1)
        elif tag in ("td", "th"):
            self._end({"td", "th", "caption"}, {"table"})
        elif tag == "tr":
            self._end({"tr", "caption"}, {"table"})
        elif tag in ("thead", "tbody", "tfoot"):
            self._end({"thead", "tbody", "tfoot", "caption"}, {"table"})
        if tag not in VOID:
            self._push(tag)

    handle_startendtag = handle_starttag  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag not in TRACKED or tag in VOID:
            return
        through = {"table"} - {tag} if tag in TABLE else BOUNDARY - {tag}
        ended = self._end(HEADINGS if tag in HEADINGS else {tag}, through | (LISTS if tag == "li" else set()))
        if not ended and tag == "p" and not self.hidden:
            self._push("p")
            self._pop(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)

    def _push(self, tag: str) -> None:
        at = -1
        if tag in REMOVED:
            self.hidden += 1
        elif tag in SECTIONS and not self.hidden:
            at = len(self.nodes)
            self.nodes.append([tag, len(self.pieces), None])
        self.open.append((tag, at))

    def _end(self, tags: set[str] | frozenset[str], through: set[str] | frozenset[str]) -> bool:
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in tags:
                self._pop(i)
                return True
            if name in through or name in REMOVED:
                return False
        return False

    def _pop(self, keep: int) -> None:
        while len(self.open) > keep:
            tag, at = self.open.pop()
            self.hidden -= tag in REMOVED
            if at >= 0:
                self.nodes[at][2] = len(self.pieces)


def parse(html: str) -> list[tuple[str, str]]:
    """Tag and text of a page's sections in the order in which they open; a tag that the page's end cuts off isn't one."""
    tree = _Tree()
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and html[cut + 1 : cut + 2].isalpha() | html.startswith(("</", "<!", "<?"), cut):
        html = html[:cut]
    tree.feed(html)
    tree.close()
    tree._pop(0)
    return [(tag, "".join(tree.pieces[a:b])) for tag, a, b in tree.nodes]


def _sections(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, html in enumerate(batch.column(1)):
            found = parse(html.as_py() or "")
            rows = [(0, None, None)] if len(found) > most else [(n + 1, *x) for n, x in enumerate(found)]
            if rows:
                columns = [batch.column(0).take(pa.array([i] * len(rows)))] + [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["ident", "n", "tag", "text"])


def dom_sections(pages: DataFrame, ident: str, html: Column, most: int = MAX_NODES) -> DataFrame:
    """ident, n, tag, text, section: headings, paragraphs, items and cells of each page's tree with the whole text inside them, so a paragraph in an item is given twice.

    n counts all of them from 1; those without text count but aren't given. Open paragraphs, items, rows and cells end where the next one implies it; scripts, styles, frames and objects
    are taken out with all that is in them. A page with more than ``most`` sections is refused: it gives one row, with n 0 and neither tag nor text. A null or empty page gives none.
    """
    rows = pages.select(F.col(ident).alias("ident"), html.alias("html"))
    schema = StructType([rows.schema["ident"], StructField("n", LongType()), StructField("tag", StringType()), StructField("text", StringType())])
    found = rows.mapInArrow(lambda it: _sections(it, most), schema).withColumn("text", normalize_lines(F.col("text")))
    return found.where("n = 0 or text <> ''").select(F.col("ident").alias(ident), "n", "tag", "text", F.concat("tag", F.lit("-"), "n").alias("section"))
