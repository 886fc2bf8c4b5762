"""Entity candidates from a language model that the caller provides; none is shipped.

A provider is what ``load()`` returns in each task, once: a function from a list of texts to a list, for each text, of mentions (label, text, score, start, end), start and end in
characters of that text or None. Labels may carry the B- or I- of a tagger, texts the ## of a word piece.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.text import normalize_spaces, slug
from .review import twins

# The types of a tagger's labels, and what counts as a name.
TYPES = {"PER": "person", "PERSON": "person", "ORG": "organization", "ORGANIZATION": "organization", "LOC": "place", "LOCATION": "place", "MISC": "topic"}
WINDOW, OVERLAP = 4000, 200  # characters; a name has 120 at most, so some window holds it away from its cuts
BATCH = 8
SHORTEST, LONGEST = 2, 120
EXTRACTOR = "local-ner:"


class Mention(NamedTuple):
    label: str
    text: str
    score: float
    start: int | None = None
    end: int | None = None


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float
    name: str | None  # where the provider gave no place
    follows: bool  # a piece that may go on from the one before


Provider = Callable[[list[str]], list[list[Mention]]]


def windows(text: str) -> Iterator[tuple[int, str, bool]]:
    """Offset, text and whether it is the last, of the windows of a whole text."""
    at = 0
    while True:
        last = at + WINDOW >= len(text)
        yield at, text[at : at + WINDOW], last
        if last:
            return
        at += WINDOW - OVERLAP


def spans(found: Iterable[Mention], at: int, size: int, last: bool) -> Iterator[Span]:
    """Spans of one window's mentions in its text's characters, without those that touch a cut: the next window has them whole."""
    for m in found:
        label = re.sub("^[BI]-", "", m.label or "", flags=re.IGNORECASE).upper()
        name = re.sub(r"\s+([.,;:!?])", r"\1", re.sub("^##", "", m.text or "")).strip()
        if label not in TYPES or not name:
            continue
        follows = m.label[:2].upper() == "I-" or (m.text or "").startswith("##")
        if m.start is None or m.end is None:
            yield Span(at, at, TYPES[label], float(m.score), name, follows)
        elif not (at and m.start <= 0) and not (not last and m.end >= size):
            yield Span(at + m.start, at + m.end, TYPES[label], float(m.score), None, follows)


def merged(text: str, found: Iterable[Span]) -> Iterator[tuple[str, str, float, int]]:
    """Type, name, score, start: spans of one type that overlap, or of which one goes on from the other, are one, with the best score of them."""
    placed: dict[str, list[Span]] = {}
    for s in found:
        if s.name is not None:
            yield s.kind, s.name, s.score, s.start
        else:
            placed.setdefault(s.kind, []).append(s)
    for kind, rows in placed.items():
        start = end = -1
        best = 0.0
        for s in [*sorted(rows), None]:
            if s is not None and start >= 0 and (s.start < end or (s.follows and (s.start == end or (s.start == end + 1 and text[end].isspace())))):
                end, best = max(end, s.end), max(best, s.score)
                continue
            if start >= 0 and (name := text[start:end].strip()):
                yield kind, name, best, start
            if s is not None:
                start, end, best = s.start, s.end, s.score


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for i, text in enumerate(batch.column("text")):
        if (t := text.as_py()) and t.strip():
            yield i, t


def _extract(batches: Iterable[pa.RecordBatch], load: Callable[[], Provider]) -> Iterator[pa.RecordBatch]:
    provider = None
    for batch in batches:
        provider = provider or load()
        waiting: deque[tuple[int, str, list[Span]]] = deque()  # blocks of which some window is still to be read
        queue: list[tuple[list[Span], int, str, bool]] = []
        rows: list[tuple[int, str, str, float, int]] = []

        def ask(queue=queue) -> None:  # noqa: ANN001
            for (own, at, text, last), found in zip(queue, provider([q[2] for q in queue]), strict=True):
                own.extend(spans(found, at, len(text), last))
            queue.clear()

        def settle(keep: int, rows=rows, waiting=waiting) -> None:  # noqa: ANN001
            while len(waiting) > keep:
                i, text, own = waiting.popleft()
                rows.extend((i, *m) for m in merged(text, own))

        for i, text in _blocks(batch):
            waiting.append((i, text, own := []))
            for at, part, last in windows(text):
                queue.append((own, at, part, last))
                if len(queue) == BATCH:
                    ask()
                    settle(1)
        if queue:
            ask()
        settle(0)
        at = pa.array([r[0] for r in rows], pa.int64())
        columns = [batch.column(c).take(at) for c in ("pos", "block_id")] + [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.string()), (2, pa.string()), (3, pa.float64()), (4, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["pos", "block_id", "type", "name", "score", "start"])


def model_mentions(blocks: DataFrame, load: Callable[[], Provider]) -> DataFrame:
    """pos, block_id, type, name, score, start: what a provider finds in blocks(pos, block_id, text), whole texts in windows that overlap, BATCH of them at a time; other columns are left out.

    A blank or null text has no mentions, and a provider that is asked nothing isn't loaded where a task has no rows. ``start`` is the window's where the provider gives no place.
    """
    rows = blocks.select("pos", "block_id", "text")
    schema = StructType([rows.schema["pos"], rows.schema["block_id"], StructField("type", StringType()), StructField("name", StringType()), StructField("score", DoubleType()), StructField("start", IntegerType())])
    return rows.mapInArrow(lambda it: _extract(it, load), schema)


def model_evidence(mentions: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """type, normalized, block_id, first (struct of pos, start, name), confidence: one row for each name of each block, with its best score. Names of 2 to 120 characters and the confidence asked for, which is held between 0.5 and 0.99."""
    least = max(0.5, min(min_confidence, 0.99))
    good = mentions.where((F.col("score") >= least) & F.length("name").between(SHORTEST, LONGEST)).withColumn("normalized", normalize_spaces(F.col("name")))
    return good.groupBy("type", "normalized", "block_id").agg(F.min(F.struct("pos", "start", "name")).alias("first"), F.max("score").alias("confidence"))


def model_candidates(evidence: DataFrame, known: DataFrame | None = None, extractor: str = EXTRACTOR) -> DataFrame:
    """id, type, name, normalized, confidence, n, first_block, extractor of model_evidence: one pending candidate for each type and normalised name, under the first name seen.

    Those that a deterministic one of known(type, name, extractor) already names are left out; candidates of an earlier run of a model don't count as such. Evidence stays in its rows.
    """
    per = evidence.groupBy("type", "normalized").agg(F.min("first").alias("_f"), F.max("confidence").alias("confidence"), F.count("*").alias("n"), F.min("block_id").alias("first_block"))
    name = F.col("_f.name")
    out = per.select(F.concat(F.lit("model-entity-"), "type", F.lit("-"), slug(name)).alias("id"), "type", name.alias("name"), "normalized", "confidence", "n", "first_block", F.lit(extractor).alias("extractor"))
    return out if known is None else twins(out, known.where(~F.coalesce(F.col("extractor").startswith(EXTRACTOR), F.lit(False))).select("type", "name"))
