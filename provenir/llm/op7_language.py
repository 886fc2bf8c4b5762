"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training: labelled texts are read by Spark, each task counts the hashed 1- to 3-grams
of its batches per language in numpy, and Spark sums the counts into a written table. Of a language with more than
``max_training_docs`` documents about so many are used, those with the smallest hashes of their text; this
is the documented bound of the sample, for any number of languages. A language's prior is its share of all labelled documents. Every label is learned,
with the same buckets however many there are: languages are numbered, and stand in blocks of ``block_languages``, of which each
has a table of log probabilities of its own (block_languages x buckets floats), made from its rows of the counts and broadcast.

Scoring: the texts of a batch are one sparse matrix, a row for each with the counts of its n-grams, which is multiplied with the table in numpy. Texts of any
length are counted whole; long ones in pieces that carry on where the one before ended. With more than one block the texts pass the blocks one after the other,
and what a pass has found (the best so far, and the running sum of the posteriors) is written with them, so that a task holds one block's table. The prediction is the language of the greatest posterior. The
score is its posterior under log-likelihoods averaged to ``evidence`` n-grams, so that long texts don't all score 1.

Defined results: null text, or text without a letter (Unicode category L), is ``und`` with score 0; an empty
training table makes every text ``und``; ties go to the language first in
order; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import numbered
from ..storage import discard, materialize
from .text import groups, mix, strings

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_TRAINING_DOCS = 20_000  # of each language
BLOCK_LANGUAGES = 128  # in one broadcast table
PENDING = 1 << 20  # distinct counts that a task gathers before it passes them on
SMOOTHING = 0.5
EVIDENCE = 30
CELLS = 1 << 20  # products at a time
LETTER = regex.compile(r"\p{L}")
PIECE = 1 << 18  # characters counted at a time
END = 0x10FFFF  # not a character; stands between texts


def _codes(text: str) -> np.ndarray:
    """Code points, a space for whatever is no letter among the first 170."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    plain = (codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 170))
    return np.where(plain, np.uint64(32), np.where(codes == 0x3C2, np.uint64(0x3C3), codes))  # sigma's form goes by what follows


def _hashed(codes: np.ndarray, skip: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams that end behind the first ``skip`` codes and cross no END, and the number of ENDs before each."""
    of, ended, out = np.cumsum(codes == END), codes == END, []
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h, crosses = codes[:size].copy(), ended[:size].copy()
        for j in range(1, n):
            h = (h << np.uint64(21)) | codes[j : size + j]
            crosses |= ended[j : size + j]
        fine = ~crosses
        fine[: max(0, skip - n + 1)] = False
        out.append((of[:size][fine], (mix(h[fine] + np.uint64(n << 60)) >> np.uint64(40)).astype(np.int64) % buckets))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def grams(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed 1- to 3-grams of the lower-cased texts with runs of non-letters as one space and a space at both ends: which text, and the hash."""
    for a, b in groups(texts, PIECE):
        if len(texts[b - 1]) > PIECE:
            if b - a > 1:
                yield from ((d + a, g) for d, g in grams(texts[a : b - 1], buckets))
            long, tail = texts[b - 1], np.zeros(0, np.uint64)
            for i in range(0, len(long), PIECE):
                part = long[i : i + PIECE].lower().replace(chr(END), " ")
                part = (" " if i == 0 else "") + part + (" " if i + PIECE >= len(long) else "")
                codes = np.concatenate([tail, _codes(part)])
                fine = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]
                fine[: len(tail)] = True
                codes = codes[fine]
                yield tuple(x + y for x, y in zip((b - 1, 0), _hashed(codes, len(tail), buckets), strict=True))
                tail = codes[-2:]
            continue
        codes = _codes(chr(END).join(f" {t.lower().replace(chr(END), ' ')} " for t in texts[a:b]))
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
        d, g = _hashed(codes, 0, buckets)
        yield d + a, g


Block = tuple[list[str], np.ndarray, np.ndarray]


@dataclass
class Model:
    """languages(lang, l, n) and counts(l, b, n) as written tables; l is a language's place in order."""

    languages: DataFrame
    counts: DataFrame
    size: int
    total: int
    buckets: int
    block_languages: int

    def blocks(self) -> Iterator[Block]:
        """For each block its languages in order, their log priors, and the log probabilities, (buckets, languages) as float32."""
        for a in range(0, self.size, self.block_languages):
            inside = F.col("l").between(a, a + self.block_languages - 1)
            known = self.languages.where(inside).orderBy("l").collect()  # block_languages rows at most
            table = self.counts.where(inside).toPandas()  # block_languages x buckets rows at most
            counts = np.full((self.buckets, len(known)), SMOOTHING)
            counts[table["b"].to_numpy(), table["l"].to_numpy() - a] += table["n"].to_numpy()
            share = np.array([r.n for r in known], float) / self.total
            yield [r.lang for r in known], np.log(share), np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _summed(cells: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    where, at = np.unique(np.concatenate(cells), return_inverse=True)
    return where, np.bincount(at, np.concatenate(numbers), len(where)).astype(np.int64)


def train(labelled: DataFrame, buckets: int = BUCKETS, max_training_docs: int = MAX_TRAINING_DOCS, block_languages: int = BLOCK_LANGUAGES) -> Model:
    """The model of labelled(text, lang). Rows with a null in either are left out."""
    rows = labelled.where("text is not null and lang is not null").select("lang", "text")
    languages = materialize(numbered(rows.groupBy("lang").agg(F.count("*").alias("n")), ["lang"], "l"), "languages")
    # the bounded sample: a text's own hash decides, so that it doesn't depend on order or partitions
    part = F.lit(float(max_training_docs)) / F.col("n")
    sample = rows.join(languages, "lang").where(F.shiftrightunsigned(F.xxhash64("text"), 32) < part * float(1 << 32)).select("l", "text")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(where: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(where // buckets), pa.array((where % buckets).astype(np.int32)), pa.array(n)], names=["l", "b", "n"])

        cells, numbers, held = [], [], 0
        for batch in it:
            lang = np.array(batch.column(0).to_pylist(), np.int64)
            for d, g in grams(strings(batch.column(1)), buckets):
                where, n = np.unique(lang[d] * buckets + g, return_counts=True)
                cells.append(where)
                numbers.append(n)
                held += len(where)
                if held > PENDING:
                    where, n = _summed(cells, numbers)
                    if len(where) > PENDING // 2:
                        yield rows_of(where, n)
                        where, n = where[:0], n[:0]
                    cells, numbers, held = [where], [n], len(where)
        if held:
            yield rows_of(*_summed(cells, numbers))

    counts = materialize(sample.mapInArrow(count, "l long, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")), "counts")
    size, total = languages.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Model(languages, counts, size, total, buckets, block_languages)


def posteriors(texts: list[str], priors: np.ndarray, log_probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) sums of log probabilities without the priors, and the number of n-grams of each text."""
    buckets, languages = log_probs.shape
    sums, n = np.zeros((len(texts), languages)), np.zeros(len(texts), np.int64)
    for d, g in grams(texts, buckets):
        n += np.bincount(d, minlength=len(texts))
        cells, count = np.unique(d * buckets + g, return_counts=True)
        step = max(1, CELLS // languages)
        for a in range(0, len(cells), step):
            row, column = np.divmod(cells[a : a + step], buckets)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sums[row[first]] += np.add.reduceat(log_probs[column] * count[a : a + step, None].astype(np.float64), first, axis=0)
    return sums, n


# What a pass over a block leaves with each text: the best language so far, its whole sum and its mean one, and of all means the greatest and the sum of the exponentials against it.
STATE = "doc_id long, text string, lang_pred string, best double, mean double, top double, mass double"


def _passed(state: DataFrame, block: Block) -> DataFrame:
    """The state after one more block."""
    model = state.sparkSession.sparkContext.broadcast(block)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, priors, log_probs = model.value
        names = np.array(languages, object)
        for batch in it:
            texts = strings(batch.column(1))
            some = np.array([i for i, t in enumerate(texts) if LETTER.search(t)], np.int64)
            if len(some):
                preds = np.array(batch.column(2).to_pylist(), object)
                best, mean, top, mass = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(3, 7))
                sums, n = posteriors([texts[i] for i in some], priors, log_probs)
                each = np.arange(len(some))
                at = (sums + priors).argmax(axis=1)
                whole = (sums + priors)[each, at]
                means = sums / n[:, None] * np.minimum(n, EVIDENCE)[:, None] + priors
                ahead = whole > best[some]  # ties stay with the language that is first in order
                preds[some[ahead]], best[some[ahead]], mean[some[ahead]] = names[at[ahead]], whole[ahead], means[each, at][ahead]
                high = np.maximum(top[some], means.max(axis=1))
                mass[some] = mass[some] * np.exp(top[some] - high) + np.exp(means - high[:, None]).sum(axis=1)
                top[some] = high
                found = [pa.array(preds.tolist(), pa.string()), *[pa.array(x, pa.float64()) for x in (best, mean, top, mass)]]
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=batch.schema.names)
            yield batch

    return state.mapInArrow(score, STATE)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each document."""
    none = "cast('-Infinity' as double)"
    state = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(null as string) lang_pred", f"{none} best", f"{none} mean", f"{none} top", "0D mass")
    before = None
    for i, block in enumerate(model.blocks()):
        if i:
            state = materialize(state, "scored")
            if before is not None:
                discard(before)
            before = state
        state = _passed(state, block)
    known = F.col("lang_pred").isNotNull()
    return state.select("doc_id", F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, F.round(F.exp(F.col("mean") - F.col("top")) / F.col("mass"), 9)).otherwise(0.0).alias("score"))


def held_out() -> F.Column:
    """True for the documents that training may not see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def language_query(docs: DataFrame) -> DataFrame:
    """Train on what isn't held out and predict for all documents."""
    return identify(docs, train(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
