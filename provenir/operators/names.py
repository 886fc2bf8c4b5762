"""Which of many names a text holds, as substrings, for any number of texts and names: no text meets a name that isn't in it.

Names are put into a bitmap by two hashes: of their first 1, 2, 4, ... bytes, as many as they have, and of all their bytes. A task rolls hashes over its texts. Where the first bytes
of some name may begin, the lengths that such names have are tried, and what the bitmap knows is passed on as a string. These strings are joined with the names, so the result is exact
whatever the bitmap lets through. Where no name has a space, the pieces between spaces are searched instead of the texts, each distinct one of a group once. The bitmap has 16 bits for each name and MOST_BITS at most; with more names more strings are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import materialize

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
BITS_PER_NAME = 16
FEW_STRINGS = 1 << 18
GROUP_BYTES, PIECES_BYTES = 1 << 20, 4 << 20  # of texts searched at once: as they are, and by their pieces
BEGINNINGS = tuple(1 << i for i in range(6))  # bytes by which a place is tried first
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[np.uint64, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(1 << max(16, int(n).bit_length()), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _prefixes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _power(_BASE, len(data)), out=out[1:])
    return out


def _windows(prefix: np.ndarray, at: np.ndarray, size: np.ndarray | int, whole: bool) -> np.ndarray:
    """Hashes of the stretches that begin at these places; those of whole names differ from those of beginnings."""
    x = (prefix[at + size] - prefix[at]) * _power(_INVERSE, len(prefix))[at] + np.asarray(size).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(whole)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(34)) & np.uint64(bits - 1)


def _known(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    a, b = _bits(hashes, 32 * len(bitmap))
    five, rest = np.uint64(5), np.uint64(31)
    return ((bitmap[a >> five] >> (a & rest).astype(np.uint32)) & (bitmap[b >> five] >> (b & rest).astype(np.uint32)) & np.uint32(1)).astype(bool)


def _beginning(sizes: np.ndarray) -> np.ndarray:
    return np.array(BEGINNINGS)[np.searchsorted(BEGINNINGS, np.minimum(sizes, BEGINNINGS[-1]), side="right") - 1]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Bytes of all texts one after another, where each begins and the last ends, and the same bytes."""
    raw = [t.encode() for t in texts]
    whole = b"".join(raw)
    return np.frombuffer(whole, np.uint8).astype(np.uint64), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64), whole


def bitmap_of(names: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bitmap of names(called) and the lengths in bytes that names have."""
    sizes = names.groupBy(F.octet_length("called").alias("n")).agg(F.count("*").alias("names")).collect()  # a row for each length
    lengths, bits = sorted(r.n for r in sizes), LEAST_BITS
    wanted = min(MOST_BITS, BITS_PER_NAME * sum(r.names for r in sizes))
    while bits < wanted:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cuts, _ = _joined(batch.column(0).to_pylist())
            prefix, sizes = _prefixes(data), np.diff(cuts)
            hashes = np.r_[_windows(prefix, cuts[:-1], _beginning(sizes), False), _windows(prefix, cuts[:-1], sizes, True)]
            at = np.concatenate(_bits(hashes, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["word", "mask"])

    words = names.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # MOST_BITS / 32 rows at most
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[np.asarray(words["word"].combine_chunks())] = np.asarray(words["mask"].combine_chunks()).astype(np.uint32)
    return bitmap, lengths


def strings_known(texts: list[str], bitmap: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, str]]:
    """(place of the text, string): distinct strings of each text that may be names."""
    data, cuts, whole = _joined(texts)
    if not len(data):
        return
    prefix = _prefixes(data)
    end = np.repeat(cuts[1:], np.diff(cuts))  # where the text of each byte ends
    sizes = np.array(lengths, np.int64)
    for begin in BEGINNINGS:
        own = sizes[_beginning(sizes) == begin] if len(sizes) else sizes
        if not len(own):
            continue
        at = np.arange(max(0, len(data) - begin + 1))
        at = at[at + begin <= end[at]]
        at = at[_known(_windows(prefix, at, begin, False), bitmap)]
        for size in own.tolist():
            here = at[at + size <= end[at]]
            here = here[_known(_windows(prefix, here, size, True), bitmap)]
            rows = np.searchsorted(cuts, here, side="right") - 1
            for row, found in dict.fromkeys((r, whole[i : i + size]) for r, i in zip(rows.tolist(), here.tolist(), strict=True)):
                try:
                    yield row, found.decode()
                except UnicodeDecodeError:  # begins or ends inside a character, so it is no name
                    continue


def strings_in_pieces(texts: list[str], bitmap: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Places of texts, strings, and the string's number for each place: the distinct strings without spaces of each text that may be names."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    pieces = coded.dictionary.to_pylist()
    numbers: dict[str, int] = {}
    found = [(p, numbers.setdefault(x, len(numbers))) for p, x in strings_known(pieces, bitmap, lengths)]
    if not found:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    piece, string = np.array(found, np.int64).T
    order = np.argsort(piece, kind="stable")
    piece, string = piece[order], string[order]
    fans = np.bincount(piece, minlength=len(pieces))
    starts = np.cumsum(fans) - fans
    text = np.repeat(np.arange(len(texts)), np.asarray(split.value_lengths()))
    text, held = np.divmod(np.unique(text * len(pieces) + np.asarray(coded.indices)), len(pieces))
    fan = fans[held]
    each = string[np.arange(fan.sum()) + np.repeat(starts[held] - np.cumsum(fan) + fan, fan)]
    text, each = np.divmod(np.unique(np.repeat(text, fan) * len(numbers) + each), len(numbers))
    return text, list(numbers), each


def name_rows(texts: DataFrame, names: DataFrame, ident: str) -> DataFrame:
    """ident and all columns of the names(called, ...) that the text of each row of texts(ident, text) holds; texts are questions, many or few.

    Where the strings in texts of the lengths that names have are FEW_STRINGS at most, these are joined with the names, which are then read without an exchange; more texts are searched (``find_names``).
    """
    given = texts.select(ident, "text").where("text IS NOT NULL")
    size = given.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("longest")).first()
    if size.chars > FEW_STRINGS:
        return find_names(texts, names, ident).join(names, "called")
    lengths = [r.n for r in names.select(F.length("called").alias("n")).where(F.col("n").between(1, size.longest)).distinct().collect()]  # a row for each length
    if size.chars * len(lengths) > FEW_STRINGS:
        return find_names(texts, names, ident).join(names, "called")
    sizes = F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n")
    ended = given.select(ident, "text", sizes).where(F.length("text") >= F.col("n"))
    places = ended.select(ident, "text", "n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)).alias("at"))
    strings = materialize(places.select(ident, F.col("text").substr(F.col("at"), F.col("n")).alias("called")).distinct(), "strings")
    return names.join(strings, "called")


def find_names(texts: DataFrame, names: DataFrame, ident: str = "ident", once: bool = False) -> DataFrame:
    """(ident, called), each once: the names(called) that texts(ident, text) hold as substrings, case and all. Null and empty names and texts hold nothing.

    With ``once`` the caller says that an ident has one row of texts; what is found then needs no exchange to be made distinct.
    """
    known = materialize(names.select("called").where("called <> ''").distinct(), "names")
    bitmap, lengths = bitmap_of(known)
    spaced = not known.where(F.contains("called", F.lit(" "))).isEmpty()
    sent = texts.sparkSession.sparkContext.broadcast((bitmap, lengths))
    given = texts.select(ident, "text").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, lengths = sent.value
        for batch in batches:
            every = batch.column(1).to_pylist()
            begin, size = 0, 0
            for i, t in enumerate(every):
                size += len(t)
                if size > (GROUP_BYTES if spaced else PIECES_BYTES) or i == len(every) - 1:
                    group = every[begin : i + 1]
                    if spaced:
                        found = list(strings_known(group, bitmap, lengths))
                        rows, called = np.array([r for r, _ in found], np.int64), pa.array([x for _, x in found], pa.string())
                    else:
                        rows, strings, number = strings_in_pieces(group, bitmap, lengths)
                        called = pa.array(strings, pa.string()).take(pa.array(number))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin + rows)), called], names=[ident, "called"])
                    begin, size = i + 1, 0

    schema = StructType([given.schema[ident], StructField("called", StringType())])
    found = given.mapInArrow(run, schema)
    return (found if once else found.distinct()).join(known, "called", "left_semi").select(ident, "called")
