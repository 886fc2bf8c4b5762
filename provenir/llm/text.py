"""Small numpy helpers on the words and bytes of texts, shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

GROUP_CHARS = 1 << 20  # characters of text judged together
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE^i (or its inverse) modulo 2^64 for i < n."""
    name = "inv" if inverse else "fwd"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        step = np.full(size, BASE_INV if inverse else BASE, np.uint64)
        step[0] = 1
        have = _powers[name] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads differences over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of values[i] * BASE^i: the polynomial hash of every prefix."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of the given width, free of its place."""
    n = len(prefix) - 1 - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[width:] - prefix[:n]) * powers(n, inverse=True))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same for the next."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() divides at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lowered(word_bytes: bytes) -> bytes:
    """A-Z lower-cased, other bytes as they are (bytes.lower() does just that)."""
    return word_bytes.lower()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def wide_hashes(words: list[bytes]) -> np.ndarray:
    """(2, n): the two halves of each word's 128-bit hash."""
    raw = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.frombuffer(raw, ">u8").reshape(-1, 2).T.astype(np.uint64)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty one."""
    return [x or "" for x in column.to_pylist()]


def groups(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of about limit characters together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > limit or i == len(texts) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def filter_texts(docs: DataFrame, keeper: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept. keeper is called once in each task and gives the judge of a list of texts."""
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keeper()
        for batch in it:
            texts = strings(batch.column(at))
            for a, b in groups(texts, GROUP_CHARS):
                yield batch.slice(a, b - a).filter(pa.array(keep(texts[a:b]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
