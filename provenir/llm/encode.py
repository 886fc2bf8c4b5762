"""Whole-text encoding with the tokenizers library, word pieces remembered between texts.

Both vocabularies used here treat a text as independent pieces that begin at a single
space after a character that isn't white space, so a text's ids are its pieces'
ids one after another. Natural text repeats most of its pieces; each new piece is
encoded by the library once per worker and then looked up. Tests hold this against whole-text encoding.

A group of texts is split and its distinct pieces are found in Arrow; only these are looked up, by a 128-bit hash, in a
compact store (sorted hashes, their places and one array of ids) of bounded size: when full it is emptied and filled again. The ids of all
pieces are then gathered in numpy.

A text that holds one of the vocabulary's special tokens, such as <|endoftext|>, is encoded whole by the library, since that splits it there.

New pieces are encoded many at a time, as one text, and the ids are divided again where a
piece begins: in the byte-level vocabulary a token that begins with a space does so; in the one with word ends, a
piece of letters and then signs has one word end for each of the two. Any other piece is encoded on its own.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?%$&*#|<>()\"-]*)")
MEMORY = 1_500_000  # pieces
GROUP = 1 << 22  # characters of text encoded together


class Store:
    """From 128-bit keys to stretches of ids. A stretch of -1 ids marks a piece that doesn't stand on its own.

    Pieces keep the place at which they were added; only the keys' first halves are sorted, with these places beside them.
    """

    def __init__(self, limit: int, dtype: np.dtype):
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.checks, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        order = np.argsort(keys)  # neighbours are looked up one after another, which memory is faster at
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        place = self.places[at]
        return np.where((self.keys[at] == keys) & (self.checks[place] == checks), place, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New keys with their ids, in the same order; their places."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used), self.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        whole = np.maximum(sizes, 0)
        starts = self.used + np.cumsum(whole) - whole
        self.used += len(ids)
        places = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        order = np.argsort(keys)
        into = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, into, keys[order])
        self.places = np.insert(self.places, into, places[order])
        self.checks = np.concatenate([self.checks, checks])
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        return places


class Encoder:
    """Ids as little-endian unsigned integers of 16 bits, or 32 where the vocabulary is larger.

    word_ends: the vocabulary marks word ends and drops white space; otherwise it is byte-level.
    """

    def __init__(self, path: str, memory: int = MEMORY, word_ends: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.code = "H" if max(vocabulary.values()) < 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.word_ends, self.store = word_ends, Store(memory, self.dtype)
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        self.mark[[i for t, i in vocabulary.items() if (t.endswith("</w>") if word_ends else t.startswith("Ġ"))]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Put the ids of words into the store; their places there."""
        sizes = np.full(len(words), -1, np.int32)
        together, marks, alone = [], [], []
        for i, w in enumerate(words):
            if self.word_ends:
                if m := _PLAIN.fullmatch(w):
                    together.append(i)
                    marks.append(bool(m[1]) + bool(m[2]))
                else:
                    alone.append(i)
            elif w and not w[-1].isspace():  # else the space after it may belong to a run of white space
                together.append(i)
        order, ids = [], []
        for a in range(0, len(together), 4000):
            part = together[a : a + 4000]
            text = " ".join([words[i] for i in part])
            got = np.frombuffer(self._whole([text if self.word_ends else " " + text])[0], self.dtype)
            at = np.flatnonzero(self.mark[got])
            if self.word_ends:
                ends = np.cumsum(marks[a : a + 4000])
                cuts = np.r_[0, np.r_[0, at + 1][np.minimum(ends, len(at))]]
            else:
                cuts = np.r_[at, len(got)]
            if len(cuts) != len(part) + 1 or cuts[-1] != len(got):  # a vocabulary of another make
                alone += part
                continue
            sizes[part] = np.diff(cuts)
            order += part
            ids.append(got)
        if alone:
            each = self._whole([words[i] if self.word_ends else " " + words[i] for i in alone])
            sizes[alone] = [len(x) // self.dtype.itemsize for x in each]
            order += alone
            ids.append(np.frombuffer(b"".join(each), self.dtype))
        order += np.flatnonzero(sizes < 0).tolist()
        places = np.empty(len(words), np.int64)
        places[order] = self.store.add(keys[order], checks[order], sizes[order], np.concatenate(ids) if ids else np.zeros(0, self.dtype))
        return places

    def _look_up(self, words: list[str]) -> np.ndarray:
        """The places of distinct words in the store."""
        raw = b"".join(map(xxhash.xxh3_128_digest, words))
        keys, checks = np.ascontiguousarray(np.frombuffer(raw, ">u8").reshape(-1, 2).T).astype(np.uint64)
        at = self.store.find(keys, checks)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        if len(self.store.keys) + len(new) > self.store.limit:
            self.store.clear()
            new = np.arange(len(words))
        at[new] = self._learn([words[i] for i in new], keys[new], checks[new])
        return at

    def encode_group(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        special = np.zeros(len(texts), bool)
        for content in self.special:
            special |= np.asarray(pc.match_substring(column, content))
        if special.any():
            whole = iter(self._whole([texts[i] for i in np.flatnonzero(special)]))
            plain = iter(self.encode_group([texts[i] for i in np.flatnonzero(~special)]))
            return [next(whole) if s else next(plain) for s in special.tolist()]
        lists = pc.split_pattern(column, " ")
        ends = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        place = np.asarray(coded.indices)
        at = self._look_up(coded.dictionary.to_pylist())[place]
        sizes = self.store.sizes[at].astype(np.int64)
        odd = np.add.reduceat(sizes < 0, ends[:-1]) > 0 if not self.word_ends else np.zeros(len(texts), bool)
        sizes[sizes < 0] = 0
        heads = [b""] * len(texts)
        if not self.word_ends:  # of a byte-level vocabulary the first word has no space before it
            sizes[ends[:-1]] = 0
            heads = self._whole([t.partition(" ")[0] for t in texts])
        to = np.cumsum(sizes)
        ids = self.store.ids[np.repeat(self.store.starts[at] - (to - sizes), sizes) + np.arange(to[-1])]
        cuts = np.r_[0, to][ends].tolist()
        odd_ids = iter(self._whole([t for t, o in zip(texts, odd, strict=True) if o]))
        return [next(odd_ids) if o else h + ids[a:b].tobytes() for o, h, a, b in zip(odd.tolist(), heads, cuts, cuts[1:], strict=False)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > GROUP:
                out += self.encode_group(group)
                group, size = [], 0
        return out + self.encode_group(group)


@lru_cache(maxsize=4)
def encoder(path: str, word_ends: bool = False) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, word_ends=word_ends)
