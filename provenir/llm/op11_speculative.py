"""BPE by guess and proof: a greedy guess for every word, a check of each pair of neighbours, exact merging where a pair fails.

A sequence of tokens is the BPE encoding of a word exactly if each token is the encoding of its own string and each two
neighbours, taken alone, stay apart. So a word's guess, the longest token at each place, is proved by looking at its pairs. A pair is
followed back in the order of merges: of the two tokens at the border the one made later is undone, until both are single symbols; if
on the way the two at the border have a merge that comes before the one just undone, it would have crossed the border.

Words are distinct words of a group of texts; the places' longest tokens, and the pairs' checks, are found for all of them at once in numpy.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import Encoder
from .text import groups, spread, strings

GROUP_CHARS = 1 << 19  # of text, or ids, handled together
PIECES = 1 << 20  # remembered in a worker
NEVER = np.int64(1) << 40
SHORT = 64  # symbols of a word that is merged together with others
# How byte-level vocabularies write bytes. Printable ones stand for themselves, the rest follow from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}
# Texts of these characters are cut into words by a pattern of our own; of others the library's normaliser and splitter are asked.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9.,;:!?%$&*#|<>()\"\n\r\t-]*")
_WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[.,;:!?%$&*#|<>()\"-]+| ")


class Merges:
    """The merge table of a vocabulary with word ends. Symbols 0-255 are bytes, 256-511 bytes that end a word."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        n = max(vocab.values()) + 1
        self.base = np.array([vocab[BYTE_CHARS[b] + end] for end in ("", suffix) for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b, made = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in merges), strict=True))
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), a, b
        if len(np.unique(made)) < len(made) or (np.maximum(self.rank[a], self.rank[b]) >= np.arange(len(made))).any():
            raise ValueError("each token needs one merge, after those of its parts")
        order = np.argsort(a << 32 | b)
        self.pair_keys, self.pair_ranks, self.made = (a << 32 | b)[order], order, made
        self.own = np.ones(n, bool)  # is the encoding of its own string
        whole = self.apart(a, b, np.arange(len(made)))
        for t, x, y, ok in zip(made.tolist(), a.tolist(), b.tolist(), whole.tolist(), strict=True):
            self.own[t] = ok and self.own[x] and self.own[y]
        self._trie(made.tolist(), a.tolist(), b.tolist())

    def _trie(self, made: list[int], a: list[int], b: list[int]) -> None:
        spelt = {t: (s,) for s, t in enumerate(self.base.tolist())}
        for t, x, y in zip(made, a, b, strict=True):
            spelt[t] = spelt[x] + spelt[y]
        edges, tokens = {}, [-1]
        for t, symbols in spelt.items():
            if not self.own[t]:
                continue
            node = 0
            for s in symbols:
                key = node << 10 | s
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(tokens)
                    tokens.append(-1)
            tokens[node] = t
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.node_token = np.array(tokens, np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or NEVER."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: no merge crosses their border (of those that come before the given rank)."""
        good = np.ones(len(a), bool)
        on = np.arange(len(a))
        limit = np.full(len(a), NEVER) if before is None else before
        while len(on):
            clash = self.ranks_of(a, b) < limit
            good[on[clash]] = False
            first = self.rank[a] > self.rank[b]  # undo the one made later; of equal ones the right, since merging goes from the left
            go = ~clash & (first | (self.rank[b] >= 0))
            on, a, b, first = on[go], a[go], b[go], first[go]
            limit = np.where(first, self.rank[a], self.rank[b] + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, length) of the longest token at each place."""
        n = len(symbols)
        padded = np.r_[symbols, 1023].astype(np.int64)
        token, length = self.base[symbols], np.ones(n, np.int64)
        at, node = np.arange(n), np.zeros(n, np.int64)
        depth = 0
        while len(at):
            keys = node << 10 | padded[np.minimum(at + depth, n)]
            to = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            hit = self.edge_keys[to] == keys
            at, node = at[hit], self.edge_to[to[hit]]
            depth += 1
            got = self.node_token[node]
            token[at[got >= 0]], length[at[got >= 0]] = got[got >= 0], depth
        return token, length

    def merge_many(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of short words, a merge of each in a round: the earliest, of equal ones the leftmost. Gives the ids of all words and how many each has."""
        tokens, word = self.base[symbols], np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(tokens), NEVER)  # of the merge with the next token

        def look(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at + 1 < len(tokens))]
            with_next = at[word[at] == word[at + 1]]
            rank[at] = NEVER
            rank[with_next] = self.ranks_of(tokens[with_next], tokens[with_next + 1])

        look(np.arange(len(tokens)))
        done = []
        while len(tokens):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(tokens)]))
            over = least == NEVER
            if over.any():
                done.append((word[over], tokens[over]))
                tokens, word, rank, least = tokens[~over], word[~over], rank[~over], least[~over]
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]] if len(at) else at
            tokens[at] = self.made[rank[at]]
            rank[at] = NEVER
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, word, rank = tokens[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            look(np.r_[at, (at - 1)[word[at - 1] == word[at]]] if len(at) else at)
        word, tokens = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return tokens[order], np.bincount(word, minlength=len(sizes))

    def merge(self, symbols: np.ndarray) -> list[int]:
        """The same for one word of any length."""
        tokens = self.base[symbols].tolist()
        n = len(tokens)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i, r in enumerate(self.ranks_of(self.base[symbols[:-1]], self.base[symbols[1:]]).tolist()) if r < NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != x or j >= n or tokens[j] != y:
                continue  # merged meanwhile
            tokens[i], tokens[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
            for u, v in ((prior[i], i), (i, k)):
                if u >= 0 and v < n:
                    m = self._rank.get((tokens[u], tokens[v]))
                    if m is not None:
                        heapq.heappush(heap, (m, u, tokens[u], tokens[v]))
        return [t for t in tokens if t >= 0]

    @property
    def _rank(self) -> dict[tuple[int, int], int]:
        if "_ranks" not in self.__dict__:
            self._ranks = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(self.pair_keys, self.pair_ranks, strict=True)}
        return self._ranks

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """The ids of all words, one word after another, how many each has, and how many words had to be merged."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbols[ends - 1] += 256
        token, length = self.longest(symbols)
        taken, at, steps = [], 0, length.tolist()
        while at < len(steps):  # a token that ends a word holds its last symbol, so no guess leaves its word
            taken.append(at)
            at += steps[at]
        taken = np.array(taken, np.int64)
        ids, word = token[taken], np.searchsorted(ends, taken, side="right")
        pairs = np.flatnonzero(word[1:] == word[:-1])
        key, back = np.unique(ids[pairs] << 32 | ids[pairs + 1], return_inverse=True)
        failing = np.unique(word[pairs[~self.apart(key >> 32, key & 0xFFFFFFFF)[back]]])
        counts = np.bincount(word, minlength=len(words))
        if len(failing):
            begins = ends - sizes
            short = failing[sizes[failing] <= SHORT]
            got, n = self.merge_many(symbols[spread(begins[short], sizes[short])], sizes[short]) if len(short) else (ids[:0], short)
            each = [(short, n, got)]
            for w in failing[sizes[failing] > SHORT].tolist():
                got = np.array(self.merge(symbols[begins[w] : ends[w]]), np.int64)
                each.append((np.array([w]), np.array([len(got)]), got))
            kept = np.ones(len(words), bool)
            kept[failing] = False
            each.append((np.flatnonzero(kept), counts[kept], ids[kept[word]]))
            which, n, got = (np.concatenate(x) for x in zip(*each, strict=True))
            order = np.argsort(which)
            counts = n[order]
            ids = got[spread((np.cumsum(n) - n)[order], counts)]
        return ids, counts, len(failing)


class Speculative(Encoder):
    """An encoder of whole texts whose new pieces are guessed, checked and, where they fail, merged here; the library normalises and splits."""

    def __init__(self, path: str, memory: int = PIECES):
        import json

        super().__init__(path, memory, word_ends=True)
        model = json.loads(self.tokenizer.to_str())["model"]
        if not model["end_of_word_suffix"] or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["dropout"]:
            raise ValueError("not a byte-level vocabulary with word ends")
        self.merges = Merges(model)
        self.merged = self.guessed = 0  # words
        self.ids_of_special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte_of = {c: b for b, c in BYTE_CHARS.items()}

    def _words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all pieces, one piece after another, and how many each has."""
        plain = np.fromiter((_PLAIN.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        found = _WORD.findall(" ".join([p.lower() for p, ok in zip(pieces, plain, strict=True) if ok]))
        counts, parts, at = np.zeros(len(pieces), np.int64), [], 0
        for i, ok in enumerate(plain.tolist()):
            own = []
            if ok:
                begin = at
                while at < len(found) and found[at] != " ":
                    at += 1
                own, at = found[begin:at], at + 1
            else:
                normal = self.tokenizer.normalizer.normalize_str(pieces[i])
                own = [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            parts += own
            counts[i] = len(own)
        return parts, counts

    def _learn(self, words: list[str], keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        sizes, ids = self._pieces(words)
        return self.store.add(keys, checks, sizes.astype(np.int32), ids)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, per_piece = self._words(pieces)
        if not words:
            return np.zeros(len(pieces), np.int64), np.zeros(0, self.dtype)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        ids, counts, merged = self.merges.encode(coded.dictionary.to_pylist())
        self.guessed, self.merged = self.guessed + len(counts), self.merged + merged
        place = np.asarray(coded.indices)
        each = counts[place]
        to = np.cumsum(each)
        begins = np.cumsum(counts) - counts
        out = ids[np.repeat(begins[place] - (to - each), each) + np.arange(to[-1])]
        at = np.r_[0, to][np.r_[0, np.cumsum(per_piece)]]
        return np.diff(at), out.astype(self.dtype)

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Texts that may hold special tokens, which divide them before anything else."""
        out = []
        for t in texts:
            parts = self.cut.split(t)
            plain = iter(self.encode_group(parts[::2]))
            ids = [np.array([self.ids_of_special[p]], self.dtype).tobytes() if i % 2 else next(plain) for i, p in enumerate(parts)]
            out.append(b"".join(ids))
        return out


class Decoder:
    """From ids to text, as the library does it: a vocabulary without a decoder of its own joins its tokens by spaces. Special tokens stay."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer = tokenizer if tokenizer.decoder is not None else None
        known = {i: t for t, i in tokenizer.get_vocab().items()}
        self.written = [known.get(i, "").encode() for i in range(max(known) + 1)]

    def decode(self, ids: list[int]) -> str:
        if self.tokenizer is not None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return b" ".join(map(self.written.__getitem__, ids)).decode()


@lru_cache(maxsize=2)
def speculative(path: str) -> Speculative:
    """One for each worker process and vocabulary."""
    return Speculative(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_texts(docs: DataFrame, path: str, out: str = "token_ids") -> DataFrame:
    """docs with ``out``, the ids of each whole text, in place of a column of that name. A null text has the ids of an empty one: none. Repeated rows, and rows without an id, are encoded each; an empty table stays empty."""
    docs = docs.drop(out)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = speculative(path)
        for batch in batches:
            texts = strings(batch.column(at))
            for a, b in groups(texts, GROUP_CHARS):
                ids = encoder.encode(texts[a:b])
                offsets = np.r_[0, np.cumsum([len(x) // encoder.dtype.itemsize for x in ids])].astype(np.int32)
                values = np.frombuffer(b"".join(ids), encoder.dtype).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, column], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.select("*", F.array(F.lit(0)).alias(out)).schema)


def decode_ids(rows: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """rows with ``out``, the text of each list of ids, in place of a column of that name. A null list gives an empty text."""
    rows = rows.drop(out)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path).decode
        for batch in batches:
            lists = batch.column(at)
            cuts, values = np.asarray(lists.offsets), np.asarray(lists.values)
            sizes = np.diff(cuts)
            begin = 0
            while begin < len(sizes):  # about GROUP_CHARS ids at a time
                end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + GROUP_CHARS, side="right")) - 1)
                valid = np.asarray(lists.slice(begin, end - begin).is_valid())
                texts = [decode(values[cuts[i] : cuts[i + 1]].tolist()) if ok else "" for i, ok in zip(range(begin, end), valid.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])
                begin = end

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(out)).schema)


def bpe_query(docs: DataFrame, path: str) -> DataFrame:
    """A row for each document: ids and decoded text as digests. Null and empty texts have no ids and decode to an empty text; repeated rows each give a row; other columns aren't read."""
    rows = decode_ids(encode_texts(docs.select("doc_id", "text"), path).drop("text"), path)
    ids = F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " ")
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
