"""Guessed BPE, divergence of sources and the prefix trie against the library and plain Python, on odd rows too."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provenir.llm import op12_divergence, op13_trie
from provenir.llm.op11_speculative import Decoder, Speculative, bpe_query, decode_ids, encode_texts
from provenir.llm.op12_divergence import Forest, audit, differences, shares
from provenir.llm.op13_trie import Parens, rebuilt, running, subtrees, trie_query, turns_of

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token_ids string, decoded string, n long, value string"
TURNS = "conv_id long, turn long, role string, text string, pos string, depth string, n string"


def documents(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None, "x", "y", 1, "z") for r in rows], DOCS)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "a", None, "b") for r in rows], TURNS)


# --- 11 ---


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_guessed_and_merged_words_are_the_librarys(library):
    rnd = random.Random(1)
    vocab = [w.replace("</w>", "") for w in library.get_vocab()]
    texts = ["hi <|endoftext|> there", "a<|startoftext|>b", "<|endoftext|>", "", " ", "a\t\tb c\n\n", "it's I'll WE'VE", "\x1c a", "ΑΣ ΟΔΟΣ", "é ́a", "İ İa", "ªº µ ½ ÿ", "日本語 漢字", "👩‍👩‍👧", "a" * 5000, "ab" * 3000 + "!" * 2000]
    texts += ["".join(rnd.choice("abcdeéinth'.-1 ") for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6))) for _ in range(1500)]
    texts += ["".join(rnd.choice("aaaah") for _ in range(rnd.randint(1, 90))) for _ in range(500)]
    encoder = Speculative(WORD_BPE, memory=500)
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < encoder.merged < encoder.guessed
    decode = Decoder(WORD_BPE).decode
    assert [decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in got]


def test_pairs_stay_apart_exactly_where_merging_leaves_them(library):
    merges = Speculative(WORD_BPE).merges
    rnd, vocab = random.Random(2), library.get_vocab()
    known = {i: t for t, i in vocab.items()}
    symbol = {int(t): s for s, t in enumerate(merges.base.tolist())}

    def symbols(t):
        a, b = int(merges.left[t]), int(merges.right[t])
        return [symbol[t]] if merges.rank[t] < 0 else symbols(a) + symbols(b)

    inner = [t for t in known if not known[t].endswith("</w>") and t < 49_000]
    pairs = [(rnd.choice(inner), rnd.randrange(49_000)) for _ in range(3000)]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    assert merges.apart(a, b).tolist() == [merges.merge(np.array(symbols(x) + symbols(y))) == [x, y] for x, y in pairs]
    sizes = np.array([len(symbols(x)) + len(symbols(y)) for x, y in pairs])
    ids, counts = merges.merge_many(np.concatenate([np.array(symbols(x) + symbols(y)) for x, y in pairs]), sizes)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [merges.merge(np.array(symbols(x) + symbols(y))) for x, y in pairs]


def test_bpe_of_a_table_with_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "no id"), (5, "é😀 ß" * 50), (6, "w " * 30_000), (6, "w " * 30_000), (7, "x" * 40_000), (8, "The end<|endoftext|>.")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])

    def digest(t):
        e = library.encode(t or "", add_special_tokens=False).ids
        return len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(map(tuple, bpe_query(docs, WORD_BPE).collect())) == Counter((i, *digest(t)) for i, t in rows)
    assert bpe_query(documents(spark, []), WORD_BPE).collect() == []
    whole = decode_ids(encode_texts(docs, WORD_BPE), WORD_BPE)
    assert sorted(whole.columns) == sorted(docs.columns) and whole.where("doc_id = 8").first().decoded.endswith("<|endoftext|> .</w>")


# --- 12 ---


def plain_audit(rows, min_docs):
    seen, count = defaultdict(set), defaultdict(Counter)
    for r, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        count[lang, source] += Counter()
        word = ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                if word:
                    seen[lang, word].add(r)
                    count[lang, source][word] += 1
                word = ""
            else:
                word += c.lower() if c.isascii() else c
    out = set()
    for lang in {x for x, _ in count}:
        kept = sorted(t for x, t in seen if x == lang and len(seen[x, t]) >= min_docs)
        groups = {s: c for (x, s), c in count.items() if x == lang}

        def share(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        def ranked(items):
            return enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1)

        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in groups.items():
            out |= {(lang, s, "pair", o, v, k) for k, (o, v) in ranked((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s)}
            out |= {(lang, s, "term", t, v, k) for k, (t, v) in ranked((t, f(p[s][t], q[t])) for t in kept if c[t] > 0 and p[s][t] > q[t]) if k <= 10}
    return out


@pytest.mark.parametrize(("block", "tile"), [(1 << 13, 32), (7, 3)])
def test_audit_is_that_of_plain_python(spark, block, tile):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in "abcdéЖ" for b in ("", "x", "ÿ", "\u0085", "Zz")]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(len(words))], k=rnd.randint(0, 30))) + rnd.choice(["", "1a-B", "\x00q"]), rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "s2", "s3", "é", None, "s9"])) for i in range(150)]
    rows += [(1, None, "de", "only"), (1, "few words", "it", "a"), (1, None, "it", None), (None, "a " * 20_000, "en", "s1"), *rows[:9]]
    got = audit(documents(spark, rows), min_docs=4, block_terms=block, tile_sources=tile).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_audit(rows, 4)


def test_audit_of_an_empty_table(spark):
    assert audit(documents(spark, [])).collect() == []


def test_counts_passed_on_early_add_up(spark, monkeypatch):
    rows = [(i, f"w{i % 7}a common b{i}", "en", f"s{i % 3}") for i in range(60)]
    whole = set(map(tuple, op12_divergence.term_counts(documents(spark, rows)).collect()))
    monkeypatch.setattr(op12_divergence, "HELD_ROWS", 4)
    monkeypatch.setattr(op12_divergence, "GROUP_CHARS", 40)
    assert set(map(tuple, op12_divergence.term_counts(documents(spark, rows).coalesce(1)).collect())) == whole


def test_equal_subtrees_are_one_node_priced_once():
    rnd = np.random.default_rng(4)
    counts = rnd.integers(0, 2, (5, 500)) * (rnd.random((5, 500)) < 0.05) * 3
    counts[4] = counts[3]
    forest, totals = Forest(counts), np.array([900, 901, 950, 1000, 1000])
    assert sum(len(left) for left, _ in forest.levels) < 5 * 511 / 2 and forest.roots[3] == forest.roots[4]
    a, b = np.triu_indices(5, 1)
    price, steps, leaf = forest.walk(a, b, totals[a], totals[b])
    p = np.stack([shares(c, totals[i : i + 1]) for i, c in enumerate(counts)])
    assert price.tolist() == [int(differences(p[x], p[y]).sum()) for x, y in zip(a, b, strict=True)] and len(leaf) < 60
    assert leaf[Forest.places(steps, 0)][:500].tolist() == differences(p[0], p[1]).tolist()


def test_shares_are_exact_for_large_counts():
    rnd = random.Random(5)
    for _ in range(300):
        total = rnd.randrange(1, 9 * 10**15)
        count = rnd.randrange(0, total)
        assert int(shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 2) // total


# --- 13 ---


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + t[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = set()
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = sum(len(x) == len(node) + 1 for x in below)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(seed, n=160):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(420), n):
        if rnd.random() < 0.4:
            rows += [(c, t, "user", f"same {t % 3}") for t in range(rnd.choice([1, 4, 4, 9]))]
        else:
            rows += [(c, rnd.choice([None, t, t, 3]), rnd.choice(["user", "é", None]), rnd.choice(["", "a", "bb", "ß😀", None])) for t in range(rnd.randint(1, 7))]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie_is_that_of_plain_python(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(op13_trie, "RANGE_ROWS", 20)
        monkeypatch.setattr(op13_trie, "SHARD_NODES", 9)
    rows = [*talk(6), (None, 0, "user", "nobody's"), *[(300, t, "user", "long") for t in range(150)], *[(250, t, "user", "long") for t in range(150)], (299, 0, "u", "turnless"), (99, 0, "u", "x" * 30_000)]
    rows += rows[:3]
    got = trie_query(conversations(spark, rows)).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "t")], [(7, 1, "u", "t")], [(7, None, None, None)], [(100, t, "u", "t") for t in (2, 1)], [(101, 0, "u", "t"), (102, 0, "u", "t")], [(i, 0, "u", "t") for i in range(400, 420)]])
def test_small_tries(spark, rows):
    assert set(map(tuple, trie_query(conversations(spark, rows)).collect())) == plain_trie(rows)


def test_turns_of_one_conversation_run_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(op13_trie, "RANGE_ROWS", 10)
    rows = [(c, t, "u", f"{t}") for c, n in ((1, 200), (2, 1), (3, 90)) for t in range(n)]
    got = turns_of(conversations(spark, rows)).collect()
    assert sorted((r.conv_id, r.pos) for r in got) == sorted((c, t) for c, t, _, _ in rows)
    df = spark.createDataFrame([(c, t, c * 1000 + t * 7919) for c, t, _, _ in rows], "k long, t long, v long")
    sums = defaultdict(int)
    for r in sorted(running(df, "k", ["t"], ("v",), ["k", "t", "v"]).collect(), key=lambda r: (r.k, r.t)):
        assert r._v == sums[r.k] and r._before == r.t
        sums[r.k] ^= r.v


def test_parentheses_close_where_a_stack_says():
    rnd = random.Random(8)
    for n in (1, 2, 31, 32, 33, 200, 5000):
        bits, depth, left = [], 0, n
        while left or depth:
            opening = left > 0 and (depth == 0 or rnd.random() < rnd.choice([0.3, 0.5, 0.9]))
            bits.append(opening)
            depth, left = depth + (1 if opening else -1), left - opening
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        starts = np.flatnonzero(bits)
        assert Parens(np.array(bits)).findclose(starts).tolist() == [close[i] for i in starts.tolist()]


def test_parts_of_a_shard_add_up():
    paths = sorted([([(1, 1), (2, 2)], [5, 7], True, False), ([(1, 1), (3, 3)], [0, 1], True, True), ([(1, 1)], [2], False, False), ([(4, 4)], [9], True, False)], key=lambda p: p[0])
    total = {k: (int(n), int(s)) for k, n, s in zip(*subtrees(paths), strict=True)}
    parts = defaultdict(lambda: [0, 0])
    for i in range(len(paths)):
        for k, n, s in zip(*subtrees(paths[i : i + 1]), strict=True):
            parts[k][0] += int(n)
            parts[k][1] += int(s)
    assert total == {k: tuple(v) for k, v in parts.items()} == {(0, 0): (3, 24), (1, 1): (2, 15), (2, 2): (1, 7), (3, 3): (1, 1), (4, 4): (1, 9)}


def test_rebuilt_conversations_keep_their_own_rest(spark):
    rows = [(c, t, "u", f"{c}.{t}") for c in (200, 201, 202, 250, 317) for t in range(4)]
    turns, convs = rebuilt(turns_of(conversations(spark, rows)))
    assert sorted(r.conv_id for r in convs.collect()) == [200, 201, 202, 250, 317]
    n = Counter(r.conv_id for r in turns.collect())
    for c in (200, 201, 202, 250, 317):
        h = zlib.crc32(str(c).encode()) % 6
        assert n[c] == min(h, 4 if c < 300 else 0) + max(0, 4 - h)
