"""Every operator on small tables: nulls, empty and long texts, repeated rows, extra and clashing columns, empty tables; against brute force where there is one."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenir.llm import op1_surrogates as P1
from provenir.llm import op5_superminhash
from provenir.llm.op2_orc import orc_query, read_tokens, write_tokens
from provenir.llm.op3_linkgraph import judge_urls, oracle
from provenir.llm.op4_windows import remove_repeated_windows, windows_query
from provenir.llm.op5_superminhash import near_duplicates, shingles, signatures
from provenir.llm.op6_repetition import quality_rules, repeats
from provenir.llm.op7_language import identify, language_query, train
from provenir.llm.op8_cgk import Index, find_leaks, fitting_distance, words
from provenir.llm.op9_suffixes import remove_repeated_bytes, suffix_query
from provenir.llm.op10_packing import pack
from provenir.llm.queries import BYTE_BPE, WORD_BPE

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, kind string, kept string, score string"


def table(spark, rows):
    """Rows of (doc_id, text) with the other columns of documents and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", None if i and i % 3 == 0 else "src", None, "x", "y", "z", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(real):
    return [(r.doc_id, r.text) for r in real.select("doc_id", "text").orderBy("doc_id").collect()]


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (None, "no id here"), (5, "é😀 ß" * 50), (6, "w " * 30_000), (6, "w " * 30_000), (7, "x" * 40_000)]

OPERATORS = {
    "op1": P1.surrogate_query,
    "op2": lambda d: orc_query(d, BYTE_BPE),
    "op4": windows_query,
    "op5": near_duplicates,
    "op6": quality_rules,
    "op7": language_query,
    "op9": suffix_query,
    "op10": lambda d: pack(d, WORD_BPE).groupBy("doc_id").count(),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_a_row_each(spark, name):
    got = OPERATORS[name](table(spark, ODD)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD) or name == "op10" and {r.doc_id for r in got} == {i for i, _ in ODD}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


# --- 1 ---


def test_surrogates_keep_type_layout_gender_and_coreference(spark):
    rows = [(1, "a.b@x.org A.B@X.ORG +1 (434) 555-2368 +14345552368 4111 1111 1111 1111 4111111111111111"), (2, "Mr. John Smith, Mrs. Anna Smith and Mr. Smith. Господин Иванов"), (3, "clean text 2024-01-02, 3.14 and v1.2.3")]
    got = {r.doc_id: r.text for r in P1.surrogate_query(table(spark, rows)).collect()}
    a = got[1].split(" ")
    assert a[0] == a[1] and "x.org" not in got[1].lower() and "@mail" in a[0]
    digits = ["".join(c for c in s if c.isdigit()) for s in (" ".join(a[2:5]), a[5], " ".join(a[6:10]), a[10])]
    assert digits[0] == digits[1] != "14345552368" and digits[0][0] == "1" and digits[2] == digits[3] and digits[2][0] == "4"
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits[2]))) % 10 == 0
    names = got[2].replace(",", "").replace(".", "").split()
    assert "Smith" not in got[2] and got[2].count(names[2]) == 3
    assert names[1] in P1.GIVEN["latin", "m"] and "Иванов" not in got[2]
    assert got[3] == rows[2][1]


def test_surrogates_of_many_values_are_distinct_and_new(spark):
    mails = [f"{c}@b.com" for c in "abcdefghijklmnopqrstuvwxyz"] * 2
    rows = [(i, f"write to {m} now") for i, m in enumerate(mails)] + [(100, "o@mail4.example.com")]
    got = {r.doc_id: r.text.split()[-2 if r.doc_id < 100 else 0] for r in P1.surrogate_query(table(spark, rows)).collect()}
    assert all(got[i] == got[i + 26] for i in range(26)) and len(set(got.values())) == 27
    assert not set(got.values()) & {*mails, "o@mail4.example.com"}


def test_many_moved_values_are_joined_with_the_same_result(spark, monkeypatch):
    rows = [(i, f"{c}@b.com") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    few = sorted(map(tuple, P1.surrogate_query(table(spark, rows)).collect()))
    monkeypatch.setattr(P1, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, P1.surrogate_query(table(spark, rows)).collect())) == few


# --- 2 and 10 ---


@pytest.mark.parametrize(("path", "word_ends"), [(BYTE_BPE, False), (WORD_BPE, True)])
def test_encoder_gives_the_ids_of_whole_texts(texts, path, word_ends):
    from provenir.llm.encode import Encoder

    tokenizer = Tokenizer.from_file(path)
    odd = ["hi <|endoftext|> there", "a<|startoftext|>b c", " <|endoftext|>  X<|endoftext|>", "<|ENDOFTEXT|> x", "", " ", "a  b", " a", "a ", "a\n b", "a\t\tb c", "it's I'll\n\n  do", "12 a1", "\x1c a b\x1c c", "ΑΣ ΟΔΟΣ", "é ́a b", "<|endoftext|> x", "x  y", "İ İa"]
    every = odd + [t for _, t in texts]
    encoder = Encoder(path, memory=5000, word_ends=word_ends)
    for _ in range(2):
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(every)]
        assert got == [e.ids for e in tokenizer.encode_batch(every, add_special_tokens=False)]


def test_orc_round_trip_and_index(spark, real, texts, tmp_path):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want, start = {}, 0
    for (i, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in orc_query(real, BYTE_BPE).collect()} == want
    write_tokens(real, f"{tmp_path}/t", BYTE_BPE)
    one = read_tokens(spark, f"{tmp_path}/t").where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString() and one.count() == 1


def test_packing_is_a_partition_and_holds_the_mixture(real, texts):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {i: [*e.ids, 1] for (i, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True)}
    rows = pack(real, WORD_BPE).collect()
    by_doc, by_seq, mix = {}, {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        mix.setdefault(r.sequence_id, Counter())[r.source] += r.length
    for i, parts in by_doc.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[i])
    assert len(by_doc) == len(ids) and sorted(by_seq) == list(range(len(by_seq)))
    total = sum(map(len, ids.values()))
    share = Counter()
    for r in rows:
        share[r.source] += r.length / total
    for q, parts in by_seq.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 2048 or q == len(by_seq) - 1
        if at == 2048:
            assert all(abs(mix[q][s] - 2048 * share[s]) <= 2 + len(share) for s in share)


# --- 3 ---


def test_link_graph_against_sql(spark, tmp_path):
    import duckdb

    rows = [
        (1, "http://a.com/x", '<a href="http://b.com/1"> <a href=//C.org/z>'),
        (2, "http://b.com/en", '<a href="https://bad.com/de/1">'),
        (3, "http://bad.com/de/3", None),
        (4, None, "x"),
        (5, "nourl", "<a href='http://b.com'>"),
        (6, "HTTP://C.ORG/es/", '<a HREF="http://a.com/x">'),
        (6, "HTTP://C.ORG/es/", '<a HREF="http://a.com/x">'),
        (7, "http://www.example.org/en/12?q#f", ""),
        (8, "http://q.net?x/y", '<a href="http://bad.com/">'),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, verdict string")
    pages.toPandas().to_parquet(f"{tmp_path}/p.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p.parquet'")
    got = sorted(repr(tuple(r)) for r in judge_urls(pages).collect())
    assert got == sorted(map(repr, c.execute(oracle()).fetchall()))
    assert judge_urls(pages.limit(0)).count() == 0
    verdicts = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages).collect()}
    assert verdicts[7] == ("example.org/en/1", "block") and verdicts[8] == (None, "block") and verdicts[4] == (None, "allow")


def test_many_rules_by_a_join_are_judged_as_by_one_expression(spark, monkeypatch):
    from provenir.llm import op3_linkgraph as L3

    r = random.Random(5)
    labels, paths = ["a", "b", "cc", "org"], ["/", "/x", "/x/", "/x/y", "", "/%", "/_"]
    host = lambda n: ".".join(r.choice(labels) for _ in range(n))
    rules = tuple({(r.choice(["allow", "block"]), host(r.randint(1, 3)), r.choice(paths)) for _ in range(120)}) + L3.RULES
    pages = [(i, f"http://{host(r.randint(1, 4))}{r.choice(paths)}{r.choice(['', 'q', '?a', '#f'])}", None) for i in range(600)]
    pages += [(None, None, None), (1, "nourl", ""), (1, "http://", "x"), (2, "http://.org/x", None), (2, "http://.org/x", None), (3, "http://a..org./", "<a href=//" + "b" * 50_000 + ">" * 10)]
    table = spark.createDataFrame([(*p, "trap", "trap", 0.5) for p in pages], "page_id long, url string, html string, host string, rules string, trust double")
    read = lambda rules: sorted(repr(tuple(x)) for x in L3.judge_urls(table, rules).collect())
    inline = read(rules)
    monkeypatch.setattr(L3, "INLINE_RULES", 10)
    assert read(rules) == inline and len(inline) == len(pages)
    assert read(spark.createDataFrame(list(rules), "verdict string, host string, path string")) == inline

    def judged(url):
        rest = url.split("://", 1)[1] if "://" in (url or "") else ""
        h = re.match(r"[^/?#]*", rest)[0]
        p = re.match(r"[^?#]*", rest[len(h) :])[0]
        fit = [x for x in rules if (h == x[1] or h.endswith("." + x[1])) and p.startswith(x[2])]
        best = min(fit, key=lambda x: (-len(x[1] + x[2]), x[1] + x[2], x[2], x[0]), default=None)
        return best and best[1] + best[2]

    assert sorted(repr(x.rule) for x in L3.judge_urls(table, rules).collect()) == sorted(repr(judged(p[1])) for p in pages)
    assert L3.judge_urls(table.limit(0), rules).collect() == [] and {x.rule for x in L3.judge_urls(table, table.sparkSession.createDataFrame([], "verdict string, host string, path string")).collect()} == {None}


# --- 4 and 9 ---


def test_repeated_windows_against_brute_force(real, texts):
    split = {i: t.encode().split() for i, t in texts}
    count = Counter(tuple(w[a : a + 35]) for w in split.values() for a in range(len(w) - 34))
    got = {r.doc_id: r for r in windows_query(real).collect()}
    for i, w in split.items():
        gone = [False] * len(w)
        for a in range(len(w) - 34):
            if count[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_windows_of_one_document_and_spans(spark):
    rows = [(1, "a b c d a b c x"), (2, "b c d"), (3, None)]
    got = {r.doc_id: (r.kept, list(r.spans)) for r in remove_repeated_windows(table(spark, rows), width=3).collect()}
    assert got == {1: ("x", [0, 7]), 2: ("", [0, 3]), 3: ("", [])}


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            s = b[a : a + length]
            if s in seen:
                gone[a : a + length] = True
            seen.add(s)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark, real, texts):
    assert {r.doc_id: tuple(r)[1:] for r in suffix_query(real).collect()} == brute_bytes(texts, 100)
    r = random.Random(5)
    base = "".join(r.choice("ab ") for _ in range(3000))
    rows = [(1, "a" * 500), (2, "ab" * 300), (3, "x" * 99), (4, None), (5, ""), (6, "a" * 100), (7, "abcdefghij" * 30 + "Q" + "abcdefghij" * 30), (8, "é" * 200)]
    for i in range(10, 60):
        a = r.randrange(2500)
        t = base[a : a + r.randrange(80, 450)]
        p = r.randrange(len(t))
        rows.append((i, t[:p] + r.choice("ab ") + t[p + 1 :] + base[: r.randrange(150)]))
    assert {x.doc_id: tuple(x)[1:] for x in suffix_query(table(spark, rows)).collect()} == brute_bytes(rows, 100)
    short = [(i, t and t[:60]) for i, t in rows]
    got = {x.doc_id: (x.n_bytes, x.n_removed) for x in remove_repeated_bytes(table(spark, short), length=20).collect()}
    assert got == {i: v[:2] for i, v in brute_bytes(short, 20).items()}


# --- 5 ---


def components_of(rows, width):
    sets = {i: shingles(t or "", width) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a]) and len(sets[b]):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark, real, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(real).collect()}
    assert got == components_of(texts, 4)


def test_a_drifting_family_of_copies(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, now = [], [word() for _ in range(150)]
    for i in range(120):  # each a few edits from some earlier one
        now = list(now) if r.random() < 0.5 else list(rows[r.randrange(len(rows))][1].split()) if rows else now
        for _ in range(r.randrange(5)):
            now[r.randrange(len(now))] = word()
        rows.append((i, " ".join(now)))
    rows += [(500, rows[0][1]), (501, "tiny text"), (502, "tiny text"), (503, None), (504, "")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(table(spark, rows)).collect()}
    assert got == components_of(rows, 4)
    assert 1 < len({c for _, c in got.values()}) < 120


def test_pairs_of_one_document_are_dealt_among_copies_of_its_set(spark, monkeypatch):
    monkeypatch.setattr(op5_superminhash, "PER_SET", 3)
    test_a_drifting_family_of_copies(spark)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        u = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
        k = int(r.integers(20, 280))
        a, b = np.sort(u[:k]), np.sort(u[k // 2 :])
        s = signatures([a, b])
        errors.append((s[0] == s[1]).mean() - (k - k // 2) / len(u))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


# --- 6 ---


def test_repeats_against_brute_force():
    r = random.Random(1)
    for _ in range(120):
        docs = []
        for _ in range(r.randint(1, 4)):
            v = r.choice([1, 2, 3, 20])
            w = [r.randrange(v) for _ in range(r.randint(1, 40))]
            docs.append(w + w[: r.randint(0, len(w))])
        want, cover = [], []
        for w in docs:
            n = len(w)
            best = [0] * n
            for i in range(n):
                for j in range(n):
                    k = 0
                    while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                        k += 1
                    best[i] = max(best[i], k)
            best = [x if x >= 8 else 0 for x in best]
            c = [False] * n
            for i in range(n):
                c[i : i + best[i]] = [True] * best[i]
            want += best
            cover += c
        lcp, covered = repeats(np.array([x for w in docs for x in w]), np.repeat(np.arange(len(docs)), [len(w) for w in docs]))
        assert lcp.tolist() == want and covered.tolist() == cover


def test_base_rules(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    block = " ".join(f"v{i}" for i in range(30))
    rows = [(1, clean), (2, " ".join(["a b c"] * 30)), (3, "short # text"), (4, f"{clean}\n{block}\n{block}\n \n{block}"), (5, "x y\n x y\nx y\n\n")]
    got = {r.doc_id: r for r in quality_rules(table(spark, rows)).collect()}
    assert got[1].kept and not got[1].base_failed and got[1].word_chars == len(clean) - 59
    assert got[2].base_failed and got[2].n_repeat_words == 90 and got[3].n_symbols == 1 and got[3].base_failed
    assert got[4].n_dup_lines == 2 and got[4].longest_repeat == 60 and not got[4].kept  # two blocks, repeated one block later
    assert got[5].n_dup_lines == 1


# --- 7 ---


def test_language_held_out_accuracy_and_und(spark, real):
    got = language_query(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    model = train(real.select("text", "lang"), max_training_docs=10)
    langs = [x for block in model.blocks() for x in block[0]]
    odd = table(spark, [(1, None), (2, "12 34"), (3, ""), (4, "und der die nicht"), (5, "日本")])
    pred = {r.doc_id: (r.lang_pred, r.score) for r in identify(odd, model).collect()}
    assert pred[1] == pred[2] == pred[3] == ("und", 0.0) and pred[4][0] == "de" and pred[5][0] in langs
    assert {r.lang_pred for r in identify(odd, train(real.select("text", "lang").limit(0))).collect()} == {"und"}


# --- 8 ---


def test_fitting_distance_against_brute_force():
    r = random.Random(2)

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(60):
        item, region = [r.randrange(4) for _ in range(r.randint(1, 7))], [r.randrange(4) for _ in range(r.randint(0, 10))]
        want = min(edit(item, region[a:b]) for a in range(len(region) + 1) for b in range(a, len(region) + 1))
        assert fitting_distance(np.array(item, np.uint64), np.array(region, np.uint64)) == want


def test_leaks_exact_edited_and_clean(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    r = random.Random(4)
    noise = lambda n: " ".join("q" + str(r.randrange(10**6)) for _ in range(n))
    edited = items[2].split()
    edited[3], edited[9] = "zz", "yy"
    rows = [(1, f"{noise(40)} {items[1]} {noise(9)}"), (2, f"{noise(5)} {' '.join(edited)}"), (3, noise(200)), (4, None), (5, ""), (6, items[1].upper()), (7, " ".join(items[3].split()[: len(items[3].split()) // 2]))]
    got = {x.doc_id: (x.contaminated, list(x["items"])) for x in find_leaks(table(spark, rows), bench.withColumn("doc_id", F.lit(1))).collect()}
    assert got == {1: (True, [1]), 2: (True, [2]), 3: (False, []), 4: (False, []), 5: (False, []), 6: (True, [1]), 7: (False, [])}
    assert not any(x.contaminated for x in find_leaks(table(spark, rows), bench.limit(0)).collect())
    assert find_leaks(table(spark, []), bench).count() == 0


def test_leak_recall_on_edits(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index, r = Index(bench), random.Random(6)
    docs, want = [], []
    for _ in range(400):
        item, w = index.items[r.randrange(len(index.items))]
        w = w.tolist()
        for _ in range(int(len(w) * 0.2 + 1e-9)):
            p, q = r.randrange(len(w)), r.random()
            if q < 0.34:
                w[p] = r.getrandbits(63)
            elif q < 0.67:
                del w[p]
            else:
                w.insert(p, r.getrandbits(63))
        noise = [r.getrandbits(63) for _ in range(60)]
        docs.append(np.array(noise[:25] + w + noise[25:], np.uint64))
        want.append(item)
    found = index.search(docs)
    assert np.mean([i in f for i, f in zip(want, found, strict=True)]) >= 0.99


def test_a_benchmark_in_blocks_gives_the_same(spark, real, monkeypatch):
    from provenir.llm import op8_cgk

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    one = sorted(repr(tuple(r)) for r in find_leaks(real, bench).collect())
    monkeypatch.setattr(op8_cgk, "BLOCK_BYTES", 3000)
    assert sorted(repr(tuple(r)) for r in find_leaks(real, bench).collect()) == one
    assert len(words("A-b, C")) == 3 and public_tokenizers


def test_orc_texts_are_python_strings_a_group_at_a_time(monkeypatch):
    import pyarrow as pa

    from provenir.llm import op2_orc

    words = ["alpha beta, gamma ", None, "delta\n", "", "één twee drie ", "x " * 3000]
    texts = [w and w * (i % 7) for i in range(60) for w in words]
    batch = pa.RecordBatch.from_arrays([pa.array([3] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["part", "doc_id", "text"])
    want = pa.Table.from_batches(op2_orc._arrays(iter([batch]), BYTE_BPE, 0)).combine_chunks()
    held, plain = [], op2_orc.strings
    monkeypatch.setattr(op2_orc, "strings", lambda column: held.append(plain(column)) or held[-1])
    monkeypatch.setattr(op2_orc, "GROUP_BYTES", 5000, raising=False)
    got = pa.Table.from_batches(op2_orc._arrays(iter([batch]), BYTE_BPE, 0)).combine_chunks()
    assert got == want and got.num_rows == len(texts)
    assert all(len(h) == 1 or sum(len(t.encode()) for t in h) <= 5000 for h in held) and [t for h in held for t in h] == [t or "" for t in texts]
