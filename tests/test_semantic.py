"""Semantic links over the whole table: recall, hot groups, equal and odd vectors, suggestions that keep their reviews."""

import math

import numpy as np
import pytest

from provenir.operators import semantic as S

VECTORS = "ident long, vector array<double>, score string, at string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", "a") for i, v in vectors], VECTORS)


def unit_pairs(rnd, n, dim, cos):
    """n pairs of unit vectors with the given cosine."""
    a = rnd.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rnd.standard_normal((n, dim))
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    return a, cos * a + math.sqrt(1 - cos * cos) * r


def brute(vectors, threshold):
    """Links between the least idents of different vectors."""
    first = {}
    for i, v in vectors:
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            first[tuple(map(float, v))] = min(i, first.get(tuple(map(float, v)), i))
    out = {}
    for size in {len(v) for v in first}:
        keys = [v for v in first if len(v) == size]
        m = np.array(keys)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        cos = np.round(m @ m.T, 6)
        for x, y in zip(*np.nonzero(np.triu(cos >= threshold, 1)), strict=True):
            a, b = first[keys[x]], first[keys[y]]
            out[min(a, b), max(a, b)] = cos[x, y]
    return out


@pytest.fixture(scope="module")
def mixed():
    """Pairs at and above the threshold, a hot group of near copies, copies, and vectors that are odd."""
    rnd = np.random.default_rng(5)
    near, far = unit_pairs(rnd, 250, 24, 0.73), unit_pairs(rnd, 40, 24, 0.9)
    hot = rnd.standard_normal(24) * 3 + rnd.standard_normal((150, 24)) * 0.2
    rows = np.concatenate([*near, *far, hot, hot[:20], near[0][:5], rnd.standard_normal((100, 24))])
    vectors = list(enumerate(rows.tolist()))
    vectors += [(5000, None), (5001, [0.0] * 24), (5002, []), (5003, [math.nan, 1.0]), (5004, [None, 1.0]), (5005, [1.0, 2.0]), (5006, [2.0, 4.1]), (5007, [0.0] * 24), (5008, [math.inf, 1.0])]
    return vectors


@pytest.mark.parametrize("bucket", [16, 2048])
def test_links_are_those_of_brute_force_and_counts_agree(spark, mixed, bucket):
    want = brute(mixed, 0.72)
    rows = S.semantic_links(table(spark, mixed), 0.72, bucket=bucket).collect()
    got = {(r.a, r.b): r.score for r in rows}
    assert len(rows) == len(got) and set(got) <= set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    edge = {k for k, s in want.items() if s < 0.75}
    assert len(edge & set(got)) >= 0.95 * len(edge) > 200
    assert len(got) == len(want) if bucket == 2048 else len(got) > 0.99 * len(want)

    size, classes = {}, {r.ident: r.class_id for r in S.vector_classes(table(spark, mixed)).collect()}
    for c in classes.values():
        size[c] = size.get(c, 0) + 1
    n = {c: 0 for c in size}
    for a, b in got:
        n[a] += size[b]
        n[b] += size[a]
    counts = S.link_counts(table(spark, mixed), 0.72, bucket=bucket).collect()
    odd = {5001, 5002, 5003, 5004, 5007, 5008}
    assert {r.ident: (r.class_id, r.class_size, r.n_links) for r in counts} == {i: (c, size[c], 0 if c in odd else n[c] + size[c] - 1) for i, c in classes.items()} and len(counts) == len(mixed) - 1


def test_recall_holds_with_many_bits_at_the_least_threshold(spark):
    a, b = unit_pairs(np.random.default_rng(6), 600, 48, 0.505)
    vectors = list(enumerate(np.concatenate([a, b]).tolist()))
    bits, tables = S.link_plan(1200, 0.5, 0.95, 40)
    assert bits == 4 and tables > 10
    got = {(r.a, r.b) for r in S.semantic_links(table(spark, vectors), 0.5, recall=0.95, bucket=40).collect()}
    assert sum((i, i + 600) in got for i in range(600)) >= 0.92 * 600


def test_tables_are_used_only_where_they_save_products(spark):
    for n in (5_000, 20_000, 120_000, 400_000):  # tables of 2, 4, 16 and 64 buckets would be as many
        assert S.link_plan(n, 0.5, 0.999) == (0, 1)
    bits, tables = S.link_plan(10_000_000, 0.72, 0.98)
    assert 1 << bits > tables > 1
    vectors = list(enumerate(np.random.default_rng(8).standard_normal((400, 8)).tolist()))
    classes = S.vector_classes(table(spark, vectors)).select("class_id", "class_size", "vector")
    rows, used = S._met(classes, 0.5, 0.999, 100, 1)
    assert used == 1 and rows.count() <= 400 * 6  # each with the tiles of one bucket
    assert rows.where("size(signs) <> at").count() == 0


def test_no_vectors_no_links(spark):
    for rows in ([], [(1, None)], [(1, [1.0])], [(1, [1.0]), (2, [1.0])]):
        assert S.semantic_links(table(spark, rows)).collect() == []
        assert [r.n_links for r in S.link_counts(table(spark, rows)).collect()] == [len(rows) - 1] * sum(v is not None for _, v in rows)


def test_suggestions_take_accepted_entities_and_keep_reviews_of_their_version(spark):
    rows = [
        ("b", "accepted", None, False, ["1", "2"], [1.0, 0.0]),
        ("a", "accepted", None, None, ["3", "2"], [1.0, 0.1]),
        ("p", "accepted", None, True, ["9"], [1.0, 0.2]),
        ("r", "rejected", None, False, ["4"], [1.0, 0.3]),
        ("m", "accepted", "b", False, ["5"], [1.0, 0.4]),
        ("w", "accepted", None, False, ["6"], [-1.0, 0.0]),
    ]
    e = spark.createDataFrame(rows, "id string, status string, merged_into string, pinned boolean, evidence array<string>, vector array<double>")
    none = spark.createDataFrame([], "id string, version string, status string")
    first = S.suggest_links(e, none, "m1", "1")
    got = {r.id: r for r in first.collect()}
    assert set(got) == {"semantic::a::b::m1", "semantic::a::p::m1", "semantic::b::p::m1"} and {r.status for r in got.values()} == {"pending"}
    assert got["semantic::a::b::m1"].evidence == ["3", "2", "1"] and got["semantic::a::p::m1"].evidence == ["9", "3", "2"]
    decisions = spark.createDataFrame([(1, "semantic::a::b::m1", "rejected"), (2, "semantic::a::b::m1", "accepted"), (3, "semantic::a::p::m1", "rejected"), (4, "zz", "accepted")], "seq long, id string, status string")
    reviewed, refused = S.review_links(first, decisions)
    assert [r.seq for r in refused.collect()] == [4]
    again = {r.id: r.status for r in S.suggest_links(e, reviewed, "m1", "1").collect()}
    assert again == {"semantic::a::b::m1": "accepted", "semantic::a::p::m1": "rejected", "semantic::b::p::m1": "pending"}
    assert {r.status for r in S.suggest_links(e, reviewed, "m1", "2").collect()} == {"pending"}
