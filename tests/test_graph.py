"""Paths, sweeps and components against plain Python on seeded random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from provenir.operators import graph as G
from provenir.operators.components import connected_components


def random_relations(seed, n=14, m=26):
    r = random.Random(seed)
    return [(p, f"e{r.randrange(n)}", f"e{r.randrange(n)}") for p in range(m)]


def bfs(source, target, relations, hops=4):
    if source == target:
        return []
    queue, seen = deque([(source, [])]), {source}
    while queue:
        node, path = queue.popleft()
        if len(path) >= hops:
            continue
        for p, a, b in relations:
            nxt = b if a == node else a if b == node else None
            if nxt is None or nxt in seen:
                continue
            if nxt == target:
                return [*path, p]
            seen.add(nxt)
            queue.append((nxt, [*path, p]))
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_path_is_the_one_a_queue_finds(spark, seed):
    relations = random_relations(seed)
    pairs = [(0, f"e{a}", f"e{b}") for a in range(0, 14, 3) for b in range(14)]
    found = G.shortest_paths(spark.createDataFrame(pairs, "question int, source string, target string"), spark.createDataFrame(relations, "pos long, source string, target string"))
    got = {(r.source, r.target): list(r.path) for r in found.collect()}
    for _, a, b in pairs:
        assert got.get((a, b)) == bfs(a, b, relations), (a, b)


@pytest.mark.parametrize("hops", [1, 2, 3, 4, 5])
def test_paths_of_many_pairs_around_hubs(spark, hops):
    """Two hubs, parallel relations, repeated and absent pairs, ends that no relation knows: as a queue finds them."""
    r = random.Random(hops)
    relations = [(p, r.choice(["hub", "mid", f"e{r.randrange(40)}"]), f"e{r.randrange(40)}") for p in range(70)]
    relations += [(70 + i, a, b) for i, (_, a, b) in enumerate(relations[:20])]
    nodes = ["hub", "mid", "nowhere", *(f"e{i}" for i in range(40))]
    pairs = [(q, r.choice(nodes), r.choice(nodes)) for q in range(3) for _ in range(80)] + [(0, "e1", t) for t in nodes] + [(0, "e1", "e2")] * 2 + [(1, None, "e1")]
    found = G.shortest_paths(spark.createDataFrame(pairs, "question int, source string, target string"), spark.createDataFrame(relations, "pos long, source string, target string"), hops).collect()
    got = {(x.question, x.source, x.target): list(x.path) for x in found}
    assert len(got) == len(found)
    for q, a, b in pairs:
        assert got.get((q, a, b)) == (bfs(a, b, relations, hops) if a else None), (a, b)
    ends = {p: {a, b} for p, a, b in relations}
    for x in found:
        assert x.nodes[0] == x.source and x.nodes[-1] == x.target and [ends[p] for p in x.path] == [set(y) for y in zip(x.nodes, x.nodes[1:])]


def test_a_search_is_shared_by_all_targets_of_its_source(spark, monkeypatch):
    written = []
    keep = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: written.append((name, t := keep(df, name))) or t)
    relations = spark.createDataFrame([(i, "hub", f"e{i}") for i in range(200)], "pos long, source string, target string")
    for n in (1, 150):
        written.clear()
        found = G.shortest_paths(spark.createDataFrame([(0, "e0", f"e{i + 1}") for i in range(n)], "question int, source string, target string"), relations).collect()
        assert len(found) == n and all(len(x.path) == 2 for x in found)
        assert [t.count() for name, t in written if name == "frontier"] == [1, n]  # the hub, and the hub again from each target: never 200 for each pair
    assert G.shortest_paths(spark.createDataFrame([], "question int, source string, target string"), relations).count() == 0


def test_a_hub_is_not_unrolled_for_pairs_without_a_path(spark, monkeypatch):
    written = []
    keep = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: written.append((name, t := keep(df, name))) or t)
    relations = [(i, f"e{i}", "hub") for i in range(300)] + [(300, "hub", "root"), (301, "x", "other"), (302, "y", "other"), (303, "z", "y"), (304, "z", "x")]
    pairs = [(0, f"e{i}", t) for i in range(100) for t in ("root", "other")] + [(1, t, f"e{i}") for i in range(100) for t in ("root", "other")]
    found = G.shortest_paths(spark.createDataFrame(pairs, "question int, source string, target string"), spark.createDataFrame(relations, "pos long, source string, target string")).collect()
    assert sorted((x.source, x.target) for x in found) == sorted([(f"e{i}", "root") for i in range(100)] + [("root", f"e{i}") for i in range(100)])
    assert sum(t.count() for name, t in written if name == "frontier") < 1500  # 100 ends times 300 leaves otherwise


def shuffled_rows(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_neighbours_through_a_hub_are_not_shuffled(spark):
    edges = spark.createDataFrame([(f"e{i}", h) for i in range(300) for h in ("hub", f"hub{i % 2}")], "source string, target string")
    before = shuffled_rows(spark)
    found = {(r.start, r.node): r.hops for r in G.neighbourhood(spark.createDataFrame([(f"e{i}",) for i in range(100)], "start string"), edges, 2).collect()}
    assert found == {(f"e{i}", f"e{j}"): 0 if i == j else 2 for i in range(100) for j in range(300)} | {(f"e{i}", h): 1 for i in range(100) for h in ("hub", f"hub{i % 2}")}
    assert shuffled_rows(spark) - before < 15_000  # of 30,000 neighbours, half of them twice


@pytest.mark.parametrize("few", [2, 4, 64])
def test_neighbourhoods_of_any_depth(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    monkeypatch.setattr(G, "TASK_ROWS", 8)
    edges = [(a, b) for _, a, b in random_relations(few, n=40, m=45)]
    beside = {}
    for a, b in edges:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    starts = [f"e{i}" for i in range(0, 40, 3)] + ["nowhere"]
    got = [tuple(r) for r in G.neighbourhood(spark.createDataFrame([(s,) for s in starts], "start string"), spark.createDataFrame(edges, "source string, target string"), 3).select("start", "node", "hops").collect()]
    expected = []
    for s in starts:
        hops, last = {s: 0}, {s}
        for hop in (1, 2, 3):
            last = {v for u in last for v in beside.get(u, ())} - hops.keys()
            hops |= dict.fromkeys(last, hop)
        expected += [(s, n, h) for n, h in hops.items()]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("seed", [3, 4])
def test_two_sweeps_reach_what_a_growing_set_reaches(spark, seed):
    relations = random_relations(seed, n=30, m=24)
    starts = [(q, f"e{q * 3}") for q in range(6)]
    got = {}
    for r in G.swept(spark.createDataFrame(starts, "question_id long, id string"), spark.createDataFrame(relations, "pos long, source string, target string")).collect():
        got.setdefault(r.question_id, set()).add(r.id)
    for q, s in starts:
        reached = {s}
        for _ in range(2):
            for _, a, b in relations:
                if a in reached or b in reached:
                    reached |= {a, b}
        assert got[q] == reached


def test_components_of_a_long_chain_and_lone_pairs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1003, 1001), (2000, 2000)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0}
    assert got[1003] == got[1001] == got[1000] == 1000
    assert 2000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_communities_keep_lone_entities(spark):
    entities = spark.createDataFrame([("a", "A", "accepted", None), ("b", "B", "accepted", None), ("c", "C", "accepted", None), ("d", "D", "pending", None)], "id string, name string, status string, merged_into string")
    relations = spark.createDataFrame([("a", "b", "accepted"), ("b", "d", "accepted"), ("b", "c", "rejected")], "source string, target string, status string")
    got = {r.id: (r.community, r.size, r.idx) for r in G.communities(entities, relations).collect()}
    assert got == {"a": ("a", 2, 0), "b": ("a", 2, 0), "c": ("c", 1, 1)}


def test_ambiguous_title_stays_unresolved(spark):
    notes = spark.createDataFrame([(1, "x", "Same", ""), (2, "y", "same ", ""), (3, "z", "Z", "[[Same]] and [[z|me]]")], "pos long, id string, title string, markdown string")
    got = {(r.title, r.target, r.resolved) for r in G.authored_edges(notes).collect()}
    assert got == {("Same", "unresolved:same", False), ("z", "z", True)}


def test_relation_years_close_an_open_end(spark):
    df = spark.createDataFrame([("2001-05", None, "1999"), (None, "2005", "1999-01-01"), (None, None, "x")], "f string, t string, o string")
    a, b = G.relation_years(F.col("f"), F.col("t"), F.col("o"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(2001, 2001), (1999, 2005), (None, None)]
