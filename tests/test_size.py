"""What a task holds and what is exchanged, at sizes that tests can reach: plans and forced small limits against the plain way."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from provenir import storage
from provenir.operators import blocks as B
from provenir.operators import evidence as EV
from provenir.operators import extraction as E
from provenir.operators import graph as G
from provenir.operators import names as N
from provenir.operators import reasoning as R
from provenir.operators import retrieval as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_times_without_an_exchange_of_them(spark):
    rnd = random.Random(3)
    texts = [(i, " ".join(str(rnd.randint(1880, 2110)) for _ in range(rnd.randint(0, 4)))) for i in range(200)]
    spans = {i: (rnd.choice([None, 1950, 1990]), rnd.choice([None, 1960, 2005])) for i in range(6)}
    times = spark.createDataFrame([(i, (a, b, "")) for i, (a, b) in spans.items()] + [(9, None)], "q long, time struct<from_year:int,to_year:int,reason:string>")
    got = R.blocks_of_times(spark.createDataFrame(texts, "block_id long, text string"), times, "block_id", "q")
    years = {i: {int(y) for y in t.split() if "1900" <= y <= "2099"} for i, t in texts}
    want = sorted((i, q) for i, ys in years.items() for q, (a, b) in spans.items() if any((a or 0) <= y <= (b or 9999) for y in ys))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "Exchange hashpartitioning(block_id" not in plan_of(got) and "Exchange hashpartitioning(_bin" not in plan_of(got)


def test_blocks_are_handed_on_a_group_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("some words; " * 40 * i) or None) for i in range(12)], "id long, text string").coalesce(1)
    key = docs.select(F.struct("id").alias("key"), "text")
    want = B.plain_blocks(key, "key", F.col("text")).collect()
    assert want == [((i,), n, *p) for i, t in docs.collect() for n, p in enumerate(B.split_plain((t or "").strip()), 1)]
    monkeypatch.setattr(B, "GROUP_CHARS", 1500)
    assert B.plain_blocks(key, "key", F.col("text")).collect() == want


def test_boxes_of_pages_without_an_exchange(spark):
    rnd = random.Random(8)
    item = lambda i: (i, "w" * rnd.randint(0, 9) + rnd.choice(["", ".", ";", "\n"]), float(rnd.randint(0, 99)), float(rnd.randint(0, 99)), float(rnd.randint(1, 9)), None if rnd.random() < 0.1 else 10.0)
    rows = [(d, 1, *item(i)) for d in range(5) for i in range(rnd.choice([0, 3, 900]))]
    items = spark.createDataFrame(rows, "id long, page int, i long, str string, x double, y double, width double, height double")
    texts = B.plain_blocks(B.page_texts(items, "id"), "id", F.col("text")).withColumn("page", F.lit(1))
    columns = ["id", "page", "n", "x", "y", "width", "height"]
    want = sorted(B.block_bounds(texts, B.item_offsets(items, "id"), "id").select(columns).collect())
    pages = storage.materialize(B.page_items(items, "id"))
    got = B.page_blocks(pages, "id")
    assert sorted(got.select(columns).collect()) == want and want
    assert "Exchange" not in plan_of(got)


def test_candidates_are_dealt_out_by_their_rows(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice(["Ann Lee", "Bob", "BOB", "uses", "acquired", "2001-02-03", "Carl"]) for _ in range(9))
    blocks = spark.createDataFrame([(i, i, text()) for i in range(80)], "pos long, block_id long, text string")

    def run():
        found = storage.materialize(E.mentions(blocks))
        evidence = storage.materialize(E.relation_evidence(blocks.select("block_id", "text"), found, E.entity_candidates(found)))
        return evidence, E.relation_candidates(evidence)

    assert "Exchange" not in plan_of(E.mentions(blocks))
    want = sorted(run()[1].collect())
    monkeypatch.setattr(storage, "TASK_ROWS", 25)
    evidence, relations = run()
    assert sorted(relations.collect()) == want and want
    assert "hashpartitioning(id#" in plan_of(relations) and f", {-(-evidence.count() // 25)})" in plan_of(relations)


def test_patterns_run_where_a_text_can_hold_them(spark):
    rnd = random.Random(12)
    words = ["HTTPS://a.B/c", "http:/x", "10.1234/ab-C", "10.12/ab", "IsBn 978-3-16-148410-0", "isbn-10: 0306406152", "9783161484100", "2001-02-03", "Ann", "Lee\u00a0", "Ünal", "ann"]
    blocks = spark.createDataFrame([(i, i, rnd.choice(["", None]) if i % 20 == 0 else rnd.choice([" ", "  ", "\t"]).join(rnd.choice(words) for _ in range(rnd.randint(1, 8)))) for i in range(120)], "pos long, block_id long, text string")

    def one(pattern, kind, keep):
        held = F.filter(F.regexp_extract_all("text", F.lit(pattern), 0), lambda n: n.rlike(keep))
        return F.transform(held, lambda n: F.struct(F.lit(kind).alias("type"), F.trim(n).alias("name")))

    each = F.concat(one(E.URL, "url", ""), one(E.DOI, "identifier", ""), one(E.ISBN, "identifier", "(?i)ISBN"))
    plain = blocks.select("block_id", F.explode(each).alias("c")).select("c.type", E.normalize_spaces(F.col("c.name")).alias("normalized"), "block_id").distinct()
    found = E.mentions(blocks)
    got = found.where("type in ('url', 'identifier')").select("type", "normalized", "block_id")
    assert sorted(got.collect()) == sorted(plain.collect()) and {r.type for r in plain.collect()} == {"url", "identifier"}
    assert "contains(text" in plan_of(found).lower()


def test_relations_meet_each_block_once(spark):
    rnd = random.Random(9)
    verbs = ["acquired", "partners with", "uses", "depends on", "works at", "was part of", "built", "reused", "useful", "and", "is  member of"]
    names = ["Ann Lee", "Bob", "Carl  Ray", "Dora", "Éva Sz", "BOB"]
    blocks = spark.createDataFrame([(i, i, " ".join(rnd.choice(names) + " " + rnd.choice(verbs) for _ in range(rnd.randint(0, 9)))) for i in range(60)], "pos long, block_id long, text string")
    found = storage.materialize(E.mentions(blocks))
    assert found.where(found.normalized != E.normalize_spaces(found["first"]["name"])).isEmpty()
    entities = E.entity_candidates(found)
    got = E.relation_evidence(blocks.select("block_id", "text"), found, entities)
    of = {(r.type, r.normalized): (r.id, r.name) for r in entities.collect()}
    held = {}
    for r in found.collect():
        held.setdefault(r.block_id, []).append(of[r.type, r.normalized])
    patterns = [(re.compile(r"(?<!\w)(?:" + p + r")(?!\w)", re.ASCII), v, c) for p, v, c in E.VERBS]
    want = {}
    for i, _, text in blocks.collect():
        low = text.lower()
        at = sorted((low.find(n.lower()), -len(n), e, n) for e, n in held.get(i, []) if n.lower() in low)[: E.PER_BLOCK]
        for k, (p, _, source, n) in enumerate(at):
            for _, _, target, other in at[k + 1 :]:
                b = low.find(other.lower(), p + len(n))
                if b >= 0:
                    between = low[p + len(n) : b][:120]
                    verb, confidence = next(((v, c) for x, v, c in patterns if x.search(between)), E.CO_MENTION)
                    key = (f"{source}::{verb}::{target}", i)
                    want[key] = max(want.get(key, 0), confidence)
    assert {(r.id, r.block_id): r.confidence for r in got.collect()} == want and len(want) > 100
    assert "Window" not in plan_of(got)


def test_scores_of_all_pairs_are_not_grouped_or_written(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, n)))
    blocks = spark.createDataFrame([(i, i % 2, t) for i in range(120) for t in [text(9)]] + [(200 + i, 0, "w1 w2 w3") for i in range(40)], "id long, scope int, body string")
    questions = spark.createDataFrame([(i, i % 2, text(6)) for i in range(9)] + [(50, 1, None)], "q long, scope int, question string")
    ask = lambda: V.bm25(questions, blocks, "q", "id", F.col("question"), F.col("body"), 5)
    tok = lambda t: set((t or "").split())
    want = []
    for q, scope, question in questions.collect():
        own = [(i, tok(t)) for i, s, t in blocks.collect() if s == scope]
        mean = sum(len(t) for _, t in own) / len(own)
        idf = {w: math.log(1 + (len(own) - n + 0.5) / (n + 0.5)) for w in words for n in [sum(w in t for _, t in own)] if n}
        raw = {i: sum(idf[w] for w in tok(question) & t) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / mean)) for i, t in own if tok(question) & t}
        ranked = sorted((-round(r / max(raw.values()), 6), i) for i, r in raw.items())[:5]
        want += [(q, i, -s, k) for k, (s, i) in enumerate(ranked, 1)]
    written = []
    keep = V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, name="table": written.append((name, keep(df, name))) or written[-1][1])
    for cells, sent in ((1 << 22, 1 << 20), (30, 8)):
        monkeypatch.setattr(V, "CELLS", cells)
        monkeypatch.setattr(V, "SENT_TERMS", sent)
        assert sorted(tuple(r) for r in ask().collect()) == sorted(want)
    scores = [df for name, df in written if name == "scores"][0]
    assert scores.where("ident >= 200" if "ident" in scores.columns else "id >= 200").groupBy("q").count().where("count > 20").isEmpty()


def test_weighted_scores_of_all_pairs_are_not_exchanged(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(9)] + ["longword"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, n))) or None
    rows = [(i, text(1), text(1), text(7)) for i in range(90)] + [(200 + i, "w1", None, "w2 w3") for i in range(40)]
    asked = [(i, text(5)) for i in range(12)] + [(50, "w1 absent"), (51, "longword"), (52, "absent")]
    blocks = spark.createDataFrame(rows, "ident long, title string, heading string, text string")
    questions = spark.createDataFrame(asked, "question_id long, question string")
    holds = lambda w, *texts: any(w in (t or "") for t in texts)
    want = []
    for q, question in asked:
        own = set((question or "").split())
        idf = {w: math.log((len(rows) + 1) / (sum(holds(w, title, body) for _, title, _, body in rows) + 1)) + 1 for w in own}
        scores = []
        for i, title, heading, body in rows:
            hit = {w for w in own if holds(w, title, heading, body)}
            cover, titles, heads = sum(idf[w] for w in hit) / (sum(idf.values()) or 1), sum(holds(w, title) for w in hit), sum(holds(w, heading) for w in hit)
            if hit and (titles or heads or round(cover, 9) >= 0.24 or len(hit) == 1 and max(idf[w] for w in hit) >= 1.45 and max(map(len, hit)) >= 5):
                scores.append((-round(min(1, cover * 0.78 + min(titles * 0.12, 0.18) + min(heads * 0.06, 0.1)), 6), i, len(hit)))
        want += [(q, i, -s, m, k) for k, (s, i, m) in enumerate(sorted(scores)[:4], 1)]
    keep, written = V.materialize, {}
    monkeypatch.setattr(V, "materialize", lambda df, name="table": written.setdefault(name, keep(df, name)))
    for cells, pairs, sent in ((1 << 22, 1 << 20, 1 << 20), (300, 20, 10)):
        for name, value in (("CELLS", cells), ("PAIRS", pairs), ("SENT_TERMS", sent)):
            monkeypatch.setattr(V, name, value)
        got = V.weighted_lexical(questions, blocks, 4)
        assert sorted(tuple(r) for r in got.select("question_id", "ident", "score", "matched", "rnk").collect()) == sorted(want) and want
        assert written["scores"].groupBy("question_id").count().where("count > 60").isEmpty()
        written.clear()


def test_names_are_found_in_distinct_pieces_and_not_exchanged(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda a, b: "".join(rnd.choice("abé#\n😀") for _ in range(rnd.randint(a, b)))
    texts = [" ".join(word(0, 7) for _ in range(rnd.randint(0, 60))) for _ in range(50)] + ["", " ", None]
    names = sorted({word(1, 4) for _ in range(60)})
    searched = []
    known = N.strings_known
    monkeypatch.setattr(N, "strings_known", lambda group, *a: searched.extend(group) or known(group, *a))
    assert list(N.strings_in_pieces(["aa bb", "bb aa bb"], np.full(2048, 0xFFFFFFFF, np.uint32), [2])[0]) == [0, 0, 1, 1] and searched == ["aa", "bb"]
    t = spark.createDataFrame(list(enumerate(texts)), "ident long, text string")
    for size in (4 << 20, 100):
        monkeypatch.setattr(N, "PIECES_BYTES", size)
        got = N.find_names(t, spark.createDataFrame([(n,) for n in names], "called string"), once=True)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == {(i, n) for i, x in enumerate(texts) for n in names if x and n in x}
    assert "Exchange hashpartitioning(ident" not in plan_of(got)


def test_questions_meet_names_without_a_bitmap_of_all_names(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab é#") for _ in range(rnd.randint(0, 6)))
    names = spark.createDataFrame([(i, word()) for i in range(300)] + [(300, None)], "id long, called string")
    texts = spark.createDataFrame([(i, " ".join(word() for _ in range(9))) for i in range(20)] + [(20, None), (21, "")], "q long, text string")
    want = sorted(tuple(r) for r in N.find_names(texts, names, "q").join(names, "called").select("q", "id", "called").collect())
    seen = []
    bitmap_of = N.bitmap_of
    monkeypatch.setattr(N, "bitmap_of", lambda known: seen.append(1) or bitmap_of(known))
    got = lambda t: sorted(tuple(r) for r in N.name_rows(t, names, "q").select("q", "id", "called").collect())
    assert got(texts) == want and want and not seen
    assert got(texts.where("q = 20")) == [] == got(texts.where("q > 99")) and not seen
    monkeypatch.setattr(N, "FEW_STRINGS", 100)
    assert got(texts) == want and seen


def test_proofs_walk_once_and_only_between_anchors(spark, monkeypatch):
    rnd = random.Random(6)
    relations = [(i, f"n{rnd.randint(0, 9)}", f"n{rnd.randint(0, 9)}", "accepted", [f"b{i}"], f"{rnd.randint(1990, 1999)}", None, None) for i in range(25)]
    relations += [(100 + i, f"leaf|{i}", "n1", "accepted", ["b"], "1995", None, None) for i in range(40)] + [(90, "n0", "n7", "rejected", ["b"], "1995", None, None)]
    schema = "pos long, source string, target string, status string, evidence array<string>, observed_at string, valid_from string, valid_to string"
    years = {1: None, 2: (1992, 1996), 3: None, 4: (None, 1994), 5: (1999, 1991)}
    asked = [(q, ["n0", "leaf|3", "n4", "n8"][: 2 + q % 3], y and (*y, "")) for q, y in years.items()]
    routed = spark.createDataFrame(asked, "question_id long, anchor_ids array<string>, time struct<from_year:int,to_year:int,reason:string>")
    table = spark.createDataFrame(relations, schema)

    def first(source, target, usable):  # a queue that scans relations in order
        queue, seen = [(source, [], [source])], {source}
        for node, path, nodes in queue:
            if node == target:
                return path, nodes
            for pos, a, b in usable if len(path) < 4 else []:
                for u, v in ((a, b), (b, a)):
                    if u == node and v not in seen:
                        seen.add(v)
                        queue.append((v, [*path, pos], [*nodes, v]))

    want = []
    for q, ids, time in asked:
        low, high = (time[0] or 0, time[1] or 9999) if time else (0, 9999)
        usable = [(r[0], r[1], r[2]) for r in relations if r[3] == "accepted" and low <= int(r[5]) <= high]
        for i, s in enumerate(ids):
            want += [(q, s, t, *p) for t in ids[i + 1 :] if (p := first(s, t, usable))]
    calls, walk = [], R.shortest_paths
    monkeypatch.setattr(R, "shortest_paths", lambda pairs, rows, hops: calls.append(rows.count()) or walk(pairs, rows, hops))
    got = R.proofs(routed, table).select("question", "source", "target", "path", "nodes")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want
    assert len(calls) == 1 and calls[0] <= 3 * 26  # leaves that nobody asks for aren't walked


def test_rows_of_one_row_group_are_dealt_into_tasks(spark, monkeypatch):
    from provenir.sources import derived as D

    plain = D.notes(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(storage, "SCAN_ROWS", 40)
    got = D.notes(spark, "/root/testdata/sf0.001")
    assert sorted(got.collect()) == sorted(plain)
    tasks = got.where("id LIKE 'c%'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 1 and max(t.n for t in tasks) <= 80


def test_graph_plan_counts_steps_for_its_hits_only(spark, monkeypatch):
    names = ["Hub one", *[f"Leaf {i}" for i in range(6)], "Chain a", "Chain b", "Chain c", "Chain d"]
    links = [(f"Leaf {i}", "Hub one") for i in range(6)] + [("Hub one", "Chain a"), ("Chain a", "Chain b"), ("Chain b", "Chain c"), ("Chain c", "Chain d"), ("Leaf 1", "Leaf 1")]
    notes = spark.createDataFrame([(i, f"i{i}", n, "rare words " + " ".join(f"[[{b}]]" for a, b in links if a == n)) for i, n in enumerate(names)], "pos long, id string, title string, markdown string")
    near = {n: {b for a, b in links if a == n} | {a for a, b in links if b == n} for n in names}
    level, steps = {"Leaf 3"}, {"Leaf 3": 0}
    for k in (1, 2, 3):
        level = {b for a in level for b in near[a]} - set(steps)
        steps |= dict.fromkeys(level, k)
    monkeypatch.setattr(G, "neighbourhood", None)
    got = EV.graph_plan(spark.createDataFrame([(1, "rare words of leaf 3")], "question_id long, question string"), notes, G.authored_edges(notes), 20).collect()
    assert {r.ident: r.hops for r in got} == {f"i{i}": steps.get(n) for i, n in enumerate(names)}
