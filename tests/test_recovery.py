"""Trash, canvases, snapshots, and undoing merges and splits."""

import pytest
from pyspark.sql import functions as F

from provenir.operators import graph as G
from provenir.operators import recovery as RC
from provenir.operators import review as RV
from provenir.operators import workspace as W

NOTES = "id string, title string, markdown string"
CANVAS = f"id string, nodes {RC.NODES}, edges {RC.EDGES}"
ENTITY = "id string, name string, status string, merged_into string, aliases array<string>, evidence array<string>"
RELATION = "id string, source string, target string, relation string, status string, evidence array<string>, confidence double, observed_at string, valid_from string, valid_to string"


def plain(df, key="id"):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: str(r[key]))


def canvases(spark):
    node = lambda i, kind, ref: (i, kind, ref, 1.0, 2.0)
    return spark.createDataFrame(
        [("k", [node("1", "note", "a"), node("2", "note", "b"), node("3", "text", None)], [("e", "1", "2"), ("f", "2", "3")]), ("l", [node("4", "note", "b")], []), ("m", [], [])], CANVAS
    )


def test_a_trashed_note_comes_back_with_its_places(spark):
    notes = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], NOTES)
    gone = spark.createDataFrame([("a",), ("zz",)], "id string")
    rest, bare, trash = RC.trash_notes(notes, canvases(spark), gone)
    assert [r["id"] for r in plain(rest)] == ["b"] and [r["id"] for r in plain(trash)] == ["a"]
    k = plain(bare)[0]
    assert [n["id"] for n in k["nodes"]] == ["2", "3"] and [e["id"] for e in k["edges"]] == ["f"]
    again, back, left = RC.restore_notes(rest, bare, trash, gone)
    assert plain(again) == plain(notes) and left.count() == 0
    for x, y in zip(plain(back), plain(canvases(spark)), strict=True):
        assert sorted(map(repr, x["nodes"])) == sorted(map(repr, y["nodes"])) and sorted(map(repr, x["edges"])) == sorted(map(repr, y["edges"]))


def test_canvases_as_json_without_dangling_edges(spark):
    rows = RC.canvas_json(canvases(spark)).select("json").unionByName(spark.createDataFrame([('{"id":"z","nodes":[],"edges":[{"id":"e","source":"1","target":"2"}]}',), ("nonsense",)], "json string"))
    good, refused = RC.canvas_from_json(rows)
    assert plain(good) == plain(canvases(spark)) and refused.count() == 2


def entities(spark):
    return spark.createDataFrame([("p", "Prime", "accepted", None, ["pp"], ["1"]), ("s", "Second", "accepted", None, [], ["2", "3"]), ("t", "Third", "pending", None, [], ["4"])], ENTITY)


def relations(spark):
    row = lambda a, b, ev, status="accepted": (f"{a}::r::{b}", a, b, "r", status, [ev], 0.5, "2001-01-01", None, None)
    return spark.createDataFrame([row("p", "t", "1"), row("s", "t", "2", "pending"), row("s", "p", "3"), row("t", "s", "4")], RELATION)


def test_a_merge_taken_back_leaves_everything_as_it_was(spark):
    merges = spark.createDataFrame([(1, "s", "p")], "seq long, old string, new string")
    logged = RV.merge_log(entities(spark), relations(spark), merges)
    mapping = merges.select("old", "new")
    e, r = RV.merge_entities(entities(spark), mapping), RV.merge_relations(relations(spark), mapping).select(relations(spark).columns)
    assert {x["id"] for x in plain(r)} == {"p::r::t", "t::r::p"} and plain(e)[1]["merged_into"] == "p"
    assert plain(r)[0]["status"] == "pending" and sorted(plain(r)[0]["evidence"]) == ["1", "2"]
    back_e, back_r = RV.undo_merges(e.select(entities(spark).columns), r, logged, merges.select("seq"))
    assert plain(back_e) == plain(entities(spark)) and plain(back_r) == plain(relations(spark))
    same_e, same_r = RV.undo_merges(e.select(entities(spark).columns), r, logged, merges.select("seq").limit(0))
    assert plain(same_e) == plain(e.select(entities(spark).columns)) and plain(same_r) == plain(r)


def test_a_split_taken_back(spark):
    splits = spark.createDataFrame([("s", "s2", "New", ["2"])], "id string, new_id string, new_name string, moved array<string>")
    after, refused = RV.split_entities(entities(spark), splits)
    assert after.count() == 4 and refused.count() == 0
    assert plain(RV.undo_splits(after, entities(spark), splits)) == plain(entities(spark))


def test_pins_targets_and_twins(spark):
    pinned = entities(spark).withColumn("pinned", F.lit(False))
    decisions = spark.createDataFrame([(1, "p", True), (2, "p", False), (3, "s", True)], "seq long, id string, pinned boolean")
    assert {r["id"]: r["pinned"] for r in plain(RV.pin(pinned, decisions))} == {"p": False, "s": True, "t": False}
    asked = spark.createDataFrame([("p",), ("  SECOND ",), ("none",)], "asked string")
    assert {r["asked"]: r["id"] for r in plain(RV.merge_target(entities(spark), asked), "asked")} == {"p": "p", "  SECOND ": "s"}
    known, model = spark.createDataFrame([("topic", "Ann  Lee")], "type string, name string"), spark.createDataFrame([("topic", "ann lee", 1), ("date", "ann lee", 2)], "type string, name string, k int")
    assert [r["k"] for r in plain(RV.twins(model, known), "k")] == [2]


def test_snapshots_and_their_rules(spark, tmp_path):
    tables = {"notes": spark.createDataFrame([("a", "A", "x")], NOTES), "entities": entities(spark), "relations": relations(spark), "embeddings": entities(spark)}
    RC.save(tables, f"file://{tmp_path}/good")
    got = RC.restore(spark, f"file://{tmp_path}/good", ["notes", "entities", "relations"])
    assert plain(got["relations"]) == plain(relations(spark)) and not (tmp_path / "good" / "embeddings").exists()
    RC.save(tables | {"entities": entities(spark).where("id <> 't'")}, f"file://{tmp_path}/bad")
    with pytest.raises(ValueError, match="relation without target"):
        RC.restore(spark, f"file://{tmp_path}/bad", ["notes", "entities", "relations"])


def test_daily_notes_and_templates(spark):
    notes = spark.createDataFrame([("x", "daily 2024-01-02", "old")], NOTES)
    days = spark.sql("SELECT explode(array(date'2024-01-02', date'2024-01-03', date'2024-01-03')) day")
    got = plain(W.daily_notes(notes, days, F.lit("# {{title}} on {{date}} {{other}}")), "title")
    assert [(r["title"], r["markdown"]) for r in got] == [("Daily 2024-01-03", "# Daily 2024-01-03 on 2024-01-03 {{other}}"), ("daily 2024-01-02", "old")]
    templates = spark.createDataFrame([("t", "T", "body"), ("u", "U", "b")], "id string, title string, body string")
    changes = spark.createDataFrame([(1, "t", " New ", None), (2, "u", " ", None), (3, "v", "V", "text"), (4, "w", "W", " ")], "seq long, id string, title string, body string")
    kept, refused = W.put_templates(templates, changes)
    assert [tuple(r.values()) for r in plain(kept)] == [("t", "New", "body"), ("u", "U", "b"), ("v", "V", "text")] and [r["id"] for r in plain(refused)] == ["u", "w"]
    s = spark.createDataFrame([(["a", "b"], ["b", "a"], "b")], "o array<string>, r array<string>, a string").select(W.forget(F.col("o"), F.col("r"), F.col("a"), F.lit("b")).alias("f"), W.opened_with(F.col("o"), F.lit("a"), 1).alias("g")).first()
    assert (s.f.opened, s.f.recent, s.f.active, s.g) == (["a"], ["a"], "a", ["b"])


def test_a_chain_of_100_relations_in_falling_order_is_swept(spark):
    n = 100
    rows = [(n - i, f"v{i}", f"v{i + 1}") for i in range(n)] + [(n + 1 + i, f"u{i}", f"u{i + 1}") for i in range(n)]
    starts = spark.createDataFrame([(1, "v0"), (1, "u0"), (2, f"v{n}")], "question_id long, id string")
    got = {(r.question_id, r.id) for r in G.swept(starts, spark.createDataFrame(rows, "pos long, source string, target string")).collect()}
    want = {(1, f"u{i}") for i in range(n + 1)} | {(1, f"v{i}") for i in range(3)} | {(2, f"v{i}") for i in range(n + 1)}
    assert got == want
