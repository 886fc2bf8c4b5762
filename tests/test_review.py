import random

from pyspark.sql import functions as F

from provenir.operators import review as RV
from provenir.operators import semantic as S
from provenir.operators import verify as VF
from provenir.operators import workspace as W

ENTITY = "id string, name string, status string, merged_into string, aliases array<string>, evidence array<string>"


def test_merge_moves_names_and_evidence(spark):
    e = spark.createDataFrame([("a", "A", "accepted", None, ["x"], ["1"]), ("b", "B", "pending", None, ["y"], ["1", "2"])], ENTITY)
    got = {r.id: r for r in RV.merge_entities(e, spark.createDataFrame([("b", "a")], "old string, new string")).collect()}
    assert got["a"].aliases == ["x", "B", "y"] and got["a"].evidence == ["1", "2"] and got["a"].status == "accepted"
    assert (got["b"].status, got["b"].merged_into) == ("rejected", "a")


def test_chains_of_merges_lead_to_their_end(spark):
    chain = [(f"e{i:03}", f"e{i + 1:03}") for i in range(90)] + [("x", "y"), ("y", "x"), ("p", "x"), ("q", "r"), (None, "r")]
    got = {r.old: r.new for r in RV.resolve_merges(spark.createDataFrame(chain, "old string, new string")).collect()}
    assert got == {f"e{i:03}": "e090" for i in range(90)} | {"q": "r"}
    e = spark.createDataFrame([(k, k.upper(), "accepted", None, [], [k]) for k in "abc"], ENTITY)
    after = {r.id: r for r in RV.merge_entities(e, RV.resolve_merges(spark.createDataFrame([("a", "b"), ("b", "c")], "old string, new string"))).collect()}
    assert after["c"].evidence == ["c", "a", "b"] and after["a"].merged_into == after["b"].merged_into == "c"


def test_several_decisions_and_splits_of_one_id(spark):
    e = spark.createDataFrame([("a", "A", "accepted", None, [], ["1", "2", "3"]), ("b", "B", "accepted", None, [], [])], ENTITY)
    r = spark.createDataFrame([("1", "a", "b", "pending", ["x"])], "id string, source string, target string, status string, evidence array<string>")
    decisions = spark.createDataFrame([(1, "1", "accepted"), (2, "1", "rejected"), (3, "9", "accepted")], "seq long, id string, status string")
    after, refused = RV.review_relations(r, decisions, e)
    assert [(x.id, x.status) for x in after.collect()] == [("1", "rejected")] and [(x.id, x.reason) for x in refused.collect()] == [("9", "unknown")]
    splits = spark.createDataFrame([("a", "n1", "N", ["1"]), ("a", "n2", "M", ["2"])], "id string, new_id string, new_name string, moved array<string>")
    after, refused = RV.split_entities(e, splits)
    assert sorted(x.id for x in after.collect()) == ["a", "b", "n1"] and [x.new_id for x in refused.collect()] == ["n2"]


def test_split_moves_some_but_not_all(spark):
    e = spark.createDataFrame([("a", "A", "accepted", None, ["x"], ["1", "2", "3"])], ENTITY)
    splits = spark.createDataFrame([("a", "n", " New ", ["2", "9"])], "id string, new_id string, new_name string, moved array<string>")
    after, refused = RV.split_entities(e, splits)
    assert {r.id: (r.name, r.evidence, r.status) for r in after.collect()} == {"a": ("A", ["1", "3"], "accepted"), "n": ("New", ["2"], "pending")} and refused.count() == 0
    for moved in (["1", "2", "3"], ["9"], []):
        assert RV.split_entities(e, splits.withColumn("moved", F.array(*map(F.lit, moved)).cast("array<string>")))[1].count() == 1


def test_undo_is_once_and_never_of_an_undo(spark):
    e = spark.createDataFrame([("a", "A", "pending", None, [], [])], ENTITY)
    decisions = spark.createDataFrame([(1, "a", "accepted", None), (2, "a", "rejected", "Nice")], "seq long, id string, status string, name string")
    after, audit = RV.review_entities(e, decisions)
    row = after.first()
    assert (row.status, row.name, row.aliases) == ("rejected", "Nice", ["A"])
    assert [(r.seq, r.action, r.before, r.after) for r in audit.orderBy("seq").collect()] == [(1, "accept", "pending", "accepted"), (2, "reject", "accepted", "rejected")]
    ask = lambda *s: spark.createDataFrame([(x,) for x in s], "seq long")
    assert RV.undo(after, audit, ask(2))[0].first().status == "accepted"
    assert RV.undo(after, audit, ask(1))[0].first().status == "rejected"  # a later decision stands
    log = audit.unionByName(spark.createDataFrame([(3, "a", "undo", None, "2")], "seq long, id string, action string, before string, after string"))
    assert {r.seq for r in RV.undo(after, log, ask(2, 3, 7))[1].collect()} == {2, 3, 7}


def test_relation_needs_evidence_and_accepted_ends(spark):
    e = spark.createDataFrame([("a", "A", "accepted", None, [], []), ("b", "B", "accepted", None, [], []), ("c", "C", "pending", None, [], [])], ENTITY)
    r = spark.createDataFrame([("1", "a", "b", "pending", ["x"]), ("2", "a", "b", "pending", []), ("3", "a", "c", "pending", ["x"])], "id string, source string, target string, status string, evidence array<string>")
    after, refused = RV.review_relations(r, r.select("id", F.lit("accepted").alias("status")), e)
    assert {x.id: x.status for x in after.collect()} == {"1": "accepted", "2": "pending", "3": "pending"}
    assert {x.id for x in refused.collect()} == {"2", "3"}


def test_periods_titles_and_views(spark):
    df = spark.createDataFrame([("2001-01-01", "2000-01-01"), ("x", None), (None, None), ("2001-01-01", "2001-01-02")], "a string, b string")
    assert [r[0] for r in df.select(RV.valid_period(F.col("a"), F.col("b"))).collect()] == [False, False, True, True]
    notes = spark.createDataFrame([("1", "A"), ("2", "a (2)"), ("3", "A (4)"), ("4", "Untitled")], "id string, title string")
    wanted = spark.createDataFrame([("x", " A "), ("y", "B"), ("z", " ")], "id string, title string")
    assert {r.id: r.title for r in W.unique_titles(wanted, notes).collect()} == {"x": "A (3)", "y": "B", "z": "Untitled (2)"}
    rows = spark.createDataFrame([(1, ["p", "q"]), (2, []), (3, None)], "id long, tags array<string>")
    assert sorted((r.id, r.grp) for r in W.view_groups(rows, "tags").collect()) == [(1, "p"), (1, "q"), (2, "Unspecified"), (3, "Unspecified")]
    assert [r.id for r in W.saved_view(rows, [("tags", "contains", "Q")]).collect()] == [1]
    days = spark.createDataFrame([("Daily 2024-02-31",), ("Daily 2024-02-29",), ("x",)], "t string").select(W.parse_daily(F.col("t"))).collect()
    assert [str(r[0]) for r in days] == ["None", "2024-02-29", "None"]


def test_titles_of_a_batch_are_those_of_one_after_another(spark):
    rnd = random.Random(3)
    title = lambda: rnd.choice(["A", "a ", "B", "", None, "Untitled", "C"]) if rnd.random() < 0.7 else f"{rnd.choice(['A', 'b', 'A (2)'])} ({rnd.choice(['1', '02', '2', '3', '4', '7'])})"
    notes, wanted = [(str(i), title()) for i in range(12)], [(f"w{i:03}", title()) for i in range(80)]
    taken, want = {t.strip().lower() for _, t in notes if t is not None}, {}
    for i, t in wanted:
        base = new = (t or "").strip() or "Untitled"
        n = 1
        while new.lower() in taken:
            n += 1
            new = f"{base} ({n})"
        taken.add(new.lower())
        want[i] = new
    rnd.shuffle(wanted)
    table = lambda rows: spark.createDataFrame(rows, "id string, title string")
    assert {r.id: r.title for r in W.unique_titles(table(wanted), table(notes)).collect()} == want
    assert W.unique_titles(table([]), table(notes)).collect() == []


def test_canvas_edges_and_groups(spark):
    df = spark.sql("SELECT array(named_struct('id','a','x',0.0D,'y',0.0D,'width',100.0D,'height',60.0D), named_struct('id','b','x',200.0D,'y',50.0D,'width',90.0D,'height',50.0D)) n, cast(array() as array<struct<source:string,target:string,label:string>>) e")
    lab = F.lit(None).cast("string")
    one = df.withColumn("e", W.add_edge(F.col("n"), F.col("e"), F.lit("a"), F.lit("b"), lab))
    for a, b in (("a", "b"), ("a", "a"), ("a", "zz")):
        assert len(one.select(W.add_edge(F.col("n"), F.col("e"), F.lit(a), F.lit(b), lab)).first()[0]) == 1
    nodes, edges = W.remove_node(F.col("n"), F.col("e"), F.lit("b"))
    got = one.select(nodes.alias("n"), edges.alias("e"), W.group_box(F.col("n"), F.array(F.lit("a"), F.lit("b"))).alias("g"), W.resize_node(F.col("n"), F.lit("a"), F.lit(1.0), F.lit(1.0)).alias("r")).first()
    assert len(got.n) == 1 and got.e == [] and tuple(got.g) == (-24.0, -44.0, 338.0, 168.0) and (got.r[0].width, got.r[0].height) == (80.0, 50.0)


def test_index_refresh_embeds_only_what_changed(spark):
    blocks = spark.createDataFrame([("a", "h1", "aa"), ("b", "h2", "bbb"), ("c", "h3", "c")], "block_id string, hash string, input string")
    stored = spark.createDataFrame([("a", "m", "1", "h1", [9.0]), ("b", "m", "1", "old", [9.0]), ("z", "m", "1", "x", [9.0])], "block_id string, model string, version string, hash string, vector array<double>")
    got = {r.block_id: r.vector for r in S.refresh_index(blocks, stored, lambda texts: [[float(len(t))] for t in texts], "m", "1").collect()}
    assert got == {"a": [9.0], "b": [3.0], "c": [1.0]}


def test_claims_without_citation_or_support(spark):
    answers = spark.createDataFrame([(1, "Cats chase mice [S1]. Dogs bark loudly. Nothing here fits [S1]. Out of range [S9].")], "answer_id long, answer string")
    sources = spark.createDataFrame([(1, 1, "cats often chase small mice")], "answer_id long, rnk long, text string")
    got = [(r.support, r.supported) for r in VF.validate_claims(answers, sources).orderBy("n").collect()]
    assert got == [(1.0, True), (0.0, False), (0.0, False), (0.0, False)]
