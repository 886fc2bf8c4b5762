"""An incremental rebuild equals a full one after random edits; versions and copies swap as a whole or not at all."""

import os
import random
import shutil

import pytest

from provenir.operators import rebuild as RB
from provenir.operators import versions as VS

BLOCK = "block_id long, pos long, text string"


def sentence(rnd):
    names = ["Acme Corp", "Beta Labs", "Gamma", "Delta  Works", "Delta Works", "Omega Point Ltd", "Zed"]
    a, b = rnd.sample(names, 2)
    return rnd.choice([f"{a} acquired {b} on 2020-01-0{rnd.randint(1, 9)}.", f"{a} uses {b}. See https://x.example/{rnd.randint(1, 5)}", f"Today {b}  and {a} met", "", None, "nothing here"])


def rows(state):
    return {name: sorted(map(repr, df.select(sorted(df.columns)).collect())) for name, df in state.items()}


@pytest.mark.parametrize("seed", [1])
def test_increment_equals_a_full_rebuild_after_random_edits(spark, seed):
    rnd = random.Random(seed)
    blocks = {i: (i, sentence(rnd)) for i in range(60)}
    table = lambda: spark.createDataFrame([(i, p, t) for i, (p, t) in blocks.items()], BLOCK)
    state = RB.full(table())
    for _ in range(2):
        for i in rnd.sample(sorted(blocks), 5):
            blocks[i] = (blocks[i][0], sentence(rnd))
        for i in rnd.sample(sorted(blocks), 3):
            del blocks[i]
        for _ in range(2):
            i = rnd.randrange(100, 200)
            blocks[i] = (i, sentence(rnd))
        i = rnd.choice(sorted(blocks))
        blocks[i] = (-i - 1, blocks[i][1])
        state, again = RB.increment(state, table())
        assert rows(state) == rows(RB.full(table()))


def test_what_is_read_again_grows_with_the_change(spark):
    texts = {i: f"Firm{i} Group uses Tool{i % 40} Kit." for i in range(400)}
    table = lambda: spark.createDataFrame([(i, i, t) for i, t in texts.items()], BLOCK)
    state = RB.full(table())
    texts[7] = "Firm7 Group acquired Fresh Start."
    state, again = RB.increment(state, table())
    # block 7 was the first to name its tool, under the same name as the others
    assert [(r.block_id, r.again) for r in again.collect()] == [(7, "extract")]
    texts[8] = texts[8].replace("Tool8 Kit", "Tool8  Kit")
    state, again = RB.increment(state, table())
    assert {r.again for r in again.where("block_id = 8").collect()} == {"extract"} and 1 < again.count() <= 12
    assert rows(state) == rows(RB.full(table()))
    assert RB.increment(state, table())[1].count() == 0


def test_entities_alone_are_rebuilt_without_relations(spark, monkeypatch):
    rnd = random.Random(7)
    blocks = [(i, i, sentence(rnd)) for i in range(60)]
    edited = [(i, p + 1000 * (i % 9 == 0), sentence(rnd) if i % 7 == 0 else t) for i, p, t in blocks if i % 11]
    old, new = (spark.createDataFrame(b, BLOCK) for b in (blocks, edited))
    want = rows(RB.full(new))
    monkeypatch.setattr(RB.E, "relation_evidence", None)
    state, again = RB.increment(RB.full(old, relations=False), new)
    assert rows(state) == {k: want[k] for k in ("blocks", "mentions", "entities")}
    assert {r.block_id for r in again.collect()} == {i for i, _, t in edited if t != blocks[i][2] and (t or blocks[i][2])}


def test_empty_states(spark):
    none = spark.createDataFrame([], BLOCK)
    some = spark.createDataFrame([(1, 1, "Acme Corp uses Beta Labs.")], BLOCK)
    assert rows(RB.increment(RB.full(none), some)[0]) == rows(RB.full(some))
    assert rows(RB.increment(RB.full(some), none)[0]) == rows(RB.full(none))


def test_reviews_outlive_a_rebuild(spark):
    state = RB.full(spark.createDataFrame([(1, 1, "Acme Corp uses Beta Labs.")], BLOCK))
    ids = sorted(r.id for r in state["entities"].collect())
    e = spark.createDataFrame([(ids[0], "v1", "accepted", ["x"], True, None), (ids[1], "v0", "accepted", ["y"], True, "z"), ("entity-gone", "v1", "accepted", [], False, None)], "id string, extractor string, status string, aliases array<string>, pinned boolean, merged_into string")
    rel = state["relations"].first().id
    r = spark.createDataFrame([(rel, "v1", "accepted", "2001-01-01", None)], "id string, extractor string, status string, valid_from string, valid_to string")
    entities, relations = RB.reviewed(state, e, r, "v1")
    got = {x.id: x for x in entities.collect()}
    assert sorted(got) == ids and (got[ids[0]].status, got[ids[0]].aliases, got[ids[0]].pinned) == ("accepted", ["x"], True)
    assert (got[ids[1]].status, got[ids[1]].aliases, got[ids[1]].merged_into) == ("pending", ["y"], None)
    assert {x.id: (x.status, x.valid_from) for x in relations.collect()}[rel] == ("accepted", "2001-01-01")


def workspace(spark, mark):
    one = lambda *v, s: spark.createDataFrame([v], s)
    out = {name: one(mark, s="id string") for name in VS.REQUIRED}
    return out | {
        "notes": one("n", "T", mark, s="id string, title string, markdown string"),
        "documents": one("d", s="doc_id string"),
        "blocks": one("b", "d", s="block_id string, doc_id string"),
        "entities": one("e", "E", None, s="id string, name string, merged_into string"),
        "relations": one("e::x::e", "e", "e", ["b"], s="id string, source string, target string, evidence array<string>"),
    }


def test_a_copy_is_taken_over_whole_or_refused(spark, tmp_path):
    base, copy = f"file://{tmp_path}/base", f"file://{tmp_path}/copy"
    assert VS.publish(spark, workspace(spark, "old"), base) == 1
    assert VS.publish(spark, workspace(spark, "new") | {"embeddings": spark.range(3)}, copy, form=1) == 1
    assert VS.take_over(spark, copy, base) == 2
    now = VS.current(spark, base, verify=True)
    assert now["notes"].first().markdown == "new" and now["templates"].count() == 0 and "embeddings" not in now

    def stands():
        assert len(VS.manifests(spark, base)) == 2 and VS.current(spark, base)["notes"].first().markdown == "new"

    for i, name in enumerate(("notes", "views")):  # broken at a table: other rows, or none
        bad = f"{tmp_path}/bad{i}"
        shutil.copytree(f"{tmp_path}/copy", bad)
        data = next(x for x in os.listdir(bad) if x.startswith("data-"))
        shutil.rmtree(f"{bad}/{data}/{name}")
        if i:
            spark.createDataFrame([("zz",)], "id string").write.parquet(f"file://{bad}/{data}/{name}")
        with pytest.raises(ValueError, match=name):
            VS.take_over(spark, f"file://{bad}", base)
        stands()
    loose = workspace(spark, "x") | {"semantic_suggestions": spark.createDataFrame([("s", "e", "nobody", [])], "id string, source string, target string, evidence array<string>")}
    VS.publish(spark, loose, f"file://{tmp_path}/loose")
    with pytest.raises(ValueError, match="suggestion"):
        VS.take_over(spark, f"file://{tmp_path}/loose", base)
    few = workspace(spark, "x")
    few.pop("views")
    VS.publish(spark, few, f"file://{tmp_path}/few")
    with pytest.raises(ValueError, match="lacks views"):
        VS.take_over(spark, f"file://{tmp_path}/few", base)
    VS.publish(spark, workspace(spark, "x"), f"file://{tmp_path}/late", form=4)
    with pytest.raises(ValueError, match="format"):
        VS.take_over(spark, f"file://{tmp_path}/late", base)
    with pytest.raises(ValueError, match="no copy"):
        VS.take_over(spark, f"file://{tmp_path}/nowhere", base)
    stands()
    (tmp_path / "base" / "manifest-00000003.json").write_text('{"format": 3, "numb')  # a writer that was lost
    stands()
    assert VS.publish(spark, workspace(spark, "later"), base) == 4 and VS.current(spark, base)["notes"].first().markdown == "later"
