"""The pipeline's stages against their operators' own verdicts and brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from provenir.llm.op1_surrogates import PATTERNS
from provenir.llm.op5_superminhash import shingles
from provenir.llm.op6_repetition import quality_rules
from provenir.llm.op8_cgk import find_leaks
from provenir.storage import materialize

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        kept[name] = docs
        assert docs.columns == columns or name == "packing"
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in kept.items()}
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    assert ids["quality_rules"] == {r.doc_id for r in quality_rules(whole).where("kept").collect()}

    rows = sorted((r.doc_id, r.text) for r in kept["quality_rules"].collect())
    sets = {i: set(shingles(t, 5).tolist()) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, s in sets.items():
        for b, t in sets.items():
            if a < b and s and 5 * len(s & t) >= 4 * len(s | t):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert ids["near_dedup"] == {i for i in sets if find(i) == i}

    leaks = {r.doc_id for r in find_leaks(kept["near_dedup"], bench).where("contaminated").collect()}
    assert ids["decontamination"] == ids["near_dedup"] - leaks == ids["personal_data"] == ids["packing"]

    before = {r.doc_id: r.text for r in kept["decontamination"].collect()}
    cards = kept["decontamination"].where(f"text rlike r'{PATTERNS['card']}'").count()
    assert cards and all(r.n_chars == len(r.text) for r in kept["personal_data"].collect())
    changed = [r for r in kept["personal_data"].collect() if r.text != before[r.doc_id]]
    assert len(changed) >= cards and len({r.doc_id for r in kept["personal_data"].collect()}) == len(before)
    assert corpus_pipeline.run(spark, DATA).count() == kept["packing"].count()


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, items string, component_id string, n_shingles string, h1 string, e string, kinds string, path string, row string, queue string"
GOOD = " ".join(f"word{i} other{i} thing{i}" for i in range(40))


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, True, *"abcdefghi") for i, t in rows], CLASHING)


ROWS = [(1, None), (2, ""), (3, " \n\t"), (None, GOOD), (None, GOOD), (4, GOOD), (4, GOOD), (4, GOOD + " b"), (5, GOOD.upper()), (6, "x" * 100_000), (7, "w " * 30_000), (8, "é😀 ß " * 60)]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=lambda x: x if isinstance(x, str) else "")
def test_stages_on_odd_rows_and_empty_tables(spark, name, stage):
    docs = odd(spark, ROWS)
    got = stage(spark, docs, DATA)
    if name != "packing":
        assert got.columns == docs.columns
        ids = Counter((r.doc_id, r.text) for r in got.collect())
    want = {
        "quality_rules": Counter(x for x in ROWS if x[1] and x[1].lower().startswith(GOOD.lower())),
        "near_dedup": Counter([(1, None), (2, ""), (3, " \n\t"), (None, GOOD), (None, GOOD), (4, GOOD), (6, ROWS[9][1]), (7, ROWS[10][1]), (8, ROWS[11][1])]),
        "decontamination": Counter(ROWS),
        "personal_data": Counter(ROWS),
    }
    if name == "packing":
        assert Counter(r.doc_id for r in got.where("start = 0").collect()) == Counter(i for i, _ in ROWS)
    else:
        assert ids == want[name]
    assert stage(spark, odd(spark, []), DATA).count() == 0
