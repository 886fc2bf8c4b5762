import random

import numpy as np

from provenir.operators import names as N


def found(spark, texts, names):
    t = spark.createDataFrame(list(enumerate(texts)), "ident long, text string")
    got = [tuple(r) for r in N.find_names(t, spark.createDataFrame([(n,) for n in names], "called string")).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_names_are_those_that_texts_contain(spark):
    rnd = random.Random(1)
    word = lambda a, b: "".join(rnd.choice("abcé#0😀 ") for _ in range(rnd.randint(a, b)))
    texts = [word(0, 400) for _ in range(40)] + ["", None, "x" * 30_000, "customer#000000042 and customer#000000421"]
    names = [word(1, 6) for _ in range(150)] + [t[i : i + n] for t in texts[:20] if t for i, n in ((3, 9), (10, 33), (0, 70), (5, 130))]
    names += [None, "", "a", "xxx", *(f"customer#{i:09}" for i in range(500)), *names[:5]]
    want = {(i, n) for i, t in enumerate(texts) for n in names if t and n and n in t}
    assert found(spark, texts, names) == want and len(want) > 300


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    texts, names = ["the cat sat on the mat", "no such thing"], ["cat", "at", "the mat", "zebra", "n"]
    want = {(i, n) for i, t in enumerate(texts) for n in names if n in t}
    monkeypatch.setattr(N, "bitmap_of", lambda names: (np.full(2048, 0xFFFFFFFF, np.uint32), [1, 2, 3, 5, 7]))
    assert found(spark, texts, names) == want


def test_no_names_or_texts(spark):
    assert found(spark, ["a"], []) == set() == found(spark, [], ["a"])


def test_questions_and_names_meet_by_equality_only(spark):
    from provenir.operators.graph import anchors

    questions = spark.createDataFrame([(i, f"Who knows Firm{i} and the Old Mill?") for i in range(50)], "question_id long, question string")
    entities = spark.createDataFrame([(f"e{i}", f"Firm{i}", "accepted", None, ["old mill"] if i == 3 else []) for i in range(100)], "id string, name string, status string, merged_into string, aliases array<string>")
    df = anchors(questions, entities)
    want = {(i, f"e{k}") for i in range(50) for k in range(100) if f"firm{k} " in f"firm{i} " or k == 3 or str(i).startswith(str(k))}
    assert {(r.question_id, r.id) for r in df.collect()} == want
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
