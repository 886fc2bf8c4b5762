"""Mentions of a provider: windows, merging, best scores, twins, against plain Python on whole texts."""

import random
import re

from provenir.operators import model_mentions as M

WORD = re.compile("[A-Z][a-z]{2,}")


def words():
    """Each capitalised word of what it is given; it refuses more than a batch, and longer texts than a window."""

    def provider(texts):
        assert 1 <= len(texts) <= M.BATCH and all(len(t) <= M.WINDOW for t in texts)
        return [[M.Mention(("PER", "B-ORG")[len(m[0]) % 2], m[0], 0.4 + len(m[0]) / 20, m.start(), m.end()) for m in WORD.finditer(t)] for t in texts]

    return provider


def blocks(spark, rows):
    return spark.createDataFrame(rows, "pos long, block_id string, text string, type string, score double").drop("_")


def test_windows_find_what_a_whole_text_holds(spark):
    r = random.Random(5)
    texts = [None, "", "  \n", "Anna", "Anna" * 3000] + ["".join(r.choice(["Anna ", "Berta, ", "der ", "x" * 50 + " ", "Zo\U0001f600 ", "McDonald "]) for _ in range(n)) for n in (3, 900, 2500, 800, 795, 1)]
    texts += ["a" * (M.WINDOW - 2) + "Hamburg" + "b" * 9000, "Berta " * 20]
    rows = [(i, f"b{i}", t, "clash", 0.0) for i, t in enumerate(texts)] + [(5, "b5", texts[5], "clash", 0.0)]
    got = sorted((x.block_id, x.type, x.name, x.start) for x in M.model_mentions(blocks(spark, rows).repartition(3), words).collect())
    want = []
    for _, b, t, *_ in rows:
        for m in WORD.finditer(t or ""):
            if len(m[0]) <= M.LONGEST:
                want.append((b, ("person", "organization")[len(m[0]) % 2], m[0], m.start()))
    assert got == sorted(want)
    assert M.model_mentions(blocks(spark, rows).limit(0), words).count() == 0


def test_overlapping_and_split_spans_are_one():
    text = "New York City and Osnabrück"
    found = [M.Mention("B-LOC", "New", 0.8, 0, 3), M.Mention("I-LOC", "York", 0.95, 4, 8), M.Mention("LOC", "York City", 0.7, 4, 13), M.Mention("ORG", "York", 0.9, 4, 8), M.Mention("B-LOC", "Osna", 0.6, 18, 22), M.Mention("B-LOC", "##brück", 0.9, 22, 27), M.Mention("DATE", "and", 1.0, 14, 17), M.Mention("PER", " ", 1.0), M.Mention("PER", "A . B", 0.9)]
    got = sorted(M.merged(text, M.spans(found, 0, len(text), True)))
    assert got == [("organization", "York", 0.9, 4), ("person", "A. B", 0.9, 0), ("place", "New York City", 0.95, 0), ("place", "Osnabrück", 0.9, 18)]
    apart = [M.Mention("B-LOC", "New", 0.8, 0, 3), M.Mention("B-LOC", "York", 0.9, 4, 8)]
    assert [m[1] for m in M.merged(text, M.spans(apart, 0, len(text), True))] == ["New", "York"]
    assert [s.start for s in M.spans([M.Mention("LOC", "a", 1.0, 0, 2), M.Mention("LOC", "b", 1.0, 3, 5), M.Mention("LOC", "c", 1.0, 6, 9)], 100, 9, False)] == [103]


def test_best_score_first_name_and_twins(spark):
    rows = [(1, "b1", "person", "Ada  L", 0.71, 9), (1, "b1", "person", "ada l", 0.9, 2), (2, "b2", "person", "ADA L", 0.8, 0), (2, "b2", "person", "Bo", 0.69, 0), (3, "b3", "place", "X", 0.99, 0), (3, "b3", "place", "y" * 121, 0.99, 0), (3, "b3", "topic", "Gas", 0.8, 0), (3, "b3", "topic", "Oil", 0.8, 0)]
    mentions = spark.createDataFrame(rows, "pos long, block_id string, type string, name string, score double, start int")
    known = spark.createDataFrame([("topic", " GAS ", "pattern-1"), ("topic", "oil", "local-ner:m@1"), ("place", "ada l", None)], "type string, name string, extractor string")
    got = {x.id: (x.name, x.confidence, x.n, x.first_block) for x in M.model_candidates(M.model_evidence(mentions, 0.7), known).collect()}
    assert got == {"model-entity-person-ada-l": ("ada l", 0.9, 2, "b1"), "model-entity-topic-oil": ("Oil", 0.8, 1, "b3")}
    assert M.model_evidence(mentions, 0.1).where("confidence < 0.5").count() == 0
    assert M.model_candidates(M.model_evidence(mentions.limit(0)), known).count() == 0
