import random

from pyspark.sql import functions as F

from provenir.operators import intervals as IV
from provenir.operators.graph import communities
from provenir.operators.reasoning import blocks_of_times


def test_overlaps_are_those_of_all_pairs(spark):
    rnd = random.Random(3)
    make = lambda n: [(rnd.choice("xy"), i, (a := rnd.randint(-50, 300)), rnd.choice([a, a + rnd.randint(0, 90), a - 7, None])) for i in range(n)]
    left, right = make(120), make(120)
    l, r = spark.createDataFrame(left, "k string, i long, a long, b long"), spark.createDataFrame(right, "k string, j long, c long, d long")
    got = [(x.i, x.j) for x in IV.overlapping(l, r, ["k"], (F.col("a"), F.col("b")), (F.col("c"), F.col("d")), 16).collect()]
    whole = lambda rows: [(k, i, min(a, b), max(a, b)) for k, i, a, b in rows if b is not None]
    want = {(i, j) for k, i, a, b in whole(left) for m, j, c, d in whole(right) if k == m and a <= d and c <= b}
    assert len(got) == len(set(got)) and set(got) == want


def test_numbers_run_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(IV, "RANGE_ROWS", 50)
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    df = IV.numbered(spark.createDataFrame(rows, "v long, g long"), [F.desc("g"), F.col("v")], "at")
    assert [(r.v, r.g) for r in df.orderBy("at").collect()] == sorted(rows, key=lambda x: (-x[1], x[0]))
    assert sorted(r.at for r in df.collect()) == list(range(1000))
    assert IV.numbered(spark.createDataFrame([], "v long"), ["v"], "at").collect() == []


def test_lone_communities_are_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(IV, "RANGE_ROWS", 20)
    e = spark.range(200).selectExpr("concat('e', lpad(id, 3, '0')) id", "'accepted' status", "cast(null as string) merged_into")
    r = spark.createDataFrame([("e150", "e151", "accepted"), ("e151", "e160", "accepted"), ("e007", "e008", "accepted")], "source string, target string, status string")
    got = {x.id: (x.community, x.size, x.idx) for x in communities(e, r).collect()}
    assert got["e160"] == ("e150", 3, 0) and got["e008"] == ("e007", 2, 1) and got["e000"] == ("e000", 1, 2)
    assert sorted({v[2] for v in got.values()}) == list(range(197))


def test_blocks_of_a_time_mention_it_or_were_made_in_it(spark):
    blocks = spark.createDataFrame([("a", "in 1999 and 2001", None, None), ("b", "no year", "2000-05-05", None), ("c", None, "1980-01-01", "2001-01-01T10:00:00Z"), ("d", "2010", "x", None), ("e", "nothing", None, None)], "block_id string, text string, created string, updated string")
    times = spark.sql("SELECT 1 q, named_struct('from_year', 1999, 'to_year', 2001) time UNION ALL SELECT 2, named_struct('from_year', 2005, 'to_year', cast(null as int)) UNION ALL SELECT 3, null UNION ALL SELECT 4, named_struct('from_year', cast(null as int), 'to_year', 1985)")
    assert sorted(tuple(r) for r in blocks_of_times(blocks, times, "block_id", "q").collect()) == [("a", 1), ("b", 1), ("c", 1), ("c", 4), ("d", 2)]
