"""Written tables, and those of rounds that are over."""

import os

from provenir.operators.components import connected_components
from provenir.session import bound_broadcasts
from provenir.storage import discard, materialize


def test_a_discarded_table_is_gone_and_others_stay(spark):
    a, b = materialize(spark.range(5), "a"), materialize(spark.range(7), "b")
    folder = a.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    discard(a)
    discard(spark.range(3))
    assert not os.path.exists(folder) and b.count() == 7


def test_a_long_chain_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.vertex: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_a_written_table_of_many_ids_does_not_go_through_the_driver(spark):
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {c: spark.conf.get(c, None) for c in (static, adaptive)}
    ids = materialize(spark.range(0, 600_000, 1, 1).selectExpr("concat('customer ', pmod(xxhash64(id), 1000000000)) id"), "ids")
    joined = lambda: ids.join(ids.selectExpr("id", "length(id) n"), "id")._jdf.queryExecution().executedPlan().toString()
    try:
        spark.conf.set(static, "10MB")
        spark.conf.unset(adaptive)
        assert "BroadcastHashJoin" in joined()  # the files are under 10 MB
        bound_broadcasts(spark)
        assert "BroadcastHashJoin" not in joined()
        spark.conf.set(static, "256k")
        bound_broadcasts(spark)
        assert spark.conf.get(static) == "256k"
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
