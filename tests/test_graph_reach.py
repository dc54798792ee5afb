"""Reachability without a bound of depth."""

from tarnwork.operators import graph


def test_a_long_cycle_is_found(spark):
    n = 20
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(100, 0), (n - 1, 200)], "src long, dst long")
    assert {(r.id, r.length) for r in graph.cyclic(spark, ring).collect()} == {(i, n) for i in range(n)}
    assert graph.cyclic(spark, ring, 16).count() == 0


def test_it_ends_with_a_null_source(spark):
    edge = spark.createDataFrame([(None, 0), (0, 1), (1, 0)], "src long, dst long")
    assert {(r.src, r.dst) for r in graph.reach(spark, edge).collect()} == {(None, 0), (None, 1), (0, 1), (0, 0), (1, 0), (1, 1)}
