"""Sums that decide at a threshold are the same in any order of rows."""

import itertools
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from tarnwork.functions import scoring as S
from tarnwork.operators import graph as G
from tarnwork.plans import catalog, records  # noqa: F401

VALUES = (0.04, 0.05, 0.06, 0.09)  # mean 0.06: in some orders the sum of doubles lies above, in others not


def test_tiers_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    orders = [o for o in itertools.permutations(VALUES)]
    assert len({reduce(add, o) / 4 > 0.06 for o in orders}) == 2
    rows = [(i, "A", "F", x) for i, o in enumerate(orders) for x in o]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["tier"] for r in catalog._cells(spark, str(tmp_path)).collect()} == {2}


def test_grades_do_not_depend_on_the_order_of_categories(spark):
    w = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.4)], "category string, weight double")
    cells = spark.createDataFrame([("u", c, "p", 3) for c in "abc"], "unit string, category string, paradigm string, tier int")
    assert [(r.score, r.grade) for r in G.unit_scores(cells, w).collect()] == [(0.6, "B")]


def test_a_mean_keeps_what_has_no_decimal_digits(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None), (2, float("inf")), (2, 1.0), (3, None)], "k int, x double")
    assert {r.k: r.m for r in df.groupBy("k").agg(S.exact_mean(F.col("x")).alias("m")).collect()} == {1: 0.5, 2: float("inf"), 3: None}


def test_breadth_does_not_depend_on_the_order_of_lines(spark, tmp_path):
    orders = list(itertools.permutations((0.01, 0.01, 0.04, 0.1)))  # mean 0.04: no tier
    assert len({reduce(add, o) / 4 > 0.04 for o in orders}) == 2
    rows = [(i, "A", "F", x) for i, o in enumerate(orders) for x in o]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalog.QUERIES["breadth_selection"](spark, str(tmp_path)).collect()]
    assert got == [(i, 0, 0) for i in range(20)]
