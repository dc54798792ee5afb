"""Evidence operators and the service surface on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwork import schema
from tarnwork.operators import evidence as E
from tarnwork.plans import service


def test_mentions(spark):
    papers = spark.createDataFrame([("p1", "We study Semgrep rules.", None), ("p2", "x", "see https://github.com/a/tool and more"), ("p3", "the Act is law", "act as a coding agent: act")], "id string, title string, abstract string")
    tools = spark.createDataFrame([("semgrep", "Semgrep", "https://github.com/s/semgrep", "s/semgrep"), ("tool", "Tool", "https://github.com/a/tool", "a/tool"), ("act", "Act", "https://github.com/n/act", "n/act")], "id string, name string, url string, slug string")
    got = {(r.paper, r.tool, r.rule, r.field) for r in E.mentions(papers, ["title", "abstract"], tools, ["coding agent"]).collect()}
    assert got == {("p1", "semgrep", "name", "title"), ("p2", "tool", "url", "abstract"), ("p3", "act", "name_context", "abstract")}


def test_changes(spark):
    lines = spark.createDataFrame([("a.py", 1, True, "def f():"), ("a.py", 2, True, "    pass"), ("a.py", 4, True, "@abstractmethod"), ("a.py", 5, True, "def g():"), ("a.py", 6, True, "    pass"), ("a.py", 8, True, "import os, numpy"), ("a.py", 9, True, "import numpy"), ("tests/test_a.py", 1, False, "assert x"), ("tests/test_a.py", 1, True, "x = 1")], schema.DIFF_LINES)
    assert [r.line_no for r in E.stub_bodies(lines).collect()] == [1]
    assert [(r.path, r.removed, r.gained) for r in E.weakened_tests(lines).collect()] == [("tests/test_a.py", 1, 0)]
    assert [r.package for r in E.undeclared_imports(lines, spark.createDataFrame([("os",)], "package string")).collect()] == ["numpy"]


def test_headlines_and_suggestions(spark):
    inc = spark.createDataFrame([("i1", "", dt.date(2024, 1, 1), "h", "plausible", ["a"], [], []), ("i2", "", dt.date(2023, 1, 1), "h", "confirmed", ["a", "b"], [], []), ("i3", "", dt.date(2024, 1, 1), "h", "confirmed", ["a"], [], [])], schema.INCIDENTS)
    assert {tuple(r) for r in E.headline(inc).collect()} == {("a", "i3"), ("b", "i2")}
    items = spark.createDataFrame([("x", "Uses MCTS and Fuzzing", None), ("y", "fuzzing", ["p"])], "id string, description string, cited_in array<string>")
    rules = spark.createDataFrame([(2, "fuzz", "p2"), (1, "mcts", "p1"), (3, "mcts", "gone")], "ordinal int, keyword string, paper string")
    known = spark.createDataFrame([("p1",), ("p2",)], "id string")
    assert [(r.id, r.papers) for r in E.suggestions(items, rules, known).collect()] == [("x", ["p1", "p2"])]


def test_rule_classifier(spark):
    df = spark.createDataFrame([(1, "before it runs, plan the run"), (2, "before and after"), (3, "none")], "id int, t string")
    got = E.rule_classifier(df, "id", "t", {"phase": {"pre": ["before", "plan"], "post": ["after"]}}).orderBy("id").collect()
    assert [(r.phase, r.phase_confidence) for r in got] == [("pre", 0.8), (None, 0.35), (None, 0.3)]


def test_service(spark):
    base = dict.fromkeys(schema.struct(schema.ITEMS).names)
    rows = [base | {"id": "a", "addresses": ["x", "y"], "stars": 10, "control_paradigm": "detection"}, base | {"id": "b", "addresses": ["x"], "stars": 10_000, "control_paradigm": "prevention"}, base | {"id": "agent", "addresses": ["x", "y", "z"], "stars": 99}]
    items = spark.createDataFrame([tuple(r.values()) for r in rows], schema.ITEMS)
    weights = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 1.0)], "category string, weight double")
    picks = service.recommend(items, weights, 3, agents=["agent"], asker="agent")
    assert [p["id"] for p in picks] == ["a"]
    assert [(r.rank, r.id) for r in service.recommend_for(items, ["x"], 2).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    assert service.lookup(items, "a").first().name == "a" and service.lookup(items, "a").first().cited_in == []
    with pytest.raises(Exception, match="unknown id"):
        service.lookup(items, "nope").collect()
    service.register_tables(spark, items)
    assert [r.id for r in spark.sql("SELECT id FROM items_for('z')").collect()] == ["agent"]
    assert service.unresolved(items.select("id"), items.filter("id <> 'a'")).first().id == "a"


def test_external_checks(spark):
    files = spark.createDataFrame([("f", "hits: 3")], "path string, content string")
    assert tuple(E.commands(files, ["cat"], r"hits: (\d+)").first()) == ("f", "pass", 3.0)
    assert E.commands(files, ["false"]).select(F.col("outcome")).first()[0] == "caught"
