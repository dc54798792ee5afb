"""Functions, operators, sources and streams on small tables, with values known by hand."""

import datetime as dt
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarnwork import schema
from tarnwork.functions import scoring as S
from tarnwork.functions import text as X
from tarnwork.operators import graph as G
from tarnwork.operators import relational as R
from tarnwork.operators import stats as A
from tarnwork.operators import vectors as V
from tarnwork.plans import catalog
from tarnwork.sources import connectors, readers, sinks
from tarnwork.streaming import flows


def table_of(spark, f, cases):
    """The values of an expression over one text column."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_repository_urls(spark):
    cases = {"https://github.com/Own/Repo/": "https://github.com/own/repo", "http://www.github.com/a/b.git": "https://github.com/a/b", "github.com/a/b/tree/main/x?y=1#z": "https://github.com/a/b", "https://gitlab.com/a/b": None, "https://github.com/a": None, "https://github.com/topics/x": None, None: None, "": None, "https://github.com:443/a/b.c": "https://github.com/a/b.c"}
    assert table_of(spark, X.repository_url, cases) == list(cases.values())


def test_canonical_urls(spark):
    cases = {"HTTPS://Ex.com:443/A/?utm_source=x&b=1&c=#f": "https://ex.com/A?b=1", "http://ex.com:443/": "http://ex.com:443", "https://ex.com/?ref=1&ref_src=2": "https://ex.com?ref=1", "not a url": "https:not a url", "//Ex.com/a/": "https://ex.com/a", "https://ex.com?UTM_x=1&q=%41+b~*": "https://ex.com?q=A+b~%2A", "": ""}
    assert table_of(spark, X.canonical_url, cases) == list(cases.values())


def test_identifiers(spark):
    assert table_of(spark, X.arxiv_ids, ["see 2101.00001v2, hep-th/0102003 and 2101.00001"]) == [["2101.00001", "hep-th/0102003"]]
    assert table_of(spark, X.dois, ["(10.1000/AbC.1); 10.1000/abc.1."]) == [["10.1000/AbC.1"]]
    assert table_of(spark, X.bare_arxiv_id, ["https://arxiv.org/abs/2101.00001v3", " "]) == ["2101.00001", None]
    assert table_of(spark, X.repository_urls, ["x https://github.com/A/b. and https://GITHUB.com/a/B, https://github.com/c/d"]) == [["https://github.com/A/b", "https://github.com/c/d"]]


def test_names(spark):
    assert table_of(spark, X.kebab, ["Hello,  World!", "--", None]) == ["hello-world", None, None]
    assert table_of(spark, X.camel_kebab, ["HTTPServerName"]) == ["http-server-name"]
    assert table_of(spark, X.slug, ["The Art of a Very Long Title on Code"]) == ["art-very-long-title-code"]
    assert table_of(spark, X.surname, ["Müller, Anna", "Bob Smith Jr."]) == ["muller", "smith"]
    assert table_of(spark, lambda c: X.truncated(c, 5), ["abcdefg", "abc", None]) == ["abcd…", "abc", None]


def test_phrases(spark):
    rules = {"a": ["run test", "x"], "b": ["ünder"]}
    got = table_of(spark, lambda c: X.phrase_hits(c, rules), ["RUN\n test xx", "sünder", "Ünder x", ""])
    assert got == [{"a": ["run test"]}, {}, {"a": ["x"], "b": ["ünder"]}, {}]
    assert table_of(spark, lambda c: X.keyword_score(c, {"a": 4, "b": -9}, 10), ["a", "ab", ""]) == [0.4, 0.0, 0.0]


def test_quotes_and_dates(spark):
    df = spark.createDataFrame([(["“Some  text”", "made up", ""], "here is some TEXT.")], "q array<string>, s string")
    assert tuple(df.select(X.verified_quotes("q", "s").alias("v")).first()["v"]) == (1, 3)
    assert table_of(spark, X.iso_date, ["2024-02-30", "2024-03-01T10:00Z", None]) == [None, dt.date(2024, 3, 1), None]
    assert table_of(spark, X.closed_json, ['{"a": {"b": 1']) == ['{"a": {"b": 1}}']
    assert table_of(spark, X.python_imports, ["import os.path\nfrom re import x\n"]) == [["os", "re"]]


def test_gate(spark):
    cases = [(None,) * 6 + ("FAIL", 0), (1000, 2, None, None, None, None, "PASS", 2), (999, 1, False, 2, 1, "x", "FAIL", 0), (10000, None, None, None, None, None, "PASS", 2), (1000, None, None, None, None, None, "FAIL", 1)]
    df = spark.createDataFrame([c[:6] for c in cases], "a int, b int, c boolean, d int, e int, f string")
    got = df.select(S.gate(*[F.col(c) for c in "abcdef"], ["lab"]).alias("g")).collect()
    assert [(r.g.decision, r.g.n_passed) for r in got] == [c[6:] for c in cases]


def test_grades(spark):
    cases = [1.0, 0.8, 0.799, 0.6, 0.4, 0.2, 0.0]
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert [r[0] for r in df.select(S.grade(F.col("x"))).collect()] == list("AABBCDF")


def test_maturity(spark):
    today = dt.date(2025, 1, 1)
    base = dict.fromkeys(schema.struct(schema.ITEMS).names)
    items = [base | {"id": "cited", "cited_in": list("abcde"), "stars": 999, "last_updated": today - dt.timedelta(365)}, base | {"id": "old", "cited_in": list("abcde"), "maturity_status": "deprecated", "last_updated": today - dt.timedelta(366)}, base | {"id": "set", "maturity_override": ("1A", "x")}, base | {"id": "none"}]
    df = spark.createDataFrame([tuple(i.values()) for i in items], schema.ITEMS)
    got = {r.id: tuple(r.m) for r in df.select("id", S.maturity(F.lit(today)).alias("m")).collect()}
    assert got == {"cited": (15.2, "1A"), "old": (12.0, "4"), "set": (0.0, "1A"), "none": (0.0, "4")}


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, s string")
    new = spark.createDataFrame([("a", None, "y", 1), ("a", 5, None, 2), ("c", 7, None, 3)], "k string, n int, s string, at int")
    assert {tuple(r) for r in R.upsert_nonnull(old, new, ["k"], "at").collect()} == {("a", 5, "y"), ("b", 2, "x"), ("c", 7, None)}
    got = R.insert_if_absent(old, new.select("k", "n", "s"), ["k"], F.col("n")).collect()
    assert [r.k for r in got] == ["c"]
    m = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 3.0}), (None, {"z": 1.0})], "o map<string,double>, p map<string,double>")
    assert [r[0] for r in m.select(R.patch_map(F.col("o"), F.col("p"))).collect()] == [{"a": 1.0, "b": 3.0}, {"z": 1.0}]


def test_lookup_takes_the_first_key(spark):
    index = spark.createDataFrame([("i1", "u1", "n1"), ("i2", "u2", "n2"), ("i3", "u1", "n3")], "id string, url string, name string")
    probe = spark.createDataFrame([(1, "u1", "n2"), (2, "zz", "n2"), (3, None, None)], "p int, url string, name string").withColumnsRenamed({"url": "pu", "name": "pn"})
    got = R.prioritised_lookup(probe, "p", index, [("url", F.col("pu"), F.col("url")), ("name", F.col("pn"), F.col("name"))], F.col("id"))
    assert {(r.p, r.hit, r.hit_by) for r in got.collect()} == {(1, "i1", "url"), (2, "i2", "name"), (3, None, None)}


def test_as_of_and_ranges(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b")], "k string, t int, v string")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("k", 9, 90)], "k string, t int, w int")
    assert {(r.v, r.w) for r in R.as_of(left, right, ["k"], "t", "t", ["w"]).collect()} == {("a", 50), ("b", None)}
    spans = spark.createDataFrame([(0, 7), (6, 30)], "lo int, hi int")
    assert {(r.t, r.lo) for r in R.range_join(right, "t", spans, "lo", "hi", 4.0).collect()} == {(2, 0), (5, 0), (9, 6)}


def test_accept_in_order(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", None), (4, "c", None), (5, "d", None)], "r int, p string, q string")
    assert [r.r for r in R.accept_in_order(df, "r", ["p", "q"], 2).collect()] == [1, 4]


def test_greedy_cover_like_a_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        weight = {c: rng.choice([0.5, 1.0, 2.0]) for c in "abcdef"}
        pool = {f"i{k}": (set(rng.sample("abcdef", rng.randint(1, 3))), rng.choice([0.0, 0.5, 1.0])) for k in range(8)}
        covered, want = set(), []
        for _ in range(4):
            scored = [(sum(weight[c] for c in own - covered) * (1 + rel), i) for i, (own, rel) in sorted(pool.items())]
            best = max(scored, key=lambda x: x[0])
            if best[0] <= 0:
                break
            want.append(best[1])
            covered |= pool[best[1]][0]
        frame = spark.createDataFrame([(i, c, rel) for i, (own, rel) in pool.items() for c in own], "id string, category string, reliability double")
        got = G.greedy_cover(frame, spark.createDataFrame(list(weight.items()), "category string, weight double"), 4)
        assert [p["id"] for p in got] == want


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    assert {(r.id, r.length) for r in G.cyclic(spark, e).collect()} == {("a", 3), ("b", 3), ("c", 3)}
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {tuple(r) for r in G.asymmetric(e, nodes).select("src", "dst").collect()} == {("a", "b"), ("c", "a"), ("d", "a")}
    assert {r.id for r in G.neighbourhood(e, nodes.filter("id = 'a'")).collect()} == set("abcd")


def test_unit_scores(spark):
    cells = spark.createDataFrame([("u", "x", "p", 3), ("u", "x", "q", 1), ("u", "y", "p", 1), ("v", "y", "p", 0)], "unit string, category string, paradigm string, tier int")
    w = spark.createDataFrame([("x", 2.0), ("y", 1.0), ("z", 1.0)], "category string, weight double")
    assert {(r.unit, r.score, r.grade) for r in G.unit_scores(cells, w).collect()} == {("u", 0.6, "B"), ("v", 0.0, "F")}


def test_kappa_and_agreement(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a int, b int")
    po = (a == b).mean()
    pe = sum((a == k).mean() * (b == k).mean() for k in range(3))
    assert A.kappa(df).first()[0] == pytest.approx((po - pe) / (1 - pe))
    same = A.agreement(df.withColumn("c", F.col("a") + 5), "a", "c").first()
    assert (same.ari, same.nmi) == (1.0, 1.0)
    sets = spark.createDataFrame([([], []), (["x"], ["x", "y"])], "a array<string>, b array<string>")
    assert sets.agg(A.mean_jaccard(F.col("a"), F.col("b"))).first()[0] == 0.75


def test_all_pairs_over_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(50)
    got = V.all_pairs_top_k(df, "id", "v", 3, block=16).collect()
    assert {(r.id, r.rank): r.neighbour for r in got} == {(i, k + 1): int(j) for i in range(50) for k, j in enumerate(np.argsort(-s[i])[:3])}


def test_readers(spark, tmp_path):
    (tmp_path / "a.yml").write_text("id: a\nname: A\naddresses: [x, y]\nstars: 3\n")
    (tmp_path / "b.yml").write_text("- just\n- a list\n")
    got = readers.catalog(spark, str(tmp_path), "item").collect()
    assert [(r.id, r.addresses, r.stars) for r in got] == [("a", ["x", "y"], 3)]
    with pytest.raises(Exception, match="mapping"):
        readers.catalog(spark, str(tmp_path), "item", strict=True).collect()
    feed = tmp_path / "f.xml"
    feed.write_text("<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n  b</title><published>2021-01-02T00:00:00Z</published><author><name>N</name></author><category term='cs.AI'/></entry><entry><title>none</title></entry></feed>")
    (row,) = readers.feed(spark, str(feed)).collect()
    assert (row.arxiv_id, row.title, row.published, row.authors, row.categories) == ("2101.00001", "A b", "2021-01-02", ["N"], ["cs.AI"])
    log = tmp_path / "log.jsonl"
    log.write_text('{"ts": "2024-01-01", "tool_id": "t"}\n\nnot json\n{"ts": "2024-01-02", "tool_id": "u"}\n')
    assert [r.tool_id for r in readers.event_log(spark, str(log), schema.EVENTS).collect() if r.ts] == ["u", "t"]


def test_diff_and_packages(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n keep\n-old\n+new\n+-- more\n"
    got = readers.diff_lines(spark.createDataFrame([("c", diff)], "commit string, diff string")).collect()
    assert [(r.path, r.line_no, r.added, r.text) for r in got] == [("x.py", 2, False, "old"), ("x.py", 2, True, "new"), ("x.py", 3, True, "-- more")]
    assert readers.manifest_packages("a/pyproject.toml", '[project]\ndependencies = ["Foo_Bar>=1"]\n[tool.ruff]\nx = 1') == ["foo-bar", "tool.ruff"]
    assert readers.manifest_packages("requirements-dev.txt", "# c\nA.b==1\n-r x\n") == ["a-b"]
    assert readers.manifest_packages("package.json", '{"dependencies": {"x": "1"}, "devDependencies": {"@a/b": "2"}}') == ["@a/b", "x"]
    assert readers.manifest_packages("package.json", "[broken") == []


def replay(url, params):
    return json.dumps({"results": [{"n": params["page"] * 10 + i} for i in range(2)]})


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(connectors.PagedSource)
    got = spark.read.format("paged").options(url="u", transport="tests.test_core:replay", max_pages=2, cache=str(tmp_path), day="d").load().collect()
    assert sorted(json.loads(r.raw_json)["n"] for r in got) == [0, 1, 10, 11] and len(list(tmp_path.glob("d/*.json"))) == 2
    waits = []
    with pytest.raises(connectors.Throttled):
        connectors.patiently(lambda: (_ for _ in ()).throw(connectors.Throttled(500)), 3, waits.append)
    assert waits == [120.0, 120.0]


def test_drift_and_graduation(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    sinks.publish(df, str(tmp_path / "s"))
    assert not sinks.has_drifted(spark, df, str(tmp_path / "s")) and sinks.has_drifted(spark, df.unionByName(df), str(tmp_path / "s"))
    c = spark.createDataFrame([("a", "v", 0.9, None), ("b", "v", 0.6, "p"), ("c", "v", 0.1, "p"), ("d", None, None, None), ("e", "v", 0.9, None)], "id string, f string, f_confidence double, f_payload string")
    got = sinks.graduated(c, ["f"], c.filter("id = 'e'").select("id")).orderBy("id").collect()
    assert [(r.id, r.f, r.review_required) for r in got] == [("a", "v", []), ("b", "v", []), ("c", "p", []), ("d", None, ["f"])]


def test_streams(spark, tmp_path):
    rows = [Row(id=1, source="s", url="u", title="t", ts=dt.datetime(2024, 1, 1)), Row(id=2, source="s", url="u", title="t", ts=dt.datetime(2024, 1, 1, 1)), Row(id=3, source="s", url="v", title=None, ts=dt.datetime(2024, 1, 1, 2))]
    df = spark.createDataFrame(rows)
    df.write.parquet(str(tmp_path / "in"))
    stream = flows.files(spark, str(tmp_path / "in"), df.schema)
    flows.run_available(flows.deduplicated(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u", "v"]
    flows.run_available(flows.deduplicated(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_plans_have_no_cartesian_product(spark):
    from tarnwork.plans import catalog

    for name in ("membership_reach", "text_mention_join", "range_join_bands", "asof_last_event", "integrity_anti_joins"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_registry_without_the_subpackage():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_blocks_of_vectors_do_not_multiply_with_the_table(spark):
    """Each copy of a vector is shuffled: their number is that of the blocks, which stays the same beyond a size."""
    from tarnwork.operators import density as D

    n = 20_000
    df = spark.range(n).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("v"))
    points = df.select(F.lit(0).cast("long").alias("part"), F.col("id").alias("node"), "v")
    for out in (V.all_pairs_top_k(df, "id", "v", 2), D.neighbours(points, 2)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" in plan and max(int(x) for x in re.findall(r"pmod\(xxhash64\([^)]*\), (\d+)\)", plan)) <= 8


def test_ties_within_a_tile_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 64)
    df = spark.createDataFrame([(i, [1.0, 0.0] if i < 20 else [0.0, 1.0]) for i in range(40)] + [(40, [float("nan"), 1.0])], "id long, v array<double>")
    got = {}
    for r in V.all_pairs_top_k(df, "id", "v", 3, block=16).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    want = lambda i: [x for x in range(0 if i < 20 else 20, 40) if x != i][:3]
    assert {i: [x for _, x in sorted(v)] for i, v in got.items()} == {i: want(i) for i in range(40)}


def test_pairs_of_sets_are_counted_in_blocks_not_shuffled(spark):
    r = random.Random(3)
    sets = {f"s{i}": {r.randrange(30) for _ in range(r.randrange(1, 9))} for i in range(60)}
    df = spark.createDataFrame([(a, e) for a, es in sets.items() for e in es] + [("s0", None), ("s1", None), (None, 3)], "a string, e int")
    size = {a: len(es) + (a in ("s0", "s1")) for a, es in sets.items()}
    want = {(a, b): len(sets[a] & sets[b]) / (size[a] + size[b] - len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    out = V.jaccard_pairs(df, "a", "e", most=50)
    assert {(r.a, r.b): r.similarity for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_suppliers_are_compared_by_brands(spark, tmp_path):
    """Two suppliers that share a brand but no part are a pair."""
    spark.createDataFrame([(1, 10), (2, 20)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, "b"), (20, "b")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in catalog.QUERIES["pairwise_jaccard"](spark, str(tmp_path)).collect()] == [(1, 2, 1.0)]
