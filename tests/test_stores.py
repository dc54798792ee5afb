"""Vector store, memo and sketches."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import sketches
from tarnwork.sources import memo, vector_store


def vectors(n, dim=8):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(n, dim)).astype(np.float32)
    m[3] = 0
    return [(f"n{i}", ["tool", "paper", None][i % 3] if i % 50 else "rare", f"name {i}" if i % 7 else None, ["a", None, "c"] if i % 2 else None, m[i].tolist()) for i in range(n)], m


def test_a_store_gives_back_what_it_got(spark, tmp_path):
    rows, m = vectors(230)
    path = str(tmp_path / "store")
    df = spark.createDataFrame(rows, "id string, type string, name string, cell array<string>, vector array<float>")
    vector_store.save(df, path, rows=16)
    norm = lambda rows: sorted(((r[0], r[1], r[2], tuple(r[3]) if r[3] else None, tuple(np.float32(r[4]).tolist())) for r in rows))
    assert norm(vector_store.load(spark, path).collect()) == norm(rows)
    assert vector_store.blocks(spark, path).agg(F.max(F.size("ids"))).first()[0] < 60
    some = vector_store.load(spark, path, ["rare"])
    assert norm(some.collect()) == norm([r for r in rows if r[1] == "rare"])
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = vector_store.blocks(spark, path, ["rare"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    with pytest.raises(ValueError):
        vector_store.save(df.withColumn("vector", F.when(F.col("id") == "n5", None).otherwise(F.col("vector"))), path)
    # every query against all rows
    queries = spark.createDataFrame([(f"q{i}", m[i].tolist()) for i in range(0, 40)], "query string, vector array<float>")
    got = defaultdict(list)
    for r in vector_store.nearest(spark, path, queries, 4, at_once=16).orderBy("query", "rank").collect():
        got[r["query"]].append(r["id"])
    size = np.linalg.norm(m.astype(float), axis=1)
    for i in range(40):
        with np.errstate(invalid="ignore"):
            s = m.astype(float) @ m[i].astype(float) / (size * size[i])
        want = sorted((j for j in range(230) if np.isfinite(s[j])), key=lambda j: (-round(s[j], 9), f"n{j}"))[:4]
        assert got[f"q{i}"] == [f"n{j}" for j in want]


def test_a_memo_asks_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def call(key):
        asked.add(1)
        return None if key == "3" else f"value {key}"

    fetch = memo.fetcher(call)
    path = str(tmp_path / "memo")
    first = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k long")
    assert sorted(map(tuple, memo.lookup(first, "k", path, fetch).collect()), key=repr) == sorted([(1, "value 1"), (2, "value 2"), (2, "value 2"), (3, None), (None, None)], key=repr)
    after = asked.value
    memo.lookup(first, "k", path, fetch).collect()
    assert asked.value == after
    more = spark.createDataFrame([(3,), (4,)], "k long")
    assert sorted(map(tuple, memo.lookup(more, "k", path, fetch).collect())) == [(3, None), (4, "value 4")]
    assert spark.read.parquet(path).groupBy("key").count().filter("count > 1").isEmpty()
    # a fetch can be a join; keys that it does not answer are remembered as well
    table = spark.createDataFrame([("5", "five")], memo.SCHEMA)
    got = memo.lookup(spark.createDataFrame([(5,), (6,)], "k long"), "k", path, lambda missing: missing.join(table, "key"))
    assert sorted(map(tuple, got.collect())) == [(5, "five"), (6, None)]


def test_sketches_of_days_merge_within_their_bounds(spark):
    rng = np.random.default_rng(8)
    n = 60_000
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(days=int(d)), "g" if h else "h", float(v), int(k), f"i{int(i)}") for d, h, v, k, i in zip(rng.integers(0, 21, n), rng.random(n) < 0.8, rng.lognormal(size=n), rng.integers(0, 30_000, n), rng.zipf(1.5, n) % 5000)]
    rows += [(start, "g", None, None, None), (start, "empty", None, 1, "x")]
    df = spark.createDataFrame(rows, "ts timestamp, g string, v double, k long, i string").repartition(9)
    days = sketches.daily(df, "ts", ["g"], "v", "k", "i")
    got = {(r["week"], r["g"]): r for r in sketches.told(sketches.spans(days, "week", ["g"]), [0.05, 0.5, 0.95], 3).collect()}
    exact = defaultdict(list)
    for ts, g, v, k, i in rows:
        exact[(ts - timedelta(days=ts.weekday())).date(), g].append((v, k, i))
    assert set(got) == set(exact)
    for key, some in exact.items():
        r, values = got[key], np.sort([v for v, *_ in some if v is not None])
        assert r["n"] == len(some)
        keys = len({k for _, k, _ in some} - {None})
        assert abs(r["distinct"] - keys) <= 0.05 * keys
        counts = Counter(i for *_, i in some if i is not None)
        assert [t["item"] for t in r["top"]] == [i for i, _ in sorted(counts.items(), key=lambda x: -x[1])[: len(r["top"])]]
        assert all(abs(t["count"] - counts[t["item"]]) <= max(1, 0.004 * len(some)) for t in r["top"])
        for q, found in zip((0.05, 0.5, 0.95), r["quantiles"] or ()):
            assert abs(np.searchsorted(values, found, "right") / len(values) - q) <= 0.03
    assert got[start.date(), "empty"]["quantiles"] is None


def test_groups_beyond_the_sketches_are_counted(spark):
    """3,000 items in one group are more than a frequent-item sketch tracks, 6,000 more than a distinct sketch holds."""
    rows = spark.range(6000).select(F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 40 as int))").alias("ts"), F.lit(1.0).alias("v"), F.explode(F.array(F.when(F.col("id") < 20, F.lit("s")).otherwise(F.lit(None)), F.lit("b"))).alias("g"), F.col("id").alias("k"))
    rows = rows.unionByName(rows.filter("k = 7")).unionByName(rows.limit(1).withColumn("k", F.lit(None).cast("long"))).filter("g IS NOT NULL OR k >= 20 OR k IS NULL")
    told = sketches.told(sketches.spans(sketches.daily(rows, "ts", ["g"], "v", "k", "k"), "month", ["g"]), [0.5], 1)
    got = {(str(r.month), r.g): (r.n, r.distinct, r.most) for r in sketches.exact(told, sketches.counted(rows, "ts", ["g"], "k"), "month", ["g"]).collect()}
    plain = {}
    for r in rows.collect():
        plain.setdefault((f"{r.ts:%Y-%m}-01", r.g), []).append(r.k)
    want = {k: (len(v), len(set(v) - {None}), max(v.count(x) for x in set(v) - {None})) for k, v in plain.items()}
    assert len(want) == 5 and max(w[1] for w in want.values()) > 4096 and got == want
