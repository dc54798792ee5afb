"""Duplicate memory and lifecycle over restarts from their checkpoints."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.streaming import memory as M

DAY = timedelta(days=1)
T0 = datetime(2024, 1, 1)


def add(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, flow, folder, schema, tmp_path):
    M.run_once(flow(M.folder(spark, str(folder), schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_duplicates_days_apart_after_a_restart(spark, tmp_path):
    schema = "id long, ts timestamp, address string, name string"
    add(spark, [(2, T0 + DAY, "a", "x"), (1, T0, "a", "y"), (3, T0, "b", "x"), (4, T0, None, "z"), (5, T0, "c", "")], schema, tmp_path / "in")
    got = {r["id"]: (r["rule"], r["duplicate_of"]) for r in run(spark, M.remembered, tmp_path / "in", schema, tmp_path).collect()}
    assert got == {1: (None, None), 2: ("address", 1), 3: (None, None), 4: (None, None), 5: (None, None)}
    # another run, hundreds of days on
    late = T0 + 400 * DAY
    add(spark, [(10, late, "a", "new"), (11, late, "d", "x"), (12, late, "e", "x"), (13, late, None, "z"), (14, late, "f", ""), (15, late, "c", "q"), (16, late, "g", "new")], schema, tmp_path / "in")
    got = {r["id"]: (r["rule"], r["duplicate_of"]) for r in run(spark, M.remembered, tmp_path / "in", schema, tmp_path).filter("id >= 10").collect()}
    assert got == {10: ("address", 1), 11: ("name", 3), 12: ("name", 3), 13: ("name", 4), 14: (None, None), 15: ("address", 5), 16: (None, None)}


def test_lifecycle_expires_and_forgets(spark, tmp_path):
    schema = "id long, to string, ts timestamp, seq long"
    flow = lambda df: M.lifecycle(df, "1 hour", 30 * DAY, 90 * DAY)
    add(spark, [(1, "reviewed", T0, 0), (1, "accepted", T0, 1), (2, "graduated", T0, 0), (3, "rejected", T0, 0)], schema, tmp_path / "in")
    got = sorted(tuple(r)[:3] for r in run(spark, flow, tmp_path / "in", schema, tmp_path).collect())
    assert got == [(1, "accepted", 0), (2, "pending", 1), (3, "rejected", 0)]
    # 40 days on: 1 and 2 waited too long, 3 is closed and kept
    add(spark, [(4, "reviewed", T0 + 40 * DAY, 0), (3, "reviewed", T0 + 40 * DAY, 0)], schema, tmp_path / "in")
    got = sorted(tuple(r) for r in run(spark, flow, tmp_path / "in", schema, tmp_path).filter(F.col("at") > T0 + 20 * DAY).collect())
    assert got == [(1, "expired", 0, T0 + 30 * DAY), (2, "expired", 1, T0 + 30 * DAY), (3, "rejected", 1, T0 + 40 * DAY), (4, "reviewed", 0, T0 + 40 * DAY)]
    # a forgotten candidate starts anew; 4 expires, and 3 is forgotten without a word
    add(spark, [(1, "reviewed", T0 + 140 * DAY, 0)], schema, tmp_path / "in")
    got = sorted(tuple(r) for r in run(spark, flow, tmp_path / "in", schema, tmp_path).filter(F.col("at") > T0 + 50 * DAY).collect())
    assert got == [(1, "reviewed", 0, T0 + 140 * DAY), (4, "expired", 0, T0 + 70 * DAY)]
    add(spark, [(3, "graduated", T0 + 141 * DAY, 0)], schema, tmp_path / "in")
    got = run(spark, flow, tmp_path / "in", schema, tmp_path).filter(F.col("at") == T0 + 141 * DAY).collect()
    assert [tuple(r)[:3] for r in got] == [(3, "pending", 1)]


@pytest.fixture(autouse=True)
def one_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_memory_is_called_by_bucket_not_by_key(spark, tmp_path):
    """2,000 addresses and names: a call for each took minutes at 100,000."""
    schema = "id long, ts timestamp, address string, name string"
    rows = [(i, T0 + DAY * (i % 3), f"a{i % 1500}", f"n{i % 1700}") for i in range(2000)]
    add(spark, rows, schema, tmp_path / "in")
    firsts = {}
    want = {}
    for rule, k in (("address", 2), ("name", 3)):
        for r in sorted((r for r in rows if r[0] not in want), key=lambda r: (r[1], r[0])):
            if firsts.setdefault((rule, r[k]), r[0]) != r[0]:
                want[r[0]] = (rule, firsts[rule, r[k]])
    out = run(spark, M.remembered, tmp_path / "in", schema, tmp_path)
    assert {r["id"]: (r["rule"], r["duplicate_of"]) for r in out.collect()} == {i: want.get(i, (None, None)) for i in range(2000)}
    flow = M.remembered(M.folder(spark, str(tmp_path / "in"), schema))
    assert "bucket" in flow._jdf.queryExecution().analyzed().toString()
    moves = spark.readStream.schema("id long, to string, ts timestamp, seq long").parquet(str(tmp_path / "in"))
    assert "bucket" in M.lifecycle(moves)._jdf.queryExecution().analyzed().toString()


def test_candidates_of_one_bucket_expire_each_in_its_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BUCKETS", 1)
    schema = "id long, to string, ts timestamp, seq long"
    flow = lambda df: M.lifecycle(df, "1 hour", 30 * DAY, 90 * DAY)
    add(spark, [(i, "reviewed", T0 + i * DAY, 0) for i in range(20)] + [(30, "rejected", T0, 0)], schema, tmp_path / "in")
    run(spark, flow, tmp_path / "in", schema, tmp_path)
    for day in (40, 45, 50):
        add(spark, [(19, "reviewed", T0 + day * DAY, day)], schema, tmp_path / "in")
        gone = run(spark, flow, tmp_path / "in", schema, tmp_path).filter("status = 'expired'").collect()
        assert sorted((r["id"], r["at"]) for r in gone) == [(i, T0 + (i + 30) * DAY) for i in range(min(day - 30, 19))]
