"""An append-only log: a batch that is sent again does not double it."""

from tarnwork.sources.sinks import append_log


def test_append_log_compares_with_what_it_holds(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "ts string, tool_id string, mechanism string, note string"
    first = spark.createDataFrame([("2024-01-01T10:00", "a", "x", "1"), ("2024-01-01T10:00", "a", "x", "2"), ("2024-01-01T11:00", "a", "x", "3"), ("2024-01-02T09:00", "b", "y", "4")], schema)
    append_log(first, path)
    append_log(first, path)
    append_log(spark.createDataFrame([("2024-01-01T11:00", "a", "x", "again"), ("2024-01-01T12:00", "a", "x", "5"), ("2024-01-03T00:00", "c", "z", "6")], schema), path)
    got = sorted((r.ts, r.tool_id, r.mechanism) for r in spark.read.schema(schema).json(path).collect())
    assert got == [("2024-01-01T10:00", "a", "x"), ("2024-01-01T11:00", "a", "x"), ("2024-01-01T12:00", "a", "x"), ("2024-01-02T09:00", "b", "y"), ("2024-01-03T00:00", "c", "z")]
