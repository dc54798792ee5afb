"""Shards as written hold every row once; vectors of any size and label."""

from collections import Counter

from tarnwork.llm import embeddings, sharding


def test_written_shards_hold_each_row_once(spark, tmp_path):
    data = [(1, "same " * 20, "c")] * 60 + [(None, "no id " * 10, "d")] * 3 + [(i, f"text {i} " * 9, "e") for i in range(2, 200)] + [(500, None, None), (501, "", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, page string")
    docs = docs.withColumnRenamed("page", "kind")
    sharding.write_shards(docs, 1000, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.kind) for r in got.collect()) == Counter(data)
    sizes = Counter()
    for r in got.collect():
        sizes[r["shard"], r["page"]] += len((r.text or "").encode())
    assert max(sizes.values()) <= 2500  # pages of one key are filled by a hash


def test_vectors_far_from_one(spark):
    rows = [(0, [1e200, 0.0, 0.0, 0.0], "a"), (1, [1.0, 0.0, 0.0, 0.0], "a"), (2, [1e-200, 1e-203, 0.0, 0.0], "a"), (3, [1.0, 0.0, 0.0, 0.0], "b"), (4, [0.0, 1.0, 0.0, 0.0], "a"), (5, [0.0, 0.0, 0.0, 0.0], "a"), (6, None, "a"), (7, [1.0, float("nan"), 0.0, 0.0], "a")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert [got[i][:2] for i in range(8)] == [(2, 0), (2, 0), (2, 0), (0, 3), (0, 4), (0, 5), (0, 6), (0, 7)]
    split = spark.createDataFrame([(0, [1.0, 0.0], 1.5), (1, [1.0, 0.0], 1.25), (2, [1.0, 0.0], 1.5)], "vec_id long, embedding array<double>, label double")
    assert sorted((r.vec_id, r.n_links) for r in embeddings.near_duplicates(split).collect()) == [(0, 1), (1, 0), (2, 1)]
