"""Edges without their reverse: results, and tasks that do not grow with the table."""

import random

from tarnwork.operators import graph as G


def test_asymmetric_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(G, "EDGES", 100, raising=False)
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(1_500)] + [(None, 3), (None, 3), (4, None), (7, 7), (None, 99), (None, None)]
    known = set(edges)
    ids = [i for i in range(38)]
    want = {(a, b) for a, b in known if b in ids and (a is None or (b, a) not in known)}
    made = G.asymmetric(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(i,) for i in [*ids, 5, None]], "id long")).select("src", "dst")
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want and (None, 3) in want and len(want) > 50
    assert made.rdd.getNumPartitions() >= len(edges) / 100
