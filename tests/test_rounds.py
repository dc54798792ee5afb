"""Acceptance in order and strong components against plain walks."""

import random

from tarnwork.operators import graph as G
from tarnwork.operators import relational as R


def plain_accept(rows, keys, limit=None):
    seen, out = set(), []
    for r in rows:
        own = {(k, r[k]) for k in keys if r[k] is not None}
        if not own & seen and (limit is None or len(out) < limit):
            out.append(r["r"])
            seen |= own
    return out


def test_acceptance_against_a_walk(spark):
    rng = random.Random(7)
    # a hot value of one key, long chains through the other, nulls
    rows = [{"r": i, "p": rng.choice(["hot", f"p{rng.randrange(150)}", None]), "q": rng.choice([f"q{i // 2}", f"q{rng.randrange(200)}", None])} for i in range(400)]
    df = spark.createDataFrame(rows, "r int, p string, q string").repartition(5)
    assert sorted(r["r"] for r in R.accept_in_order(df, "r", ["p", "q"]).collect()) == plain_accept(rows, ["p", "q"])
    assert sorted(r["r"] for r in R.accept_in_order(df, "r", ["p", "q"], 9).collect()) == plain_accept(rows, ["p", "q"], 9)
    assert sorted(r["r"] for r in R.accept_in_order(df, "r", ["p", "q"], descending=True).collect()) == sorted(plain_accept(rows[::-1], ["p", "q"]))
    assert R.accept_in_order(df.limit(0), "r", ["p"]).count() == 0


def plain_components(edges):
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    reach = {}
    for a in to:
        seen, queue = set(), [a]
        while queue:
            for b in to.get(queue.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        reach[a] = seen
    on = [a for a in to if a in reach[a]]
    sets = {a: {b for b in on if b in reach[a] and a in reach[b]} for a in on}
    return sorted((a, min(s), len(s)) for a, s in sets.items())


def test_components_against_plain_reach(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(110)]
    edges += [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(300 + i, 301 + i) for i in range(12)] + [(400, 400), (400, 401), (None, 1), (1, None), (5, 5)] + edges[:9]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = plain_components(edges)
    assert sorted(tuple(r) for r in G.strong_components(df).collect()) == want
    assert len({c for _, c, _ in want}) > 3
    assert G.strong_components(df.limit(0)).count() == 0
    assert G.strong_components(df.filter("src >= 300 AND src < 400")).count() == 0
