"""The catalog as a property graph: edges, integrity, reachability, grids, gaps and set cover."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored
from ..functions import scoring as S


def edges(nodes: DataFrame, id_col: str, lists: dict[str, str]) -> DataFrame:
    """[J28 U05] (src, etype, dst), each once, for edge type -> list column."""
    parts = [nodes.select(F.col(id_col).alias("src"), F.lit(t).alias("etype"), F.explode(F.coalesce(c, F.array().cast("array<string>"))).alias("dst")) for t, c in lists.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def with_endpoints(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """[J28] Edges whose both ends exist in ``nodes(id)``."""
    ids = nodes.select("id").distinct()
    return edge.join(ids, edge["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")


def dangling(refs: DataFrame, ref: str, target: DataFrame, key: str, rule: str) -> DataFrame:
    """[J13 J14] (rule, ref): references that lead nowhere, each once."""
    hit = refs.select(F.col(ref).alias("ref")).filter("ref is not null").distinct().join(target.select(F.col(key).alias("ref")).distinct(), "ref", "left_anti")
    return hit.select(F.lit(rule).alias("rule"), F.col("ref").cast("string").alias("ref"))


#: Edges that one task of ``asymmetric`` holds.
EDGES = 250_000


def asymmetric(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """[J15] Edges a to b, each once, b being a node, without b to a.

    Both directions of a pair of ends meet in one task and are one row there.  Tasks grow in number with the edges, so that
    none holds more of a larger table, and nothing is grouped before the shuffle, where hardly any edge stands twice.
    """
    own = edge.select("src", "dst").filter("dst IS NOT NULL")
    tasks = max(1, -(-own.count() // EDGES))
    src, dst = F.col("src"), F.col("dst")
    ends = own.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), src.isNull().alias("lone"), (src <= dst).alias("up"), (src >= dst).alias("down"))
    pairs = ends.repartition(tasks, "a", "b").groupBy("a", "b", "lone").agg(F.bool_or("up").alias("up"), F.bool_or("down").alias("down"))
    one = pairs.filter("lone OR up <> down").select(F.when(~F.col("lone"), F.when(F.col("up"), F.col("a")).otherwise(F.col("b"))).alias("src"), F.when(F.col("lone") | F.col("up"), F.col("b")).otherwise(F.col("a")).alias("dst"))
    ids = nodes.select(F.col("id").alias("dst")).repartition(tasks, "dst")
    return one.repartition(tasks, "dst").join(ids, "dst", "left_semi").select("src", "dst")


def neighbourhood(edge: DataFrame, focus: DataFrame) -> DataFrame:
    """[J23 U06] (id): the focus and all that one edge in either direction reaches."""
    both = edge.select("src", "dst").union(edge.select("dst", "src")).toDF("id", "other")
    return focus.select("id").union(both.join(focus.select("id"), "id", "left_semi").select("other")).distinct()


def reach(spark, edge: DataFrame, most: int | None = None) -> DataFrame:
    """[J16] (src, dst, depth): shortest depth of each pair by joins of the frontier, until it is empty or ``most`` deep.

    Each round is written, as a plan of any number of rounds would be planned anew in each.  The result is the transitive
    closure; for cycles alone ``strong_components`` needs no more than the nodes.
    """
    known = stored(edge.select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    frontier = known
    step = stored(edge.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct())
    for d in count(2) if most is None else range(2, most + 1):
        further = frontier.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = stored(further.subtract(known.select("src", "dst")).withColumn("depth", F.lit(d)))  # null-safe, so that it ends
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def cyclic(spark, edge: DataFrame, most: int | None = None) -> DataFrame:
    """[J16] (id, length): nodes on a cycle and the length of the shortest through each."""
    return reach(spark, edge, most).filter("src = dst").select(F.col("src").alias("id"), F.col("depth").alias("length"))


def strong_components(edge: DataFrame) -> DataFrame:
    """[J16] (id, component, size) of the nodes on a cycle: component is the smallest node of a strongly connected set.

    A set of one counts if its node has an edge to itself.  Null ends are no nodes.

    Rounds of two parts.  Trimming takes away nodes that nothing leads to or that lead nowhere, as long as a pass takes a
    twentieth of the edges.  Colouring lets every node take the smallest node that reaches it; then the nodes of a colour
    that reach its own node are a component, all colours at once, and edges between colours belong to no cycle.  Memory and
    shuffles are a row for each node and edge, never for each pair of nodes; passes grow with the longest shortest path.
    """
    ends = edge.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    ends = stored(ends)
    loops = ends.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    live, found = stored(ends.filter("src <> dst")), []
    n = live.count()
    while n:
        while n:
            inner = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            live, before = stored(inner), n
            n = live.count()
            if before - n < before / 20:
                break
        if not n:
            break
        # the smallest node that reaches each; only nodes that changed pass theirs on
        colour = stored(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("colour", F.col("id")))
        fresh = colour
        while True:
            told = live.join(fresh, live["src"] == fresh["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
            fresh = stored(colour.join(told, "id").filter("new < colour").select("id", F.col("new").alias("colour")))
            if fresh.isEmpty():
                break
            colour = stored(colour.join(fresh.withColumnRenamed("colour", "new"), "id", "left").select("id", F.coalesce("new", "colour").alias("colour")))
        # edges within a colour, walked backwards from its own node
        cs, cd = colour.toDF("src", "colour"), colour.toDF("dst", "colour2")
        live = stored(live.join(cs, "src").join(cd, "dst").filter("colour = colour2").select("src", "dst", "colour"))
        got = stored(colour.filter("id = colour"))
        front, parts = got, [got]
        while True:
            back = live.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "colour").distinct()
            front = stored(back.join(reduce(DataFrame.union, parts), ["id", "colour"], "left_anti"))
            if front.isEmpty():
                break
            parts.append(front)
        all_ = stored(reduce(DataFrame.union, parts))
        found.append(all_.select("id", F.col("colour").alias("component")))
        ids = all_.select("id")
        live = stored(live.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        n = live.count()
    every = reduce(DataFrame.union, [*found, loops.join(reduce(DataFrame.union, found), "id", "left_anti") if found else loops])
    size = every.groupBy("component").agg(F.count("*").alias("size"))
    single = loops.select("id", F.lit(True).alias("loop"))
    return every.join(size, "component").join(single, "id", "left").filter("size > 1 OR loop").select("id", "component", "size")


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """[J07] (src, dst) over (src, mid) and (mid, dst)."""
    return first.join(second, "mid").select("src", "dst").distinct()


def grid(domains: list[DataFrame], facts: DataFrame, keys: list[str], measures: dict[str, Column], fill: dict[str, object]) -> DataFrame:
    """[J06 A07] One cell for each combination of the domains, zero-filled."""
    cells = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), domains)
    found = facts.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    out = cells.join(found, keys, "left")
    return out.select(*keys, *[F.coalesce(n, F.lit(fill[n])).alias(n) if n in fill else F.col(n) for n in measures])


def unit_scores(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """[A16 A17 A18] (unit, score, grade, balanced) of cells(unit, category, paradigm, tier) under weights(category, weight).

    The weighted mean is over all categories that have a weight, also those a unit has no cell for.
    """
    per = cells.groupBy("unit", "category").agg(F.max("tier").alias("best"), F.count_distinct(F.when(F.col("tier") >= 1, F.col("paradigm"))).alias("n")).withColumn("c", S.tier_score(F.col("best"), F.col("n")))
    total = weights.agg(S.exact_sum(F.col("weight")).alias("total"))
    score = per.join(F.broadcast(weights), "category").groupBy("unit").agg(S.exact_sum(F.col("weight") * F.col("c")).alias("s"))
    four = cells.groupBy("unit").agg((F.count_distinct(F.when(F.col("tier") >= 1, F.col("paradigm"))) >= 4).alias("balanced"))
    out = four.join(score, "unit", "left").crossJoin(F.broadcast(total)).withColumn("raw", F.coalesce(F.col("s") / F.nullif("total", F.lit(0.0)), F.lit(0.0)))
    return out.select("unit", F.round("raw", 4).alias("score"), S.grade(F.col("raw")).alias("grade"), "balanced")


# The paradigm that complements one that stands alone.
COMPLEMENT = {"prevention": "detection", "detection": "prevention", "correction": "detection", "recovery": "detection"}


def gaps(categories: DataFrame, cells: DataFrame, complement: dict[str, str] = COMPLEMENT) -> DataFrame:
    """[O06 A38] (category, severity, preferred): none covers it: high; one paradigm alone: medium, with its complement."""
    have = cells.filter("tier > 0").groupBy("category").agg(F.array_sort(F.collect_set("paradigm")).alias("have"))
    out = categories.select("category").join(have, "category", "left").withColumn("n", F.coalesce(F.size("have"), F.lit(0))).withColumn("n", F.greatest("n", F.lit(0)))
    preferred = F.coalesce(*[F.when(F.col("have")[0] == k, F.lit(v)) for k, v in complement.items()])
    return out.filter("n < 2").select("category", F.when(F.col("n") == 0, F.lit("high")).otherwise(F.lit("medium")).alias("severity"), F.when(F.col("n") == 1, preferred).alias("preferred"))


def gap_recommendations(gap: DataFrame, items: DataFrame, stack: list[str], k: int = 3) -> DataFrame:
    """[O05] For each gap the k best items(id, category, paradigm, surfaces, tier, stars)."""
    fit = F.size(F.array_intersect("surfaces", F.array(*[F.lit(s) for s in stack]).cast("array<string>")))
    j = gap.join(items, "category").withColumn("bonus", F.coalesce((F.col("paradigm") == F.col("preferred")).cast("int"), F.lit(0))).withColumn("fit", fit)
    w = Window.partitionBy("category").orderBy(F.desc("bonus"), F.desc("fit"), F.desc("tier"), F.desc(F.coalesce("stars", F.lit(0))), "id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("category", "severity", "rank", "id")


def greedy_cover(pool: DataFrame, weights: DataFrame, k: int) -> list[dict]:
    """[A35] Picks of pool(id, category, reliability): each the largest sum of new weights times (1 + reliability).

    One small job a pick; only the winner reaches the driver.  Ties go to the smallest id; it ends at k picks, at full cover
    or when nothing gains.
    """
    live = pool.join(F.broadcast(weights), "category").select("id", "category", "reliability", "weight").distinct().persist()
    picks, covered = [], []
    for _ in range(k):
        left = live.filter(~F.col("category").isin(*covered)) if covered else live
        best = left.groupBy("id", "reliability").agg(F.sum("weight").alias("gain"), F.collect_set("category").alias("new")).withColumn("score", F.col("gain") * (1 + F.col("reliability"))).filter("score > 0").orderBy(F.desc("score"), "id").limit(1).collect()
        if not best:
            break
        picks.append({"id": best[0]["id"], "score": best[0]["score"], "new": sorted(best[0]["new"])})
        covered += best[0]["new"]
    live.unpersist()
    return picks
