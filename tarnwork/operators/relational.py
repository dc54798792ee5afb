"""Merges, duplicate lookups, keepers, ranking and counting: frames in, frames out.

Every "first wins" has a total order, and every membership join is an explode with an equi-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored
from ..functions import text as X


def first_rows(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order. [J10 A22 K02]"""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """[O04] The first k rows of each key, numbered in ``rank``; the planner limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def latest(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """[J10] The latest row of each key, by a combined maximum instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(when, tie)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """[K01] Rows of the batch whose key the target lacks, one for each key."""
    return first_rows(batch.join(target.select(*keys).distinct(), keys, "left_anti"), keys, order)


def upsert_latest(target: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """[K02] The last writer of each key."""
    return first_rows(target.unionByName(batch), keys, order)


def upsert_nonnull(target: DataFrame, batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """[K03] Per column the last value of the batch that is not null, else what is stored."""
    cols = [c for c in target.columns if c not in keys]
    new = batch.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(f"_new_{c}") for c in cols])
    return target.join(new, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in cols])


def set_status(df: DataFrame, key: str, changes: DataFrame, now: Column) -> DataFrame:
    """[K04 T05] changes(key, new_status, new_reviewer, new_graduated_to); only a decision stamps the time of review."""
    joined = df.join(changes, key, "left")
    decided = F.col("new_status").isin("reviewed", "accepted", "rejected", "graduated")
    put = {"status": F.coalesce("new_status", "status"), "reviewer": F.coalesce("new_reviewer", "reviewer"), "graduated_to": F.coalesce("new_graduated_to", "graduated_to"), "reviewed_at": F.when(decided, now).otherwise(F.col("reviewed_at"))}
    return joined.select(*[put.get(c, F.col(c)).alias(c) for c in df.columns])


def patch_map(old: Column, patch: Column) -> Column:
    """[K05] A shallow merge; the patch wins."""
    return F.when(patch.isNull(), old).when(old.isNull(), patch).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch))


def append_new(old: Column, new: Column) -> Column:
    """[K08] The old list, then sorted what it lacks."""
    old = F.coalesce(old, F.array().cast("array<string>"))
    return F.concat(old, F.array_sort(F.array_distinct(F.array_except(new, old))))


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """[K09] Rows of either side that the other lacks; empty means no drift."""
    return before.exceptAll(after).withColumn("side", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("side", F.lit("added")))


def consecutive_new(df: DataFrame, same: list[str], *order: str | Column, by: list[str] = ()) -> DataFrame:
    """[K06 W07] Rows that differ from the row before them."""
    w = Window.partitionBy(*by).orderBy(*order)
    repeat = reduce(lambda a, b: a & b, [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in same]) & F.lag(F.lit(1)).over(w).isNotNull()
    return df.withColumn("_repeat", repeat).filter("not _repeat").drop("_repeat")


def keepers(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """[W01] keeper: the lowest id of the rows with one key; a null key stands alone."""
    keyed = df.withColumn("_key", F.coalesce(key, F.concat(F.lit("__nokey_"), F.col(id_col).cast("string"))))
    least = keyed.groupBy("_key").agg(F.min(id_col).alias("keeper"), F.count("*").alias("copies"))
    return keyed.join(least, "_key").drop("_key").withColumn("is_keeper", F.col(id_col) == F.col("keeper"))


def prioritised_lookup(probe: DataFrame, probe_id: str, index: DataFrame, keys: list[tuple[str, Column, Column]], order: Column) -> DataFrame:
    """[J01 J03 J26] (probe columns, hit, hit_by): the first of several keys that finds an entry.

    ``keys``: (name, key of the probe, key of the index).  Of entries under one key the first in ``order`` counts.
    """
    out = probe
    for name, left, right in keys:
        entry = first_rows(index.withColumn("_k", right).filter("_k is not null"), ["_k"], order).select(F.col("_k").alias(f"_k_{name}"), F.col("id").alias(f"_hit_{name}"))
        out = out.withColumn(f"_p_{name}", left).join(entry, F.col(f"_p_{name}") == F.col(f"_k_{name}"), "left").drop(f"_p_{name}", f"_k_{name}")
    hits = [F.col(f"_hit_{n}") for n, _, _ in keys]
    by = F.coalesce(*[F.when(F.col(f"_hit_{n}").isNotNull(), F.lit(n)) for n, _, _ in keys])
    return out.withColumn("hit", F.coalesce(*hits)).withColumn("hit_by", by).drop(*[f"_hit_{n}" for n, _, _ in keys])


def novelty(probe: DataFrame, known_ids: Column, new_ids: Column, hit: Column, newer: Column) -> DataFrame:
    """[J03] outcome: unknown items go on, known ones with new evidence update, others drop."""
    fresh = F.array_except(new_ids, F.coalesce(known_ids, F.array().cast("array<string>")))
    return probe.withColumn("new_evidence", fresh).withColumn("outcome", F.when(hit.isNull(), F.lit("continue")).when((F.size(fresh) > 0) | F.coalesce(newer, F.lit(False)), F.lit("update_queue")).otherwise(F.lit("drop")))


def matched(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """[J04 J18] A flag for rows whose key is known."""
    return df.join(ids.select(key).distinct().withColumn("_known", F.lit(True)), key, "left").withColumn("matched", F.coalesce("_known", F.lit(False))).drop("_known")


def prefix_join(left: DataFrame, left_text: str, right: DataFrame, right_prefix: str, length: int, order: str) -> DataFrame:
    """[J09] The row of ``right`` whose text the left text starts with: the longest, then the first.

    Prefixes have ``length`` characters at least, and those lead to an equi-join; the rest is compared after it.
    """
    a = left.withColumn("_head", F.left(F.col(left_text), F.lit(length)))
    b = right.withColumn("_head", F.left(F.col(right_prefix), F.lit(length)))
    hit = a.join(b, "_head").filter(F.startswith(F.col(left_text), F.col(right_prefix))).drop("_head")
    return first_rows(hit, left.columns, F.length(right_prefix).desc(), F.col(order))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """The values of the latest right row at or before each left row, in one shuffle: both sides in one ordered window."""
    cols = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_right"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*keys, *[F.col("_left")[c].alias(c) for c in cols], *[F.col("_right")[v].alias(v) for v in values])


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: float, keys: list[str] = ()) -> DataFrame:
    """Points within [low, high): ranges are dealt to buckets of ``width``, so it is an equi-join on the bucket."""
    a = points.withColumn("_bucket", F.floor(F.col(point) / width))
    b = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, [*keys, "_bucket"]).filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def counts(df: DataFrame, *keys: str, as_: str = "n") -> DataFrame:
    """[A01]"""
    return df.groupBy(*keys).agg(F.count("*").alias(as_))


def share_of_total(df: DataFrame, key: str, missing: str = "<unknown>") -> DataFrame:
    """[A11] n and share of each value; the total is one row that is joined, not a window over all rows."""
    n = df.groupBy(F.coalesce(key, F.lit(missing)).alias(key)).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_total")))).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def projected_counts(now: DataFrame, moved: DataFrame, status: str = "status", to: str = "duplicate") -> DataFrame:
    """[A03] Counts by status after ``moved(status, m)`` have gone to ``to``; none below one."""
    total = moved.agg(F.lit(to).alias(status), F.sum("m").alias("gain"))
    out = now.join(moved, status, "full_outer").join(total, status, "full_outer")
    return out.select(status, (F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)) + F.coalesce("gain", F.lit(0))).cast("long").alias("n")).filter("n > 0")


def merge_slices(df: DataFrame, key: str, slice_col: str, most: list[str], first: list[str], order: str) -> DataFrame:
    """[A05 A06] Largest numbers, first texts that are not empty, and all slices of each key."""
    aggs = [F.max(c).alias(c) for c in most] + [F.min_by(c, F.when(X.blank_to_null(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return df.groupBy(key).agg(*aggs, F.array_sort(F.collect_set(slice_col)).alias("slices"))


def best_with_origins(df: DataFrame, key: str, score: str, tie: str, value: str, origin: str) -> DataFrame:
    """[A13] The best occurrence of each key, the first of equals, and where it occurs at all."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(F.col(score), (-F.col(tie)).alias("_t"))).alias("best"), F.max(score).alias("best_score"), F.array_sort(F.collect_set(origin)).alias("origins"))


def fused(scores: DataFrame, doc: str, query: str, score: str, docs: DataFrame) -> DataFrame:
    """[A15 J11] Maximum, mean over the scores there are, and best query; documents without a score have 0, 0 and ''."""
    best = scores.groupBy(doc).agg(F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.min_by(query, F.struct(-F.col(score), F.col(query))).alias("best_query"))
    return docs.select(doc).join(best, doc, "left").select(doc, F.coalesce("max_score", F.lit(0.0)).alias("max_score"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("best_query", F.lit("")).alias("best_query"))


def unique_ids(df: DataFrame, base: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """[W05] base, base-2, base-3 and on, after the ids of that base that are taken."""
    used = None
    if taken is not None:
        stem, number = F.regexp_replace("id", r"-\d+$", ""), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("id", r"-(\d+)$", 1), F.lit("")), F.lit("999999")).cast("long"), F.lit(1))
        used = taken.select(stem.alias(base), number.alias("_n")).unionByName(taken.select(F.col("id").alias(base), F.lit(1).cast("long").alias("_n"))).groupBy(base).agg(F.max("_n").alias("_used"))
    out = df.withColumn("_k", F.row_number().over(Window.partitionBy(base).orderBy(order)))
    out = out.join(used, base, "left") if used is not None else out.withColumn("_used", F.lit(0))
    k = F.col("_k") + F.coalesce("_used", F.lit(0))
    return out.withColumn("unique_id", F.when(k == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), k.cast("string")))).drop("_k", "_used")


def running_budget(df: DataFrame, by: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """[W08] spent so far, the row that goes over counted; state: ok, tripped or refused."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(cost).over(w)
    return df.withColumn("spent", spent).withColumn("state", F.when(F.col("spent") <= cap, F.lit("ok")).when(F.col("spent") - F.col(cost) <= cap, F.lit("tripped")).otherwise(F.lit("refused")))


def carried_forward(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """[W09 S18] The last value so far that is not null."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def minmax(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """[W10 A31] Columns scaled to 0 to 1 within a group; a group without spread is 0.5."""
    spans = df.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(spans, by)
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(f"{c}_scaled", F.when(hi == lo, F.lit(0.5)).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0))))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def groups_by_best(df: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """[W02 W03 O08] Groups in the order of their best member, members in their own order, numbered throughout."""
    best = df.groupBy(group).agg(F.max(score).alias("group_best"))
    inner = Window.partitionBy(group).orderBy(F.desc(score), name)
    return df.join(best, group).withColumn("place", F.row_number().over(inner)).orderBy(F.desc("group_best"), group, "place")


def work_queue(df: DataFrame, n: int, first: str, second: str, created: str, tie: str) -> DataFrame:
    """[O01] What to look at next; a missing score sorts as -1."""
    return df.orderBy(F.coalesce(first, F.lit(-1.0)).desc(), F.coalesce(second, F.lit(-1.0)).desc(), F.col(created), F.col(tie)).limit(n)


def bucketed_order(df: DataFrame, bucket: str, order: list[str], *then: Column) -> list[Column]:
    """[O03 O06] Sort keys: named buckets in a given order, then the rest."""
    return [F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(b) for b in order]), F.col(bucket)), F.lit(0)), F.lit(len(order) + 1)), *then]


def accept_in_order(df: DataFrame, order: list[str] | str, keys: list[str], limit: int | None = None, descending: bool = False) -> DataFrame:
    """[A23] The rows that a walk in ``order`` accepts: each unless it shares a key with one accepted before, until ``limit``.

    Exact, without the walk: a row that comes first at all its keys among those still open is accepted, rows that share a key
    with it are refused, and the next round looks at what is left.  A round is grouped minima and joins by key; a key that
    very many rows share is settled in the round in which its first row is.  Null keys are shared with none, a row without
    keys is always accepted.  Rows equal in ``order`` go by their keys.
    """
    by = [order] if isinstance(order, str) else order
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    rank = F.struct(*[(-F.col(c) if descending else F.col(c)).alias(f"o{i}") for i, c in enumerate(by)], *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keys)], "_row")
    named = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))) for i, c in enumerate(keys)])
    live = stored(rows.select("_row", rank.alias("rank"), F.explode(F.array_compact(named)).alias("key")))
    taken = [rows.filter(reduce(Column.__and__, [F.col(c).isNull() for c in keys])).select("_row")]
    while True:
        first = live.groupBy("key").agg(F.min("rank").alias("first"))
        told = stored(live.join(first, "key").select("_row", "key", (F.col("rank") == F.col("first")).alias("leads")))
        won = stored(told.groupBy("_row").agg(F.min("leads").alias("leads")).filter("leads").select("_row"))
        if won.isEmpty():
            break
        taken.append(won)
        held = told.join(won, "_row", "left_semi").select("key").distinct()
        out = told.join(held, "key", "left_semi").select("_row").distinct()
        live = stored(live.join(out, "_row", "left_anti"))
    accepted = rows.join(reduce(DataFrame.union, taken), "_row", "left_semi").withColumn("_rank", rank)
    accepted = accepted.orderBy("_rank").limit(limit) if limit is not None else accepted
    return accepted.select(df.columns)


def sources_of(df: DataFrame, entity: str, source: str, *carried: str) -> DataFrame:
    """[A04] (entity, sources, source_count, carried...): the distinct sources that name an entity, in order.

    Pairs are made distinct before they are gathered, so an array is as long as an entity has sources.  Of the carried
    columns the least value stays.  Null sources do not count; an entity without any has an empty array.
    """
    pairs = df.groupBy(entity, source).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in carried])
    told = pairs.groupBy(entity).agg(F.array_sort(F.collect_list(source)).alias("sources"), *[F.min(c).alias(c) for c in carried])
    return told.withColumn("source_count", F.size("sources").cast("long"))


def by_source_count(df: DataFrame, name: str, n: int, *last: str) -> DataFrame:
    """[O02] The first ``n`` by number of sources, then by name in lower case (none: as an empty one), then by ``last``, with their rank."""
    order = [F.desc(F.coalesce("source_count", F.lit(0))), F.lower(F.coalesce(name, F.lit(""))), *last]
    top = df.orderBy(*order).limit(n)
    # at most n rows
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def match_order(tool: str, paper: str, confidence: str, rule: str) -> list[Column]:
    """[O09] The order of matches: tool, paper, the more certain first, rule."""
    return [F.col(tool).asc(), F.col(paper).asc(), F.col(confidence).desc(), F.col(rule).asc()]


def universe(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """[U01] (id, in): every id that one of the named (frame, column) has, each once, with the names that have it, in order."""
    parts = [df.select(F.col(c).cast("string").alias("id"), F.lit(k).alias("k")).filter("id IS NOT NULL").distinct() for k, (df, c) in frames.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("in"))


def common(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """[U03] (id): ids that all (frame, column) have, each once."""
    ids = [df.select(F.col(c).alias("id")).filter("id IS NOT NULL") for df, c in frames]
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), ids[1:], ids[0].distinct())
