"""Agreement and telemetry statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_LABEL = "__null__"


def aligned(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """[J12] (key, a, b): what two raters said of one item; no label is a label of its own."""
    right = b.select(key, F.coalesce(label, F.lit(NULL_LABEL)).alias("b"))
    return a.select(key, F.coalesce(label, F.lit(NULL_LABEL)).alias("a")).join(right, key)


def confusion(pairs: DataFrame) -> DataFrame:
    """[A24] (a, b, n) over the union of labels, zero-filled; labels are few."""
    labels = pairs.select(F.col("a").alias("l")).union(pairs.select("b")).distinct()
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    dense = labels.select(F.col("l").alias("a")).crossJoin(labels.select(F.col("l").alias("b")))
    return dense.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def kappa(pairs: DataFrame) -> DataFrame:
    """[A25] (kappa): Cohen's kappa from the counts alone; 1 with fewer than two labels."""
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    pe = n.groupBy("a").agg(F.sum("n").alias("na")).join(n.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("nb")), "a").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("e"))
    t = F.col("t").cast("double")
    po, pe_ = F.col("same") / t, F.col("e") / (t * t)
    return total.crossJoin(pe).select(F.when(pe_ == 1, F.lit(1.0)).otherwise((po - pe_) / F.nullif(1 - pe_, F.lit(0.0))).alias("kappa"))


def label_kappas(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """[A25] (label, kappa) of each label against the rest, over array columns a and b; null if neither rater used it."""
    rows = pairs.crossJoin(F.broadcast(labels.select("label")))
    x, y = F.array_contains("a", F.col("label")).cast("int"), F.array_contains("b", F.col("label")).cast("int")
    s = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"))
    n = F.col("n").cast("double")
    po = (n - F.col("x") - F.col("y") + 2 * F.col("xy")) / n
    pe = (F.col("x") * F.col("y") + (n - F.col("x")) * (n - F.col("y"))) / (n * n)
    return s.select("label", F.when((F.col("x") == 0) & (F.col("y") == 0), None).when(pe == 1, F.lit(1.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def mean_jaccard(a: Column, b: Column) -> Column:
    """[A26] Of two sets in each row; two empty ones agree."""
    union = F.size(F.array_union(a, b))
    return F.avg(F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0))))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """[A27] (ari, nmi) of two labelings from their contingency table, rounded to 4; the mean of entropies normalises."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra, rb = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    total = n.agg(F.sum("n").cast("double").alias("t"), F.sum(two("n")).alias("s"))
    sa = ra.agg(F.sum(two("na")).alias("sa"), F.sum(F.col("na") * F.log("na")).alias("la"))
    sb = rb.agg(F.sum(two("nb")).alias("sb"), F.sum(F.col("nb") * F.log("nb")).alias("lb"))
    mutual = n.join(ra, "a").join(rb, "b").agg(F.sum(F.col("n") * F.log(F.col("n") / (F.col("na").cast("double") * F.col("nb")))).alias("m"))
    t = F.col("t")
    expected = F.col("sa") * F.col("sb") / F.nullif(t * (t - 1) / 2, F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(top == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / F.nullif(top - expected, F.lit(0.0)))
    ha, hb = F.log(t) - F.col("la") / t, F.log(t) - F.col("lb") / t
    mi = F.col("m") / t + F.log(t)
    nmi = F.when((ha + hb) == 0, F.lit(1.0)).otherwise(mi / F.nullif((ha + hb) / 2, F.lit(0.0)))
    return total.crossJoin(sa).crossJoin(sb).crossJoin(mutual).select(F.round(ari, 4).alias("ari"), F.round(nmi, 4).alias("nmi"))


def majority(df: DataFrame, key: str, label: str, ignored: str | None = None) -> DataFrame:
    """[A20] (key, label, votes): the most frequent label, ties by name; an ignored label wins only alone."""
    n = df.groupBy(key, label).agg(F.count("*").alias("votes"))
    last = (F.col(label) == ignored).cast("int") if ignored is not None else F.lit(0)
    best = n.groupBy(key).agg(F.min(F.struct(last.alias("_x"), (-F.col("votes")).alias("_n"), F.col(label).alias("_l"))).alias("b"))
    return best.select(key, F.col("b._l").alias(label), (-F.col("b._n")).alias("votes"))


def cluster_summary(df: DataFrame, cluster: str, label: str, member: str, weight: str) -> DataFrame:
    """[A21] size, top label and share, spread, whether labels differ, representative and members of each cluster."""
    size = df.groupBy(cluster).agg(F.count("*").alias("size"), F.count_distinct(label).alias("spread"), F.max_by(member, F.struct(F.col(weight), F.col(member))).alias("representative"), F.array_sort(F.collect_set(member)).alias("members"))
    return size.join(majority(df, cluster, label), cluster).select(cluster, "size", F.col(label).alias("top_label"), F.round(100 * F.col("votes") / F.col("size"), 1).alias("top_share"), "spread", (F.col("spread") > 1).alias("disagrees"), "representative", "members")


def top_disagreements(summary: DataFrame, cluster: str, n: int, noise: object = -1) -> DataFrame:
    """[O10]"""
    return summary.filter((F.col(cluster) != noise) & (F.col("size") > 1) & F.col("disagrees")).orderBy(F.desc("size"), F.desc("spread"), "top_share", cluster).limit(n)


def pair_flows(df: DataFrame, columns: list[str]) -> DataFrame:
    """[A34] (step, source, target, n) between neighbouring columns."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")) for i, (a, b) in enumerate(zip(columns[:-1], columns[1:], strict=True))]))
    return df.select(steps.alias("s")).groupBy("s.step", "s.source", "s.target").agg(F.count("*").alias("n"))


def margins(scores: DataFrame, key: str, label: str, score: str, **bands: float) -> DataFrame:
    """[W04] (key, label, confidence): the best label by its lead; a tie has none."""
    from ..functions.scoring import margin_confidence

    w = Window.partitionBy(key).orderBy(F.desc(score), label)
    top = scores.withColumn("_r", F.row_number().over(w)).withColumn("_s", F.lead(score).over(w)).filter("_r = 1")
    tie = F.col("_s").isNotNull() & (F.col("_s") == F.col(score))
    return top.select(key, F.when(~tie & (F.col(score) > 0), F.col(label)).alias(label), margin_confidence(F.col(score), F.col("_s"), **bands).alias("confidence"))


def bootstrap(df: DataFrame, key: str, replicates: int = 10, share: float = 0.85, seed: int = 20260422) -> DataFrame:
    """[A28] (replicate, key): resamples without replacement; each keeps the rows with the smallest seeded hashes."""
    draws = df.select(key).crossJoin(F.broadcast(df.sparkSession.range(replicates).toDF("replicate"))).withColumn("_h", F.xxhash64(F.lit(seed), "replicate", key))
    cut = draws.groupBy("replicate").agg(F.percentile_approx("_h", F.lit(share), F.lit(100_000)).alias("_cut"))
    return draws.join(F.broadcast(cut), "replicate").filter("_h <= _cut").select("replicate", key)


def session_windows(events: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """[T08] (by, start, end, n): sessions by event time."""
    return events.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding_windows(events: DataFrame, by: str, ts: str, size: str, slide: str) -> DataFrame:
    return events.groupBy(by, F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
