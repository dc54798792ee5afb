"""[S20 X06 X07] What a service would call: lookups, recommendations, retrieval, and checks of what it publishes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import graph as G
from ..operators import vectors as V
from ..operators.relational import top_k
from ..sources.readers import by_id


def lookup(items: DataFrame, item: str) -> DataFrame:
    """[P04] One item with its defaults; an unknown id fails."""
    empty = F.array().cast("array<string>")
    cols = [F.coalesce(c, empty).alias(c) if t.startswith("array<string") else F.coalesce(c, "id").alias(c) if c == "name" else F.col(c) for c, t in items.dtypes]
    return by_id(items, item, strict=True).select(*cols)


def pool(items: DataFrame, agents: list[str], blocked: list[str], asker: str | None, trending: list[str] = ()) -> DataFrame:
    """[P06 J18] (id, category, reliability, paradigm, mentioned, stars) of what may be recommended."""
    hot = F.col("repository_url").isin(*trending) if trending else F.lit(False)
    ok = S.eligible(F.col("id"), F.col("id").isin(*agents) if agents else F.lit(False), asker in agents, blocked, F.col("addresses"))
    cites = F.greatest(F.coalesce(F.size("cited_in"), F.lit(0)), F.lit(0))
    rel = S.reliability(F.col("stars"), cites, F.col("maturity_status"), F.coalesce(hot, F.lit(False)))
    rows = items.filter(ok).withColumn("category", F.explode("addresses"))
    mentioned = F.contains(F.lower(F.coalesce("inclusion_rationale", F.lit(""))), F.regexp_replace("category", "_", " "))
    return rows.select("id", "category", rel.alias("reliability"), F.col("control_paradigm").alias("paradigm"), mentioned.alias("mentioned"), S.effective_stars(F.col("stars"), F.coalesce(hot, F.lit(False))).alias("stars"))


def recommend(items: DataFrame, weights: DataFrame, k: int, agents: list[str] = (), blocked: list[str] = (), asker: str | None = None) -> list[dict]:
    """[A35] A set of k items that covers the weightiest categories."""
    return G.greedy_cover(pool(items, list(agents), list(blocked), asker), weights, k)


def recommend_for(items: DataFrame, categories: list[str], k: int = 3, preference: tuple[str, ...] = ("prevention", "detection", "correction", "recovery")) -> DataFrame:
    """[O04] The k items for each category: by paradigm, mention in the rationale, and stars."""
    rows = pool(items, [], [], None).filter(F.col("category").isin(*categories))
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("paradigm")), F.lit(0)), F.lit(len(preference) + 1))
    return top_k(rows, ["category"], k, order, F.desc("mentioned"), F.desc("stars"), F.col("id")).select("category", "rank", "id")


def retrieve(store: DataFrame, question: list[float], k: int = 20, extra: int = 8, pipeline: bool = False) -> DataFrame:
    """[J22] The k nearest of store(id, type, friendly, v); a question about pipelines gets more of the tools that fit there."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "id")
    ranked = lambda df, n: V.nearest(df, "id", "v", question, n).withColumn("rank", F.row_number().over(w)).select("id", "rank")
    base = ranked(store, k)
    return V.hybrid(base, ranked(store.filter("type = 'tool' and friendly"), k + extra), "id", k, extra) if pipeline else base


def unresolved(published: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """[X07] Published ids that do not exist; none should."""
    return published.select(key).distinct().join(known.select(key), key, "left_anti")


def register_tables(spark: SparkSession, items: DataFrame) -> None:
    """[X06 X08] ``item_by_id(id)`` and ``items_for(category)`` as SQL table functions over the view ``items``."""
    items.createOrReplaceTempView("items")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION item_by_id(x STRING) RETURNS TABLE (id STRING, name STRING, stars INT) RETURN SELECT id, name, stars FROM items WHERE id = x")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION items_for(x STRING) RETURNS TABLE (id STRING, stars INT) RETURN SELECT id, stars FROM (SELECT id, stars, explode(addresses) AS c FROM items) WHERE c = x")
