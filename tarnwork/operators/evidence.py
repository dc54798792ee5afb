"""Evidence: fuzzy names, mentions in texts, suggestions, completeness, headline picks, checks of changes, external scorers."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from .relational import first_rows


def mentions(papers: DataFrame, fields: list[str], tools: DataFrame, context: list[str]) -> DataFrame:
    """[J08] (paper, tool, rule, confidence, field) of papers(id, fields) and tools(id, name, url, slug).

    Address 1.0, slug 1.0, name 0.9, and a name that is a common word only near one of the context words.  A tool is looked
    for where its name's, slug's or address's first word occurs: an inverted index leads to an equi-join.
    """
    ordinal = {f: i for i, f in enumerate(fields)}
    texts = papers.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.lower(F.coalesce(f, F.lit(""))).alias("text")) for f, i in ordinal.items()])).alias("t")).select(F.col("id").alias("paper"), "t.*")
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    indexed = texts.withColumn("w", F.explode(F.array_distinct(words)))
    first = lambda c: F.get(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.lit(0))
    last = lambda c: F.element_at(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), -1)
    keyed = tools.withColumn("w", F.explode(F.array_distinct(F.array_compact(F.array(first("name"), first("slug"), last("url"))))))
    at = F.instr("text", F.lower("name"))
    near = F.substring("text", F.greatest(at - 200, F.lit(1)), F.length("name") + 400)
    bounded = lambda c: F.rlike(F.col("text"), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(c), F.lit(r"\E(?![\p{L}\p{N}])")))
    about = F.exists(F.array(*[F.lit(c) for c in context]), lambda c: F.contains(near, c)) if context else F.lit(False)
    rules = S.chain([(F.contains("text", F.lower("url")), F.struct(F.lit("url").alias("rule"), F.lit(1.0).alias("confidence"))), (bounded("slug") & F.contains("slug", F.lit("/")), F.struct(F.lit("slug").alias("rule"), F.lit(1.0).alias("confidence"))), (bounded("name") & (F.length("name") >= 5), F.struct(F.lit("name").alias("rule"), F.lit(0.9).alias("confidence"))), (bounded("name") & about, F.struct(F.lit("name_context").alias("rule"), F.lit(0.9).alias("confidence")))], F.lit(None))
    hit = indexed.join(keyed.withColumnRenamed("id", "tool"), "w").withColumn("r", rules).filter("r is not null")
    return first_rows(hit.select("paper", "tool", "r.*", "field", "place"), ["paper", "tool"], F.desc("confidence"), F.col("place"), F.col("rule")).drop("place")


def passages(docs: DataFrame, id_col: str, text: str, items: DataFrame, item_col: str, phrase: str, block_chars: int = 2_000_000) -> DataFrame:
    """[J08] (id, item): the texts that hold each item's phrase anywhere, whole, of any length; empty phrases are nowhere.

    The items go to an automaton in blocks of a bounded size, and each text is read once a block.
    """
    spark, kinds, out = docs.sparkSession, {f.name: f.dataType.simpleString() for f in [*docs.schema, *items.schema]}, None
    schema = f"{id_col} {kinds[id_col]}, {item_col} {kinds[item_col]}"
    kept = docs.filter(F.col(text) != "").select(F.col(id_col).alias(id_col), F.col(text).alias("_text"))

    def block(some: list[tuple]) -> DataFrame:
        held = spark.sparkContext.broadcast(some)  # block_chars bounds it

        def find(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for item, words in held.value:
                automaton.add_word(words, [*automaton.get(words, []), item])
            automaton.make_automaton()
            for batch in batches:
                hits = [(i, sorted({x for _, own in automaton.iter(t) for x in own})) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, own in hits for _ in own], batch.schema.field(0).type), pa.array([x for _, own in hits for x in own])] if any(own for _, own in hits) else [batch.column(0).slice(0, 0), pa.array([], pa.int64() if kinds[item_col] in ("bigint", "int") else pa.string())], [id_col, item_col])

        return kept.mapInArrow(find, schema)

    some, held = [], 0
    for item, words in items.filter(F.col(phrase) != "").select(item_col, phrase).distinct().toLocalIterator():
        if some and held + len(words) > block_chars:
            out = block(some) if out is None else out.unionByName(block(some))
            some, held = [], 0
        some.append((item, words))
        held += len(words)
    if some:
        out = block(some) if out is None else out.unionByName(block(some))
    return spark.createDataFrame([], schema) if out is None else out


def suggestions(items: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """[J27] (id, papers) for items(id, description, cited_in) without papers: rules(ordinal, keyword, paper) whose keyword occurs."""
    lacking = items.filter(F.coalesce(F.size("cited_in"), F.lit(0)) <= 0).withColumn("low", F.lower("description"))
    live = rules.join(known.select(F.col("id").alias("paper")), "paper", "left_semi")
    hit = lacking.join(F.broadcast(live), F.expr("contains(low, lower(keyword))"))  # rules are a short list
    firsts = hit.groupBy("id", "paper").agg(F.min("ordinal").alias("o"))
    return firsts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "paper"))), lambda s: s["paper"]).alias("papers"))


def reverse(df: DataFrame, id_col: str, refs: str) -> DataFrame:
    """[J05 J24 A08] (ref, ids): who refers to each, sorted."""
    return df.select(F.explode(refs).alias("ref"), F.col(id_col).alias("_id")).groupBy("ref").agg(F.array_sort(F.collect_set("_id")).alias("ids"))


def enriched(df: DataFrame, facts: DataFrame, key: str, decision: str) -> DataFrame:
    """[J25] The decision of each row; ``unknown`` where there is none."""
    return df.join(facts.select(key, decision), key, "left").withColumn(decision, F.coalesce(decision, F.lit("unknown")))


def keyword_families(df: DataFrame, id_col: str, text: str, rules: DataFrame) -> DataFrame:
    """(id, class, hits) of rules(class, keyword): substrings, with spaces, hyphens and underscores alike."""
    fold = lambda c: F.regexp_replace(F.lower(c), r"[\s_-]+", " ")
    texts = df.select(id_col, fold(F.col(text)).alias("_t"))
    hit = texts.join(F.broadcast(rules.select("class", fold(F.col("keyword")).alias("_k"))), F.expr("contains(_t, _k)"))
    return hit.groupBy(id_col, "class").agg(F.count("*").alias("hits"))


def inline_and_bulk(inline: DataFrame, bulk: DataFrame) -> DataFrame:
    """[A09 U05] (category, n): mappings(category) from both sources, repeats counted."""
    return inline.select("category").unionByName(bulk.select("category")).groupBy("category").agg(F.count("*").alias("n"))


def taxonomy_completeness(taxonomies: DataFrame, touched: DataFrame) -> DataFrame:
    """[A10] (id, declared, covered, missing) for taxonomies(id, categories) and touched(taxonomy, external_id)."""
    have = touched.groupBy(F.col("taxonomy").alias("id")).agg(F.collect_set("external_id").alias("_have"))
    own = F.transform("categories", lambda c: c["external_id"])
    out = taxonomies.select("id", own.alias("_own")).join(have, "id", "left")
    missing = F.array_except("_own", F.coalesce("_have", F.array().cast("array<string>")))
    return out.select("id", F.size("_own").alias("declared"), (F.size("_own") - F.size(missing)).alias("covered"), F.array_sort(missing).alias("missing"))


def taxonomy_rows(taxonomies: DataFrame, papers: DataFrame) -> DataFrame:
    """[J19] One row a category, in order, with the citations of the taxonomy's paper (0 without one)."""
    cites = papers.select(F.col("id").alias("paper_id"), F.col("citation_count").alias("_n"))
    return taxonomies.select(F.col("id").alias("taxonomy"), "paper_id", F.posexplode("categories").alias("place", "c")).join(cites, "paper_id", "left").select("taxonomy", "place", "c.*", F.coalesce("_n", F.lit(0)).alias("citations"))


def top_authors(df: DataFrame, score: str, tie: str, authors: str = "authors", rows: int = 120, most: int = 40) -> DataFrame:
    """[A14] Authors of the best rows by the sum of scores, then by their number of rows."""
    best = df.orderBy(F.desc(score), tie).limit(rows)
    return best.select(F.explode(authors).alias("author"), score).groupBy("author").agg(F.sum(score).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), F.desc("n"), "author").limit(most)


def headline(incidents: DataFrame, ranks: tuple[str, ...] = ("confirmed", "plausible", "anecdotal")) -> DataFrame:
    """[O12] (category, id): the incident that stands for each category: best reproducible, then latest, then by id."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("reproducibility")), F.lit(0)), F.lit(len(ranks) + 1))
    rows = incidents.select(F.explode("exhibited").alias("category"), "id", "incident_date", rank.alias("_r"))
    return first_rows(rows, ["category"], F.col("_r"), F.desc_nulls_last("incident_date"), F.col("id")).select("category", "id")


def listing(df: DataFrame, *desc: str, name: str) -> DataFrame:
    """[O13 O16 O18] Descending with nulls last, then by name."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in desc], name)


def next_steps(parts: list[tuple[int, DataFrame]], most: int = 10) -> DataFrame:
    """[O17] Steps(seq, step) of several findings by weight and sequence, the first ``most``: the report's length."""
    out = None
    for weight, df in parts:
        part = df.select(F.lit(weight).alias("weight"), "seq", "step")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("weight", "seq", "step").limit(most)


def breadth(cells: DataFrame, k: int) -> DataFrame:
    """[A32 O07] (id, breadth, tiers) of cells(id, category, tier, stars): the k broadest."""
    return cells.groupBy("id").agg(F.count_if(F.col("tier") > 0).alias("breadth"), F.sum("tier").alias("tiers"), F.max(F.coalesce("stars", F.lit(0))).alias("stars")).orderBy(F.desc("breadth"), F.desc("tiers"), F.desc("stars"), "id").limit(k)


def column_order(cells: DataFrame) -> DataFrame:
    """[A33]"""
    return cells.filter("tier > 0").groupBy("category").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "category")


def stub_bodies(lines: DataFrame) -> DataFrame:
    """[W06] Added ``def`` lines directly followed by a body that is only ``pass``, unless decorated two lines above it."""
    w = Window.partitionBy("path").orderBy("line_no")
    before = [(F.lag("text", k).over(w), F.lag("line_no", k).over(w)) for k in (1, 2)]
    rows = lines.filter("added").withColumns({"_t1": before[0][0], "_n1": before[0][1], "_t2": before[1][0], "_n2": before[1][1]})
    decorated = (F.col("line_no") - F.col("_n2") == 2) & F.col("_t2").rlike(r"^\s*@")
    return rows.filter(F.col("text").rlike(r"^\s*(pass|\.\.\.)\s*$") & (F.col("line_no") - F.col("_n1") == 1) & F.col("_t1").rlike(r"^\s*(async\s+)?def\s") & ~F.coalesce(decorated, F.lit(False))).select("path", F.col("_n1").alias("line_no"), F.col("_t1").alias("text"))


def weakened_tests(lines: DataFrame) -> DataFrame:
    """[A37] Test files that lose more assertions than they gain, or gain marks that skip tests."""
    asserts = F.col("text").rlike(r"\b(assert\w*|expect)\b")
    skips = F.col("text").rlike(r"@(pytest\.mark\.)?(skip|xfail)|\b(it|test|describe)\.skip\b|\.skipTest\(")
    n = lines.filter(X.is_test_file("path")).groupBy("path").agg(F.count_if(asserts & ~F.col("added")).alias("removed"), F.count_if(asserts & F.col("added")).alias("gained"), F.count_if(skips & F.col("added")).alias("skips"))
    return n.filter("removed > gained or skips > 0")


def undeclared_imports(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, package): added Python imports that declared(package) lacks, the standard library included there."""
    used = lines.filter(F.col("added") & F.endswith("path", F.lit(".py"))).select("path", F.explode(X.python_imports("text")).alias("package")).distinct()
    return used.join(declared.select("package").distinct(), "package", "left_anti").select("path", "package")


def uncovered(categories: DataFrame, checks: DataFrame) -> DataFrame:
    """[A38 U02] Categories that no check(modes) covers."""
    return categories.select("category").join(checks.select(F.explode("modes").alias("category")).distinct(), "category", "left_anti")


def commands(files: DataFrame, command: list[str], metric: str | None = None, seconds: float = 60) -> DataFrame:
    """[X04 P17] (path, outcome, metric) of an external check fed with each file's content; it runs where the file is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    done = subprocess.run(command, input=content or "", capture_output=True, text=True, timeout=seconds, check=False)
                    found = re.search(metric, done.stdout) if metric else None
                    out.append((path, done.returncode, float(found[1]) if found else None))
                except (subprocess.TimeoutExpired, OSError):
                    out.append((path, -1, None))
            yield pd.DataFrame(out, columns=["path", "code", "metric"])

    done = files.select("path", "content").mapInPandas(run, "path string, code int, metric double")
    return done.select("path", S.outcome(F.col("code")).alias("outcome"), F.when(F.isnan("metric"), None).otherwise(F.col("metric")).alias("metric"))


def rule_classifier(df: DataFrame, id_col: str, text: str, tables: dict[str, dict[str, list[str]]]) -> DataFrame:
    """[X05 W04] (id, <table>, <table>_confidence): for each table of phrases the class with the clearest lead."""
    out = df.select(id_col, text)
    for name, rules in tables.items():
        hits = F.transform(F.map_entries(X.phrase_hits(text, rules)), lambda e: F.struct((-F.size(e["value"])).alias("n"), e["key"].alias("c")))
        ranked = F.array_sort(hits)
        top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        tie = top["n"] == second["n"]
        out = out.withColumn(f"{name}_confidence", S.margin_confidence(-top["n"], -second["n"])).withColumn(name, F.when(F.coalesce(tie, F.lit(False)), None).otherwise(top["c"]))
    return out.drop(text)
