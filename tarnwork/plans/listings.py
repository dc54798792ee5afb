"""Queries over the shop's tables and texts for readers, filters, listings and labels; each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import stats as A
from ..sources import readers, sinks
from ..streaming import flows
from .catalog import query
from .tables import instants, scratch, table


@query("SELECT sale_id, CAST(sold_at AS VARCHAR) AS sold FROM sales WHERE sold_at >= TIMESTAMP '2024-03-01'")
def sales_since(spark, d):
    """What came at or after a time; a filter that reaches the scan."""
    return readers.since(instants(table(spark, d, "sales"), "sold_at"), "sold_at", "2024-03-01").select("sale_id", F.date_format("sold_at", "yyyy-MM-dd HH:mm:ss").alias("sold"))


@query("SELECT client_id FROM clients WHERE source = 'web' AND segment = 'retail'")
def results_of_a_query(spark, d):
    rows = table(spark, d, "clients").select("client_id", "source", F.col("segment").alias("query"), F.col("updated_at").alias("fetched_at"))
    return readers.by_source_and_query(rows, "web", "retail").select("client_id")


@query("SELECT vendor_id AS id, name FROM vendors WHERE vendor_id = 7")
def vendor_by_id(spark, d):
    return readers.by_id(table(spark, d, "vendors").select(F.col("vendor_id").alias("id"), "name"), 7)


@query("""SELECT click_id, json_extract_string(props, '$.device.os') AS os, coalesce(json_extract_string(props, '$.device.ver'), json_extract_string(props, '$.ver')) AS ver, json_extract_string(props, '$.k') AS k FROM (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS props FROM clicks)""")
def normalised_payloads(spark, d):
    """One column for each name of a payload, from the first path that has it."""
    shape = {"os": ["$.device.os"], "ver": ["$.device.ver", "$.ver"], "k": ["$.k"]}
    return readers.normalised(table(spark, d, "clicks"), shape, "props").select("click_id", "os", "ver", "k")


@query("""SELECT 'vendors' AS kind, count(*) AS n, count(DISTINCT vendor_id) AS ids FROM vendors UNION ALL SELECT 'items', count(*), count(DISTINCT item_id) FROM items UNION ALL SELECT 'nations', count(*), count(DISTINCT n_nationkey) FROM nation""")
def catalog_snapshot(spark, d):
    """Every row of three kinds as JSON, and from that what a reader of the snapshot counts."""
    kinds = {k: table(spark, d, t).withColumnRenamed(c, "id").select("id") for k, t, c in (("vendors", "vendors", "vendor_id"), ("items", "items", "item_id"), ("nations", "nation", "n_nationkey"))}
    rows = readers.snapshot(kinds)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("row", "$.id")).alias("ids"))


@query("SELECT item_id FROM items WHERE kind = 'home' AND size >= 10 AND list_contains(string_split(name, ' '), 'small')")
def items_by_facets(spark, d):
    rows = table(spark, d, "items").select("item_id", "brand", "kind", F.col("size").alias("stars"), F.split("name", " ").alias("addresses"))
    return rows.filter(S.facets({"kind": "home", "min_stars": 10, "mode": "small", "unused": None})).select("item_id")


@query("SELECT item_id FROM items WHERE coalesce(name, '') <> '' AND kind <> 'tools' AND coalesce(size % 2 = 0, FALSE)")
def eligible_items(spark, d):
    """An agent asks: no agents (here items of odd size), nothing blocked (tools), something addressed."""
    rows = table(spark, d, "items").withColumns({"modes": F.filter(F.split("name", " "), lambda x: x != ""), "agent": F.col("size") % 2 == 1})
    return rows.filter(S.eligible(F.col("kind"), F.col("agent"), True, ["tools"], F.col("modes"))).select("item_id")


@query("""WITH f AS (SELECT page_id % 50 AS repo, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') AS path FROM pages WHERE url IS NOT NULL),
    m AS (SELECT DISTINCT repo, path, unnest([path, regexp_extract(path, '([^/]+)$', 1)]) AS marker FROM f), r(marker, tool, confidence) AS (VALUES ('533', 'one', 0.5), ('en/25', 'two', 0.9), ('474.html', 'two', 0.4), ('676', 'three', 0.7))
    SELECT CAST(repo AS BIGINT) AS repo, tool, string_agg(DISTINCT path, ',' ORDER BY path) AS paths, CAST(max(confidence) AS DOUBLE) AS confidence FROM m JOIN r USING (marker) GROUP BY repo, tool""")
def detected_stack(spark, d):
    """Tools that paths of pages point to, by marker."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[?#].*$", "")
    files = table(spark, d, "pages").filter("url IS NOT NULL").select((F.col("page_id") % 50).alias("repo"), path.alias("path"))
    rules = spark.createDataFrame([("533", "one", 0.5), ("en/25", "two", 0.9), ("474.html", "two", 0.4), ("676", "three", 0.7)], "marker string, tool string, confidence double")
    return readers.stack(files, rules).select("repo", "tool", F.array_join("paths", ",").alias("paths"), "confidence")


@query("""WITH i AS (SELECT DISTINCT vendor_id, item_id FROM sale_lines WHERE vendor_id IS NOT NULL AND item_id IS NOT NULL)
    SELECT i.vendor_id AS taxonomy, CAST(row_number() OVER (PARTITION BY i.vendor_id ORDER BY item_id) - 1 AS INTEGER) AS place, CAST(item_id AS VARCHAR) AS external_id, coalesce(c.n, 0) AS citations FROM i LEFT JOIN (SELECT vendor_id, min(nation_id) AS paper_id FROM vendors GROUP BY vendor_id) v USING (vendor_id) LEFT JOIN (SELECT nation_id, count(*) AS n FROM clients WHERE nation_id < 20 GROUP BY nation_id) c ON c.nation_id = v.paper_id""")
def categories_with_citations(spark, d):
    """Items that a vendor sold as its categories, in order, with the clients of the vendor's nation; none counts 0."""
    lines = table(spark, d, "sale_lines").filter("vendor_id IS NOT NULL AND item_id IS NOT NULL").select("vendor_id", "item_id").distinct()
    sold = lines.groupBy("vendor_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    nations = table(spark, d, "vendors").groupBy("vendor_id").agg(F.min("nation_id").alias("paper_id"))
    tax = sold.join(nations, "vendor_id", "left").select(F.col("vendor_id").alias("id"), "paper_id", F.transform("items", lambda x: F.struct(x.cast("string").alias("external_id"))).alias("categories"))
    papers = table(spark, d, "clients").filter("nation_id < 20").groupBy(F.col("nation_id").alias("id")).agg(F.count("*").alias("citation_count"))
    return E.taxonomy_rows(tax, papers).select("taxonomy", "place", "external_id", "citations")


@query("""WITH g AS (SELECT kind AS category, CASE WHEN count(*) % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN count(*) % 2 = 1 THEN 'B1' END AS preferred FROM items WHERE kind IS NOT NULL GROUP BY kind),
    r AS (SELECT category, severity, item_id AS id, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN brand = preferred THEN 1 ELSE 0 END DESC, len(list_intersect(list_distinct(string_split(name, ' ')), ['small', 'bolt'])) DESC, size % 4 DESC, coalesce(price, 0) DESC, item_id) AS rank FROM g JOIN items ON kind = category)
    SELECT category, severity, CAST(rank AS INTEGER) AS rank, id FROM r WHERE rank <= 3""")
def recommended_for_gaps(spark, d):
    items = table(spark, d, "items")
    n = F.count("*") % 2
    gap = items.filter("kind IS NOT NULL").groupBy(F.col("kind").alias("category")).agg(F.when(n == 0, "high").otherwise("medium").alias("severity"), F.when(n == 1, "B1").alias("preferred"))
    rows = items.select(F.col("item_id").alias("id"), F.col("kind").alias("category"), F.col("brand").alias("paradigm"), F.split("name", " ").alias("surfaces"), (F.col("size") % 4).alias("tier"), F.col("price").alias("stars"))
    return G.gap_recommendations(gap, rows, ["small", "bolt"]).select("category", "severity", "rank", "id")


@query("""WITH n AS (SELECT brand, kind, count(*) AS n FROM items WHERE brand IS NOT NULL GROUP BY ALL), t AS (SELECT brand, kind, n, row_number() OVER (PARTITION BY brand ORDER BY n DESC, kind) AS k FROM n),
    s AS (SELECT brand, sum(n) AS size, count(*) AS spread FROM n GROUP BY brand)
    SELECT s.brand, CAST(size AS BIGINT) AS size, t.kind AS top_label, round(100.0 * n / size, 1) AS top_share, spread FROM s JOIN t ON t.brand = s.brand AND k = 1 WHERE size > 1 AND spread > 1 AND s.brand <> 'B1' ORDER BY size DESC, spread DESC, top_share, s.brand LIMIT 10""")
def brands_that_disagree(spark, d):
    """The ten largest brands whose items are of several kinds; one brand stands for noise."""
    items = table(spark, d, "items").filter("brand IS NOT NULL")
    summary = A.cluster_summary(items, "brand", "kind", "item_id", "size")
    return A.top_disagreements(summary, "brand", 10, "B1").select("brand", "size", "top_label", "top_share", "spread")


@query("SELECT sale_id, total FROM sales ORDER BY total DESC NULLS LAST, priority DESC NULLS LAST, sale_id LIMIT 200")
def sales_listing(spark, d):
    """The first page of a listing: the largest, then the most urgent."""
    return E.listing(table(spark, d, "sales"), "total", "priority", name="sale_id").limit(200).select("sale_id", "total")


@query(r"""SELECT page_id, regexp_matches(trim(url), '(?i)^https?://(www\.)?github\.com/[A-Za-z0-9][A-Za-z0-9-]*/[A-Za-z0-9._-]+/?$') AS is_repository, nullif(regexp_replace(regexp_extract(html, 'https?://[^\s<>"]+'), '[.,;:)\]}!?'']+$', ''), '') AS first_url FROM pages""")
def addresses_of_pages(spark, d):
    return table(spark, d, "pages").select("page_id", X.is_repository_url("url").alias("is_repository"), X.first_url("html").alias("first_url"))


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_]*)', 1))) AS packages, regexp_matches(text, '(?i)(?:#|//|/\*|<!--)\s*(?:todo|fixme|xxx|hack|stub)\b') AS unfinished FROM documents WHERE text IS NOT NULL""")
def code_in_documents(spark, d):
    """Packages that texts import and whether they hold a mark of unfinished work."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.python_imports("text").alias("packages"), X.stub_marker("text").alias("unfinished"))


@query(r"""SELECT page_id, regexp_matches(url, '(?i)(?:^|/)(?:tests?|__tests__|spec)/|(?:^|/)test_[^/]*$|[._-](?:test|spec)\.[a-z]+$') AS is_test FROM pages""")
def test_pages(spark, d):
    return table(spark, d, "pages").select("page_id", X.is_test_file("url").alias("is_test"))


@query("""SELECT item_id, list_concat([name, kind], list_filter([brand, kind], lambda x: x IS DISTINCT FROM name AND x IS DISTINCT FROM kind)) AS words,
    CASE WHEN len(t) > 0 THEN t ELSE ['plain'] END AS tags FROM (SELECT *, list_filter([CASE WHEN size > 30 THEN 'large' END, CASE WHEN price > 100 THEN 'dear' END, CASE WHEN kind = 'home' THEN 'home' END], lambda x: x IS NOT NULL)[1:2] AS t FROM items)""")
def tagged_items(spark, d):
    """An ordered union of two lists, and at most two labels of what holds."""
    i = table(spark, d, "items")
    return i.select("item_id", X.ordered_union(F.array("name", "kind"), F.array("brand", "kind")).alias("words"), X.tags([(F.col("size") > 30, "large"), (F.col("price") > 100, "dear"), (F.col("kind") == "home", "home")], "plain", 2).alias("tags"))


@query("SELECT client_id FROM clients WHERE segment IS DISTINCT FROM 'retail'")
def stale_clients(spark, d):
    """Rows scored under another set of rules than the present one, or never."""
    return flows.stale_scores(table(spark, d, "clients"), "retail", "segment").select("client_id")


@query("""SELECT '| ' || coalesce(CAST(vendor_id AS VARCHAR), '—') || ' | ' || coalesce(name, '—') || ' | ' || coalesce(CAST(nation_id AS VARCHAR), '—') || ' |' AS line FROM vendors
    UNION ALL SELECT unnest(['# Vendors', '', '| vendor_id | name | nation_id |', '|---|---|---|'])""")
def vendor_report(spark, d):
    return sinks.markdown(table(spark, d, "vendors"), "Vendors", ["vendor_id", "name", "nation_id"], ["vendor_id"])


@query("""SELECT owner, repo, source_count FROM (SELECT kind AS owner, name AS repo, count(DISTINCT brand) AS source_count FROM items GROUP BY ALL) WHERE repo IS NOT NULL AND owner IS NOT NULL""")
def candidates_from_json(spark, d):
    """Items written as JSON documents of candidates, a document a file, and read back; a missing count is the number of sources."""
    rows = table(spark, d, "items").filter("name IS NOT NULL AND kind IS NOT NULL").groupBy(F.col("kind").alias("owner"), F.col("name").alias("repo")).agg(F.array_sort(F.collect_set("brand")).alias("sources"))
    path = scratch(spark)
    parts = rows.groupBy("owner", F.pmod(F.xxhash64("repo"), F.lit(8)).alias("part"))
    parts.agg(F.collect_list(F.struct("owner", "repo", "sources")).alias("candidates")).select("candidates").write.option("maxRecordsPerFile", 1).json(path)
    return readers.candidates(spark, path).select("owner", "repo", F.col("source_count").cast("long").alias("source_count"))
