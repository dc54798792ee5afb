"""Queries over records: text assembly, addresses and ids, merges, lookups, listings; each with the SQL it must equal.

Where a driver table has no column of the kind, one is derived from whole columns, and the SQL states what must come out of
it without the operator's own expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import relational as R
from .catalog import CELLS_SQL, _cells, query
from .tables import table

s = F.lit


@query("SELECT doc_id, md5(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, '')) AS digest FROM documents")
def searchable_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.joined_lines("source", "lang", "text").cast("binary")).alias("digest"))


@query("SELECT page_id, array_to_string(list_filter([trim(coalesce(url, '')), '', trim(' x '), CASE WHEN page_id > 100 THEN '  ' ELSE 'low' END], lambda p: trim(p) <> ''), ' ') AS line FROM pages")
def joined_parts(spark, d):
    parts = [F.coalesce("url", s("")), s(""), s(" x "), F.when(F.col("page_id") > 100, "  ").otherwise("low")]
    return table(spark, d, "pages").select("page_id", X.joined_nonempty(parts).alias("line"))


@query("SELECT doc_id, md5(left(array_to_string(list_filter([trim(source), trim(lang), trim(left(text, 300))], lambda p: p <> ''), chr(10)), 250)) AS digest FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
def composed_documents(spark, d):
    docs = table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    return docs.select("doc_id", F.md5(X.composed_document("source", "lang", "text", 300, 250).cast("binary")).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) THEN NULL ELSE 'https://github.com/' || lower(replace(p_brand, '#', '-')) || '/' || lower(replace(p_type, ' ', '.')) END AS url, 'https://github.com/' || replace(p_brand, '#', '-') || '/' || replace(p_type, ' ', '.') AS cased, 'https://github.com/' || replace(p_brand, '#', '-') || '/' || replace(p_type, ' ', '.') AS found FROM part")
def repository_addresses(spark, d):
    """Reserved owners name no repository; case, marks and what stands below do not count."""
    p = table(spark, d, "part")
    name = F.concat(F.replace("p_brand", s("#"), s("-")), s("/"), F.replace("p_type", s(" "), s(".")))
    kind = F.col("p_size") % 5
    whole = F.when(kind == 0, F.concat(s("https://github.com/Signup/"), "p_brand")).when(kind == 1, s("https://github.com/contact/us")).when(kind == 2, F.concat(s("HTTP://www.GitHub.com/"), name, s(".git/"))).when(kind == 3, F.concat(s("github.com/"), name, s("/issues?q=1#top"))).otherwise(F.concat(s(" https://github.com/"), name, s(" ")))
    shown = F.concat(s("https://github.com/"), name)
    return p.select("p_partkey", X.repository_url(whole).alias("url"), X.repository_url_cased(F.concat(shown, s("/tree/main?x=1"))).alias("cased"), F.array_join(X.repository_urls(F.concat(s("see "), shown, s(", or "), F.lower(shown), s("."))), " ").alias("found"))


@query("""SELECT p_partkey, 'https://example.org/' || p_size || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '?q=' || replace(replace(p_brand, '#', '%23'), ' ', '+') WHEN 2 THEN '?a=1+2&b=A' ELSE '?t=~%2A' END AS url FROM part""")
def canonical_parameters(spark, d):
    """Parameters in one spelling; tracking in any case, blanks, ports and fragments gone."""
    kind = F.col("p_size") % 4
    tail = F.when(kind == 0, s("?UTM_Source=x&Ref_=y&blank=&alone#top")).when(kind == 1, F.concat(s("?q="), F.replace("p_brand", s("#"), s("%23")), s("&gclid=1"))).when(kind == 2, s("?a=1+2&b=%41")).otherwise(s("?t=%7E*"))
    return table(spark, d, "part").select("p_partkey", X.canonical_url(F.concat(s("HTTPS://Example.ORG:443/"), F.col("p_size").cast("string"), F.when(kind == 0, "//").otherwise(""), tail)).alias("url"))


@query("SELECT p_partkey, '2301.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || ' hep-th/9901001' AS arxiv, '10.1000/x.' || p_partkey AS doi, '2301.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS bare_arxiv, '10.1000/abc' || p_partkey AS bare_doi, 'arxiv-2301-' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS paper_id FROM part")
def evidence_ids(spark, d):
    number = F.lpad((F.col("p_partkey") % 100_000).cast("string"), 5, "0")
    text = F.concat(s("see hep-th/9901001v2 and arXiv:2301."), number, s("v3, also 2301."), number, s(" (doi:10.1000/x."), F.col("p_partkey").cast("string"), s("). Twice: 10.1000/X."), F.col("p_partkey").cast("string"))
    arxiv, doi = F.concat(s("https://arxiv.org/pdf/2301."), number, s("v12.pdf")), F.concat(s("https://doi.org/10.1000/ABC"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.arxiv_ids(text), " ").alias("arxiv"), F.array_join(X.dois(text), " ").alias("doi"), X.bare_arxiv_id(arxiv).alias("bare_arxiv"), X.bare_doi(doi).alias("bare_doi"), X.proposed_paper_id(arxiv, doi, F.col("p_name")).alias("paper_id"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS compact, regexp_replace(lower(trim(p_type || '__x.' || p_brand)), '[-_.]+', '-', 'g') AS package, p_name AS shown, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')) AS item_id FROM part")
def names_in_normal_form(spark, d):
    return table(spark, d, "part").select("p_partkey", X.compact("p_name").alias("compact"), X.package_name(F.concat("p_type", s("__x."), "p_brand")).alias("package"), X.display_name(F.concat("p_name", s(": "), "p_type"), F.lit("repo")).alias("shown"), X.proposed_item_id(F.lit("https://example.org/no/repository"), "p_type").alias("item_id"))


@query("SELECT o_orderkey, try_cast(left(CASE WHEN o_orderkey < 2000 THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END, 10) AS DATE) AS day, CASE WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN t // 60 || 'm ' || lpad((t % 60)::VARCHAR, 2, '0') || 's' ELSE t // 3600 || 'h ' || lpad((t % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((t % 60)::VARCHAR, 2, '0') || 's' END AS took FROM (SELECT *, CAST(floor(o_totalprice / 40) AS BIGINT) AS t FROM orders)")
def dates_and_durations(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.iso_date(F.when(F.col("o_orderkey") < 2000, "n/a").otherwise(F.col("o_orderdate").cast("string"))).alias("day"), X.duration(F.col("o_totalprice") / 40).alias("took"))


@query("""SELECT doc_id, least(1.0, least(0.4, 0.1 * (CASE WHEN regexp_matches(low, '(^|[^\\p{L}\\p{N}_])(idiot|stupid)([^\\p{L}\\p{N}_]|$)') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, '(^|[^\\p{L}\\p{N}_])(mit license|apache license)([^\\p{L}\\p{N}_]|$)') THEN 1 ELSE 0 END)) + 0.1 * CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + 0.25 * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + 0.05 * CASE WHEN lower(source) = 'github' THEN 1 ELSE 0 END + 0.05 * CASE WHEN length(trim(lang || ' ' || low)) >= 80 THEN 1 ELSE 0 END) AS score
    FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, lower(regexp_replace(coalesce(text, ''), '[0-9:/]+', ' ', 'g')) AS low FROM documents)""")
def relevance_scores(spark, d):
    """Every part of the score: classes and signals hit, a repository, a paper, the source and the length."""
    text = F.lower(F.regexp_replace(F.coalesce("text", s("")), "[0-9:/]+", " "))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", s("")).alias("source"), F.coalesce("lang", s("")).alias("lang"), text.alias("low"))
    hit = X.phrase_hits("low", {"abuse": ["idiot", "stupid"], "licence": ["mit license", "apache license"]})
    url = F.when(F.col("doc_id") % 2 == 0, "https://github.com/some/repo")
    raw = F.when(F.col("doc_id") % 3 == 0, "arXiv:2301.00001")
    return docs.select("doc_id", S.relevance(F.col("lang"), F.col("low"), url, raw, F.col("source"), F.size(hit), F.lit(0)).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_retailprice / 9000 < 0.10 THEN 'drop' WHEN p_size > 45 THEN 'unclassified' WHEN p_retailprice / 9000 < 0.15 AND p_size > 20 THEN 'low_relevance' WHEN p_retailprice / 9000 < 0.15 THEN 'drop' WHEN p_size % 7 = 0 THEN 'no_url' WHEN p_size % 3 = 0 THEN 'duplicate' ELSE 'promote' END AS route FROM part")
def raw_result_routes(spark, d):
    size = F.col("p_size")
    kind = F.when(size > 45, s(None)).when(size > 20, "tool").otherwise("paper")
    return table(spark, d, "part").select("p_partkey", S.route(F.col("p_retailprice") / 9000, kind, F.when(size % 7 == 0, " ").otherwise("https://x"), size % 3 == 0).alias("route"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_type), 'steel') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_name || ' ' || p_type), 'a') THEN 1 ELSE 0 END
    + CASE WHEN y >= 2026 THEN 5 WHEN y = 2025 THEN 4 WHEN y = 2024 THEN 2 WHEN y >= 2022 THEN 1 WHEN y > 0 AND y < 2018 THEN -3 ELSE 0 END + CASE WHEN c >= 500 THEN 5 WHEN c >= 100 THEN 4 WHEN c >= 30 THEN 3 WHEN c >= 10 THEN 2 WHEN c >= 3 THEN 1 ELSE 0 END
    + CASE WHEN p_size > 40 THEN -5 WHEN p_size > 10 THEN -2 ELSE 0 END AS score FROM (SELECT *, CASE WHEN p_size = 1 THEN 0 ELSE 2010 + p_size % 18 END AS y, CAST(floor(p_retailprice - 900) AS INTEGER) AS c FROM part)""")
def literature_scores(spark, d):
    size = F.col("p_size")
    year = F.when(size == 1, 0).otherwise(2010 + size % 18)
    abstract = F.when(size > 40, "").when(size > 10, "short").otherwise(F.repeat(s("long "), 60))
    return table(spark, d, "part").select("p_partkey", S.literature(F.concat_ws(" ", "p_name", "p_type"), {"steel": 3, "a": 1}, year, F.floor(F.col("p_retailprice") - 900).cast("int"), s(""), abstract).cast("int").alias("score"))


@query("SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'accepted' WHEN '5-LOW' THEN 'pending' END, o_orderstatus) AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'ann' END AS reviewer, CASE WHEN o_orderpriority = '1-URGENT' THEN DATE '2020-01-02' END AS reviewed_at FROM orders")
def status_transitions(spark, d):
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), s(None).cast("string").alias("reviewer"), s(None).cast("string").alias("graduated_to"), s(None).cast("date").alias("reviewed_at"))
    to = F.when(F.col("o_orderpriority") == "1-URGENT", "accepted").otherwise("pending")
    changes = o.filter("o_orderpriority IN ('1-URGENT', '5-LOW')").select("o_orderkey", to.alias("new_status"), F.when(to == "accepted", "ann").alias("new_reviewer"), s(None).cast("string").alias("new_graduated_to"))
    return R.set_status(rows, "o_orderkey", changes, F.to_date(s("2020-01-02"))).drop("graduated_to")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus ELSE 'patched' END AS status, o_orderpriority AS priority, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey::VARCHAR END AS customer, CASE WHEN o_orderpriority = o_orderstatus THEN o_orderpriority ELSE o_orderpriority || ',' || CASE WHEN o_orderstatus < 'Z' THEN o_orderstatus || ',z' END END AS listed FROM orders")
def patched_payloads(spark, d):
    old = F.create_map(s("status"), F.col("o_orderstatus"), s("priority"), F.col("o_orderpriority"))
    patch = F.when(F.col("o_orderpriority") != "5-LOW", F.create_map(s("status"), s("patched"), s("customer"), F.col("o_custkey").cast("string")))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", R.patch_map(old, patch).alias("m"))
    listed = F.array_join(R.append_new(F.array("o_orderpriority"), F.array(s("z"), F.col("o_orderstatus"), F.col("o_orderpriority"))), ",")
    return rows.select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"), F.col("m")["customer"].alias("customer"), listed.alias("listed"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_writer_upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    out = R.upsert_latest(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey").desc())
    return out.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("WITH a AS (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'O') SELECT *, 'removed' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def snapshot_drift(spark, d):
    rows = lambda f: table(spark, d, "lineitem").filter(F.col("l_linestatus") == f).select("l_suppkey", "l_quantity")
    return R.drifted(rows("F"), rows("O"))


@query("""WITH a AS (SELECT c_nationkey, min(c_custkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), b AS (SELECT c_nationkey, min(c_custkey) AS id FROM customer GROUP BY 1)
    SELECT s_suppkey, coalesce(a.id, b.id) AS hit, CASE WHEN a.id IS NOT NULL THEN 'near' WHEN b.id IS NOT NULL THEN 'any' END AS hit_by FROM supplier LEFT JOIN a ON s_acctbal > 0 AND a.c_nationkey = s_nationkey LEFT JOIN b ON b.c_nationkey = s_nationkey""")
def prioritised_duplicates(spark, d):
    """The first of two keys that finds an entry, and the first entry under it."""
    index = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    keys = [("near", F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey"))), ("any", F.col("s_nationkey"), F.col("c_nationkey"))]
    return R.prioritised_lookup(table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_suppkey", index, keys, F.col("id")).select("s_suppkey", "hit", "hit_by")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '' WHEN p_size > 10 THEN p_type ELSE p_brand || ',' || p_type END AS fresh, CASE WHEN p_size <= 5 THEN 'continue' WHEN p_size <= 25 OR p_retailprice > 1500 THEN 'update_queue' ELSE 'drop' END AS outcome FROM part")
def novelty_outcomes(spark, d):
    size = F.col("p_size")
    known = F.when(size > 25, F.array("p_brand", "p_type")).when(size > 10, F.array("p_brand"))
    out = R.novelty(table(spark, d, "part"), known, F.array("p_brand", "p_type"), F.when(size > 5, F.col("p_partkey")), F.col("p_retailprice") > 1500)
    return out.select("p_partkey", F.array_join("new_evidence", ",").alias("fresh"), "outcome")


@query("SELECT l_suppkey AS ref, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS ids FROM lineitem GROUP BY 1")
def reverse_references(spark, d):
    orders = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_set("l_suppkey").alias("refs"))
    return E.reverse(orders, "id", "refs").select("ref", F.array_join("ids", ",").alias("ids"))


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS decision FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1")
def decisions_or_unknown(spark, d):
    facts = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("decision"))
    return E.enriched(table(spark, d, "customer").select("c_custkey", "c_nationkey"), facts, "c_nationkey", "decision").select("c_custkey", "decision")


@query(r"WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[\s_-]+', ' ', 'g') AS t FROM documents), r(class, k) AS (VALUES ('licence', 'apache license'), ('licence', 'mit license'), ('abuse', 'idiot'), ('abuse', 'worthless'), ('abuse', 'of the')) SELECT doc_id, class, count(*) AS hits FROM t, r WHERE contains(t, k) GROUP BY 1, 2")
def keyword_family_hits(spark, d):
    rules = spark.createDataFrame([("licence", "Apache-License"), ("licence", "mit_license"), ("abuse", "idiot"), ("abuse", "worthless"), ("abuse", "of the")], "class string, keyword string")
    return E.keyword_families(table(spark, d, "documents"), "doc_id", "text", rules)


@query("SELECT category, count(*) AS n FROM (SELECT o_orderstatus AS category FROM orders UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY 1")
def two_source_counts(spark, d):
    return E.inline_and_bulk(table(spark, d, "orders").select(F.col("o_orderstatus").alias("category")), table(spark, d, "lineitem").select(F.col("l_linestatus").alias("category")))


@query("""WITH t AS (SELECT c_nationkey AS n, count(*) AS k FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
    SELECT r_name AS id, count(*)::INTEGER AS declared, count(t.n)::INTEGER AS covered, coalesce(string_agg(CASE WHEN t.n IS NULL THEN n_name END, ',' ORDER BY n_name), '') AS missing FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN t ON t.n = n_nationkey GROUP BY 1""")
def parent_completeness(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    parents = both.groupBy(F.col("r_name").alias("id")).agg(F.collect_list(F.struct(F.col("n_name").alias("external_id"))).alias("categories"))
    touched = table(spark, d, "customer").filter("c_acctbal > 9000").join(both, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("taxonomy"), F.col("n_name").alias("external_id"))
    return E.taxonomy_completeness(parents, touched).select("id", "declared", "covered", F.array_join("missing", ",").alias("missing"))


@query("WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS score FROM orders ORDER BY 2 DESC, 1 LIMIT 120), a AS (SELECT DISTINCT l_orderkey, l_suppkey::VARCHAR AS author FROM lineitem) SELECT author, sum(score)::BIGINT AS total, count(*) AS n FROM b JOIN a ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 40")
def leading_authors(spark, d):
    authors = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("authors"))
    score = F.floor("o_totalprice").cast("long").alias("score")
    return E.top_authors(table(spark, d, "orders").join(authors, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", score, "authors"), "score", "o_orderkey")


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS day, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 4 END AS r, unnest([l_linestatus, 'supplier ' || l_suppkey]) AS category FROM lineitem)
    SELECT category, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY r, day DESC, id) AS k FROM e) WHERE k = 1""")
def representative_incidents(spark, d):
    rank = F.when(F.col("l_returnflag") == "R", "confirmed").when(F.col("l_returnflag") == "A", "plausible").otherwise("other")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.to_date("l_shipdate").alias("incident_date"), rank.alias("reproducibility"), F.array("l_linestatus", F.concat(s("supplier "), F.col("l_suppkey").cast("string"))).alias("exhibited"))
    return E.headline(rows)


@query("SELECT * FROM (SELECT 1 AS weight, s_suppkey AS seq, s_name AS step FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 2, p_partkey, p_name FROM part WHERE p_size = 1) ORDER BY weight, seq, step LIMIT 10")
def next_steps_list(spark, d):
    low = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("step"))
    return E.next_steps([(2, table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("step"))), (1, low)])


@query(f"WITH c AS ({CELLS_SQL}) SELECT unit AS id, count(*) FILTER (tier > 0) AS breadth, sum(tier)::BIGINT AS tiers FROM c GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def breadth_selection(spark, d):
    cells = _cells(spark, d).select(F.col("unit").alias("id"), "category", "tier", F.lit(0).alias("stars"))
    return E.breadth(cells, 20).select("id", "breadth", "tiers")


@query(f"WITH c AS ({CELLS_SQL}) SELECT category, count(DISTINCT unit) AS n FROM c WHERE tier > 0 GROUP BY 1")
def column_coverage(spark, d):
    return E.column_order(_cells(spark, d).select(F.col("unit").alias("id"), "category", "tier"))


@query("SELECT DISTINCT p_type AS category FROM part EXCEPT SELECT p_type FROM part WHERE p_size > 47")
def uncovered_categories(spark, d):
    checks = table(spark, d, "part").filter("p_size > 47").groupBy("p_size").agg(F.collect_set("p_type").alias("modes"))
    return E.uncovered(table(spark, d, "part").select(F.col("p_type").alias("category")).distinct(), checks)


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'declared' WHEN p_size < 20 THEN 'override' ELSE array_to_string(list_filter([CASE WHEN contains(p_type, 'STEEL') THEN 'metal' END, CASE WHEN contains(p_type, 'SMALL') THEN 'small' END], lambda x: x IS NOT NULL), ',') END AS surfaces, CASE p_size % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'caught' ELSE 'error' END AS outcome FROM part")
def inferred_surfaces(spark, d):
    size, one = F.col("p_size"), lambda c, v: F.when(c, F.array(s(v))).otherwise(F.array().cast("array<string>"))
    found = S.surfaces(one(size < 10, "declared"), one(size < 20, "override"), [("STEEL", "metal"), ("SMALL", "small")], F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("surfaces"), S.outcome(size % 3).alias("outcome"))
