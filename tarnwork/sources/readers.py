"""Scans: catalog documents, JSON bundles, event logs, feeds, pages, repositories, diffs, manifests.

Schemas are declared.  Formats without a Spark reader are parsed by ``mapInPandas`` over files that Spark reads, so any
store that Spark can read will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import NODE_KINDS, struct


def catalog(spark: SparkSession, path: str, kind: str, strict: bool = False) -> DataFrame:
    """[S01] One YAML document a file, in the order of file names.  Tolerant scans skip what is no mapping; strict ones fail."""
    schema = struct(NODE_KINDS[kind])
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.y*ml").select("value", F.input_file_name().alias("file"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            out = []
            for value, file in zip(batch["value"], batch["file"], strict=True):
                try:
                    doc = yaml.safe_load(value)
                    if not isinstance(doc, dict):
                        raise ValueError(f"{file} holds no mapping")
                    out.append({"file": file, "doc": json.dumps(doc, default=str)})
                except Exception:
                    if strict:
                        raise
            yield pd.DataFrame(out, columns=["file", "doc"])

    return files.mapInPandas(parse, "file string, doc string").select("file", F.from_json("doc", schema).alias("d")).select("d.*", "file").orderBy("file").drop("file")


def by_id(df: DataFrame, value: str, strict: bool = False) -> DataFrame:
    """[S02] The row of one id; a strict lookup of an unknown id fails when it is run."""
    hit = df.filter(F.col("id") == value)
    if not strict:
        return hit
    found = hit.agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") > 0, f"unknown id {value!r}").alias("_ok"))
    return hit.crossJoin(F.broadcast(found)).filter("_ok is null").drop("_ok")


def since(df: DataFrame, ts: str, start: str | None) -> DataFrame:
    """[S03 T01] Rows fetched at or after a time, oldest first."""
    out = df if start is None else df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    return out.orderBy(ts)


def by_source_and_query(df: DataFrame, source: str, query: str) -> DataFrame:
    """[S04]"""
    return df.filter((F.col("source") == source) & (F.col("query") == query)).orderBy(F.desc("fetched_at"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """[S05] ``candidates[]`` of a JSON document; a bare repo takes its owner, a missing count the number of sources."""
    schema = "candidates ARRAY<STRUCT<owner: STRING, repo: STRING, sources: ARRAY<STRING>, source_count: INT, stars: INT, description: STRING>>"
    c = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("candidates").alias("c")).select("c.*")
    slash = F.instr("repo", "/") > 0
    owner = F.when(slash, F.split_part("repo", F.lit("/"), F.lit(1))).otherwise(F.col("owner"))
    repo = F.when(slash, F.split_part("repo", F.lit("/"), F.lit(2))).otherwise(F.col("repo"))
    return c.select(owner.alias("owner"), repo.alias("repo"), "sources", F.coalesce("source_count", F.size("sources")).alias("source_count"), "stars", "description", F.lower(F.concat_ws("/", owner, repo)).alias("key"))


def papers(spark: SparkSession, path: str) -> DataFrame:
    """[S06] Two dialects of literature bundles as one frame; the slug is the file's name."""
    schema = "data ARRAY<STRUCT<title: STRING, year: INT, abstract: STRING, venue: STRING, url: STRING, citationCount: INT, authors: ARRAY<STRUCT<name: STRING>>, externalIds: STRUCT<DOI: STRING, ArXiv: STRING>, tldr: STRUCT<text: STRING>>>, papers ARRAY<STRUCT<title: STRING, year: INT, abstract: STRING, venue: STRING, urls: ARRAY<STRING>, citedByCount: INT, authors: ARRAY<STRING>, doi: STRING>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("slug", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    a = raw.select("slug", F.explode("data").alias("d")).select("slug", "d.title", "d.year", "d.abstract", F.col("d.tldr.text").alias("tldr"), "d.venue", "d.url", F.transform("d.authors", lambda x: x["name"]).alias("authors"), X.bare_doi("d.externalIds.DOI").alias("doi"), X.bare_arxiv_id("d.externalIds.ArXiv").alias("arxiv_id"), F.col("d.citationCount").alias("citation_count"), F.lit("data").alias("dialect"))
    b = raw.select("slug", F.explode("papers").alias("d")).select("slug", "d.title", "d.year", "d.abstract", F.lit(None).cast("string").alias("tldr"), "d.venue", F.get("d.urls", F.lit(0)).alias("url"), "d.authors", X.bare_doi("d.doi").alias("doi"), F.get(X.arxiv_ids(F.array_join("d.urls", " ")), F.lit(0)).alias("arxiv_id"), F.col("d.citedByCount").alias("citation_count"), F.lit("papers").alias("dialect"))
    return a.unionByName(b)


def event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[S07] JSON lines, newest first; blank and malformed lines are skipped."""
    return spark.read.schema(struct(schema)).json(path, mode="DROPMALFORMED").orderBy(F.desc("ts"))


def feed(spark: SparkSession, path: str, days: int | None = None) -> DataFrame:
    """[S09] Entries of an Atom feed; those without an id that can be read are skipped."""
    schema = "id STRING, title STRING, summary STRING, published STRING, updated STRING, author ARRAY<STRUCT<name: STRING>>, category ARRAY<STRUCT<_term: STRING>>"
    e = spark.read.format("xml").option("rowTag", "entry").schema(struct(schema)).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = e.select(X.bare_arxiv_id("id").alias("arxiv_id"), squeeze("title").alias("title"), squeeze("summary").alias("summary"), F.left("published", F.lit(10)).alias("published"), F.left("updated", F.lit(10)).alias("updated"), F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"))
    return out.filter(F.col("arxiv_id").rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})$"))


def list_items(pages: DataFrame, html: str, item: str, fields: dict[str, str]) -> DataFrame:
    """[S10] Blocks of a page that match ``item``, each with the first group of every field's pattern; empty is null."""
    rows = pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(item), F.lit(0))).alias("place", "_block"))
    tidy = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("_block", p, 1), "<[^>]+>", " "), r"\s+", " ")), F.lit(""))
    return rows.select(*[c for c in pages.columns if c != html], "place", *[tidy(p).alias(n) for n, p in fields.items()])


def first_of(payload: Column, arrays: list[str]) -> Column:
    """[S14] The first array among several paths that holds something, as JSON strings."""
    read = [F.from_json(F.get_json_object(payload, p), "array<string>") for p in arrays]
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in read])


def files(spark: SparkSession, path: str, most: int = 512 * 1024, ignored: tuple[str, ...] = ("node_modules", ".git", "vendor", ".venv", "dist", "build")) -> DataFrame:
    """[S15] (path, size, content) of the files of a tree outside vendored folders; content is text of bounded size."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    part = F.split(F.col("path"), "/")
    return f.filter(~F.arrays_overlap(part, F.array(*[F.lit(i) for i in ignored]))).select("path", F.col("length").alias("size"), F.make_valid_utf8(F.substring("content", 1, most).cast("string")).alias("content"))


def stack(files_: DataFrame, rules: DataFrame, repo: str = "repo") -> DataFrame:
    """[P18 P19] (repo, tool, paths, confidence) by rules(marker, tool, confidence): a marker is a path or a file's name."""
    named = files_.withColumn("marker", F.explode(F.array_distinct(F.array("path", F.regexp_extract("path", "([^/]+)$", 1)))))
    return named.join(F.broadcast(rules), "marker").groupBy(repo, "tool").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.max("confidence").alias("confidence"))


def manifest_packages(path: str, content: str) -> list[str]:
    """Packages that a dependency manifest names, in its format's normal form."""
    import tomllib

    name, out = path.rpartition("/")[2], []
    norm = lambda s: re.sub(r"[-_.]+", "-", re.match(r"[A-Za-z0-9._-]*", s.strip())[0].lower())
    try:
        if name == "package.json":
            doc = json.loads(content)
            out = [p for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for p in doc.get(k) or {}]
        elif name in ("pyproject.toml", "Pipfile"):
            doc = tomllib.loads(content)
            project, tool = doc.get("project", {}), doc.get("tool", {})
            lines = [*project.get("dependencies", []), *[d for g in project.get("optional-dependencies", {}).values() for d in g], *[d for g in tool.get("pdm", {}).get("dev-dependencies", {}).values() for d in g]]
            poetry = tool.get("poetry", {})
            tables = [poetry.get("dependencies", {}), *[g.get("dependencies", {}) for g in poetry.get("group", {}).values()], doc.get("packages", {}), doc.get("dev-packages", {})]
            out = [norm(x) for x in lines] + [norm(k) for t in tables for k in t if k != "python"] + [f"tool.{k}" for k in tool]
        elif re.fullmatch(r"requirements[^/]*\.txt", name):
            out = [norm(x) for x in content.splitlines() if x.strip() and not x.strip().startswith(("#", "-"))]
        elif name == "setup.py":
            out = [norm(x) for block in re.findall(r"(?s)(?:install_requires|extras_require)\s*=\s*[\[{](.*?)[\]}]", content) for x in re.findall(r"""['"]([A-Za-z0-9][^'"]*)['"]""", block)]
        elif re.search(r"\.github/workflows/[^/]+\.ya?ml$", path):
            out = re.findall(r"(?m)^\s*-?\s*uses:\s*['\"]?([^@\s'\"]+)", content)
    except (ValueError, AttributeError, TypeError):
        return []
    return sorted({x for x in out if x})


def packages(files_: DataFrame) -> DataFrame:
    """[S16] (path, package) of all dependency manifests."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, x) for p, c in zip(b["path"], b["content"], strict=True) for x in manifest_packages(p, c or "")]
            yield pd.DataFrame(rows, columns=["path", "package"])

    wanted = F.col("path").rlike(r"(^|/)(package\.json|pyproject\.toml|Pipfile|setup\.py|requirements[^/]*\.txt)$|\.github/workflows/[^/]+\.ya?ml$")
    return files_.filter(wanted).select("path", "content").mapInPandas(parse, "path string, package string")


def diff_lines(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """[S17] (commit, path, line_no, added, text) of unified diffs(commit, diff): what hunks add and remove."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for commit, diff in zip(b["commit"], b[text], strict=True):
                path, old, new, left, right = None, 0, 0, 0, 0
                for line in (diff or "").split("\n"):
                    if left > 0 or right > 0:
                        mark, rest = line[:1], line[1:]
                        if mark == "+":
                            rows.append((commit, path, new, True, rest))
                            new, right = new + 1, right - 1
                        elif mark == "-":
                            rows.append((commit, path, old, False, rest))
                            old, left = old + 1, left - 1
                        elif mark != "\\":
                            old, new, left, right = old + 1, new + 1, left - 1, right - 1
                    elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
                        old, new = int(m[1]), int(m[3])
                        left, right = (int(x) if x is not None else 1 for x in (m[2], m[4]))
                    elif line.startswith("+++ "):
                        target = line[4:].split("\t")[0].strip('"')
                        path = path if target == "/dev/null" else re.sub(r"^b/", "", target)
                    elif line.startswith("--- "):
                        path = re.sub(r"^a/", "", line[4:].split("\t")[0].strip('"'))
            yield pd.DataFrame(rows, columns=["commit", "path", "line_no", "added", "text"])

    return diffs.select("commit", text).mapInPandas(parse, "commit string, path string, line_no int, added boolean, text string")


def marked_corpus(lines: DataFrame, by: str, order: str, least: int = 50, most: int = 150) -> DataFrame:
    """[S18] Entries of a LaTeX source: each address with the sections above it, once, with enough words, at most so many.

    ``lines(by, order, text)``; the limit is the corpus's size and counts in the order of the source.
    """
    mark = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = lines.withColumns({"section": F.last(mark(r"\\section\{([^}]*)\}"), True).over(w), "dimension": F.last(mark(r"\\subsection\{([^}]*)\}"), True).over(w), "category": F.last(mark(r"\\paragraph\{([^}]*)\}"), True).over(w), "url": mark(r"\\(?:url|href)\{([^}]*)\}"), "words": F.size(F.split(F.trim("text"), r"\s+"))})
    kept = found.filter((F.col("words") >= least) & F.col("url").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy(by, order))).filter("_r = 1").drop("_r")
    return kept.orderBy(by, order).limit(most)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """[S19]"""
    s = spark.read.schema("url STRING, category STRING").json(path)
    return s.filter(F.startswith("url", F.lit("https://github.com/"))).select(F.regexp_replace("url", "/+$", "").alias("url"), F.coalesce("category", F.lit("uncategorised")).alias("category"))


def checked_config(df: DataFrame) -> DataFrame:
    """[S21] Checks(id, modes, pattern) of one configuration; raises where ids repeat, modes lack or a pattern has no group."""
    repeated = F.count("*").over(Window.partitionBy("id")) > 1
    bad = F.when(repeated, F.concat(F.lit("repeated id "), "id")).when(F.coalesce(F.size("modes"), F.lit(0)) <= 0, F.concat(F.lit("no modes for "), "id")).when(F.col("pattern").isNotNull() & ~F.col("pattern").rlike(r"(?<!\\)\((?!\?[:=!<])"), F.concat(F.lit("no capture group in "), "id"))
    return df.withColumn("_bad", bad).filter(F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("boolean")).otherwise(F.lit(True))).drop("_bad")


def snapshot(kinds: dict[str, DataFrame]) -> DataFrame:
    """[S20] (kind, n, rows): every node of every kind as JSON, with counts."""
    parts = [df.select(F.lit(k).alias("kind"), F.to_json(F.struct("*")).alias("row")) for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normalised(records: DataFrame, shape: dict[str, list[str]], payload: str = "raw_json") -> DataFrame:
    """[S14] One column for each name: the first path of a payload that is not null."""
    return records.select("*", *[F.coalesce(*[F.get_json_object(payload, p) for p in paths]).alias(n) for n, paths in shape.items()])


Transport = Callable[[str, dict], str]
