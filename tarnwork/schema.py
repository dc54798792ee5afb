"""Data model: node kinds of the catalog, closed domains, staging tables, and how domains become frames.

A missing list counts as an empty list; a missing number of stars counts as zero where it is scored and as unknown where it
gates.  Schemas are declared, never inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The closed domains.
DOMAINS: dict[str, tuple[str, ...]] = {
    "control_paradigm": ("prevention", "detection", "correction", "recovery"),
    "temporal_phase": ("pre_generation", "in_generation", "post_generation"),
    "autonomy_level": ("fully_autonomous", "graduated_hitl", "full_hitl"),
    "failure_mode": ("fabrication", "obsolescence", "dependency_blindness", "logic_error", "security_vulnerability", "scope_creep", "context_pollution", "supply_chain_attack", "cascading_failure", "incomplete_execution", "test_manipulation"),
    "locus_of_control": ("model", "prompt", "context", "environment", "human"),
    "integration_surface": ("ide_plugin", "desktop_app", "web_app", "cli", "library", "http_service", "mcp_server", "ci_app", "proxy_gateway"),
    "maturity_status": ("experimental", "stable", "at_risk", "deprecated", "abandoned"),
    "harm_class": ("user_reported", "data_loss", "security_breach", "financial_loss", "reputational"),
    "reproducibility": ("confirmed", "plausible", "anecdotal"),
    "evidence_tier": ("anecdotal", "case_studied", "benchmark_validated"),
    "crosswalk_confidence": ("exact", "partial", "broader", "narrower", "related"),
    "candidate_status": ("pending", "reviewed", "accepted", "rejected", "graduated", "low_relevance", "duplicate"),
}

RAW_RESULTS = "id BIGINT, source STRING, query STRING, url STRING, title STRING, snippet STRING, raw_json STRING, fetched_at TIMESTAMP"
RAW_READMES = "url STRING, content STRING, fetched_at TIMESTAMP"
CANDIDATE_ITEMS = "id BIGINT, source_url STRING, proposed_id STRING, name STRING, summary STRING, extracted STRING, nlp_tags STRUCT<relevance: DOUBLE, rerank_score: DOUBLE, dup_match: STRING>, status STRING, graduated_to STRING, created_at TIMESTAMP, reviewed_at TIMESTAMP, reviewer STRING"
CANDIDATE_PAPERS = "id BIGINT, source_url STRING, title STRING, authors ARRAY<STRING>, year INT, venue STRING, doi STRING, arxiv_id STRING, status STRING"
ITEMS = (
    "id STRING, name STRING, tagline STRING, description STRING, first_released DATE, last_updated DATE, maturity_status STRING, published_by STRING, repository_url STRING, license STRING, control_paradigm STRING, temporal_phase STRING, autonomy_level STRING, "
    "addresses ARRAY<STRING>, integration_surfaces ARRAY<STRING>, composes_with ARRAY<STRING>, supersedes ARRAY<STRING>, cited_in ARRAY<STRING>, documented_in ARRAY<STRING>, evaluated_on ARRAY<STRING>, stars INT, inclusion_rationale STRING, maturity_override STRUCT<tier: STRING, justification: STRING>"
)
CATEGORIES = "id STRING, name STRING, description STRING, detection_signals ARRAY<STRING>, prior_work ARRAY<STRING>, crosswalks ARRAY<STRUCT<taxonomy: STRING, external_id: STRING, confidence: STRING>>"
TAXONOMIES = "id STRING, name STRING, scope STRING, paper_id STRING, categories ARRAY<STRUCT<external_id: STRING, label: STRING, description: STRING>>"
CROSSWALKS = "id STRING, axis STRING, taxonomy STRING, mappings ARRAY<STRUCT<value: STRING, external_id: STRING, confidence: STRING>>"
INCIDENTS = "id STRING, title STRING, incident_date DATE, harm_class STRING, reproducibility STRING, exhibited ARRAY<STRING>, mitigated_by ARRAY<STRING>, documented_by ARRAY<STRING>"
RECIPES = "id STRING, targets ARRAY<STRING>, stack ARRAY<STRING>, evidence_tier STRING"
WEIGHTS = "category STRING, likelihood DOUBLE, impact INT"
EVENTS = "ts STRING, tool_id STRING, category STRING, mechanism STRING, detail STRING, invoked_by STRING"
CHECK_EVENTS = "v INT, ts STRING, commit STRING, commit_ts STRING, subject STRING, agent STRING, kit STRING, source STRING, tool_id STRING, category STRING, outcome STRING, blocking BOOLEAN, detail STRING, metric DOUBLE, metric_name STRING"
DIFF_LINES = "path STRING, line_no INT, added BOOLEAN, text STRING"

NODE_KINDS = {"item": ITEMS, "category": CATEGORIES, "taxonomy": TAXONOMIES, "crosswalk": CROSSWALKS, "incident": INCIDENTS, "recipe": RECIPES, "paper": CANDIDATE_PAPERS}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def domain(spark: SparkSession, name: str, values: tuple[str, ...] | None = None) -> DataFrame:
    """A closed domain as a frame (ordinal, name), for grids that show empty cells."""
    return spark.createDataFrame(list(enumerate(values or DOMAINS[name])), f"ordinal INT, {name} STRING")


def create_staging(spark: SparkSession, drop_first: bool = False) -> list[str]:
    """[K11] The staging tables as Parquet tables; uniqueness is kept by the merge sinks."""
    tables = {"raw_results": RAW_RESULTS + ", content_hash STRING", "raw_readmes": RAW_READMES, "candidate_items": CANDIDATE_ITEMS, "candidate_papers": CANDIDATE_PAPERS}
    for name, ddl in tables.items():
        if drop_first:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")
    return list(tables)
