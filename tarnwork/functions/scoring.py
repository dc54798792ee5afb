"""Scores, gates, bins and decision lists as column expressions.  Decisions use unrounded values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Thresholds and weights that define results.
PROMOTE, LOW_RELEVANCE = 0.15, 0.10
GATE = {"stars": 1000, "paper_citations": 2, "contributors": 3, "awesome_lists": 2}
EXCEPTIONAL_STARS, MIN_PASSES = 10_000, 2
TRENDING_FACTOR, TRENDING_BONUS, CITATION_WEIGHT, CITATION_CAP = 1.43, 0.20, 0.30, 6
STATUS_SCORE = {"stable": 0.5, "experimental": 0.2, "at_risk": -0.3, "deprecated": -1.0, "abandoned": -2.0}
MATURITY_BINS = ((7.0, "1A"), (5.5, "1B"), (4.7, "2A"), (4.0, "2B"), (2.5, "3"), (0.0, "4"))
MATURITY_CAPS = {"deprecated": "4", "abandoned": "4", "at_risk": "3", "experimental": "2B"}
RECENT_DAYS = 365
GRADES = ((0.80, "A"), (0.60, "B"), (0.40, "C"), (0.20, "D"))
TIER_BASE, DIVERSITY_BONUS = (0.0, 0.4, 0.7, 1.0), 0.10
ACCEPT, KEEP = 0.85, 0.5


def _size(a: Column | str, most: int) -> Column:
    return F.least(F.greatest(F.coalesce(F.size(X._c(a)), F.lit(0)), F.lit(0)), F.lit(most))


def exact_sum(value: Column) -> Column:
    """The sum of doubles by their decimal digits, ten places; the same in whatever order rows are added.

    A sum of doubles changes in its last digits with the order, which decides what stands exactly at a threshold.  Where a
    value is not finite or too large for that, the sum of doubles counts.
    """
    digits = value.try_cast("decimal(24,10)")
    return F.when(F.count(digits) == F.count(value), F.sum(digits).cast("double")).otherwise(F.sum(value))


def exact_mean(value: Column) -> Column:
    """The mean over ``exact_sum``."""
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))


def chain(conditions: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """A decision list: the value of the first condition that holds."""
    out = reduce(lambda acc, c: (F.when(*c) if acc is None else acc.when(*c)), [(c, v if isinstance(v, Column) else F.lit(v)) for c, v in conditions], None)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def binned(score: Column, bins: tuple[tuple[float, str], ...], otherwise: str) -> Column:
    """[P10] The label of the first threshold reached."""
    return chain([(score >= t, label) for t, label in bins], otherwise)


def grade(score: Column) -> Column:
    return binned(score, GRADES, "F")


def relevance(title: Column, snippet: Column, url: Column, raw: Column, source: Column, classes_hit: Column, signals_hit: Column) -> Column:
    """Additive score with caps; the numbers of classes and signals hit come from ``phrase_hits``."""
    whole = X.joined_lines(title, snippet, url, raw)
    paper = (F.size(X.arxiv_ids(whole)) > 0) | (F.size(X.dois(whole)) > 0)
    substance = F.length(F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))) >= 80
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    total = F.least(F.lit(0.4), classes_hit * 0.1) + F.least(F.lit(0.25), signals_hit * 0.05) + flag(F.size(X.repository_urls(whole)) > 0, 0.25) + flag(paper, 0.1) + flag(F.lower(F.coalesce(source, F.lit(""))) == "github", 0.05) + flag(substance, 0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def route(score: Column, kind: Column, url: Column, duplicate: Column) -> Column:
    """[P07] Where a raw result goes."""
    return chain([(score < LOW_RELEVANCE, "drop"), (kind.isNull(), "unclassified"), ((score < PROMOTE) & (kind == "tool"), "low_relevance"), (score < PROMOTE, "drop"), (X.blank_to_null(url).isNull(), "no_url"), (duplicate, "duplicate")], "promote")


def kind_of(incident: Column, paper: Column, tool: Column) -> Column:
    """[P12] incident before paper before tool; else null."""
    return chain([(incident, "incident"), (paper, "paper"), (tool, "tool")])


def gate(stars: Column, citations: Column, artifact: Column, contributors: Column, lists: Column, org: Column, orgs: list[str]) -> Column:
    """[P09] (decision, passed, n_passed, n_signals): enough of six criteria; a null signal neither passes nor fails."""
    checks = [("stars", stars, stars >= GATE["stars"]), ("paper_citations", citations, citations >= GATE["paper_citations"]), ("paper_artifact", artifact, artifact), ("contributors", contributors, contributors >= GATE["contributors"]), ("awesome_lists", lists, lists >= GATE["awesome_lists"]), ("alignment_org", org, F.lower(F.trim(org)).isin(*orgs) if orgs else F.lit(False))]
    passed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, _, c in checks], F.when(stars >= EXCEPTIONAL_STARS, F.lit("stars_exceptional"))))
    n_signals = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for _, s, _ in checks])
    return F.struct(F.when(F.size(passed) >= MIN_PASSES, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("decision"), passed.alias("passed"), F.size(passed).alias("n_passed"), n_signals.alias("n_signals"))


def effective_stars(stars: Column, trending: Column) -> Column:
    """Missing stars count as none here."""
    return F.coalesce(stars, F.lit(0)) * F.when(trending, F.lit(TRENDING_FACTOR)).otherwise(F.lit(1.0))


def reliability(stars: Column, citations: Column, status: Column, trending: Column) -> Column:
    """[F13]"""
    of_status = chain([(status == k, v) for k, v in STATUS_SCORE.items()], 0.0)
    return F.log10(effective_stars(stars, trending) + 1) + CITATION_WEIGHT * F.least(F.lit(CITATION_CAP), F.coalesce(citations, F.lit(0))) + of_status + F.when(trending, F.lit(TRENDING_BONUS)).otherwise(F.lit(0.0))


def maturity(today: Column) -> Column:
    """[F14 P10 P11] (score, tier) of an item frame's columns; a status caps the tier and a curator's override replaces it."""
    recent = F.when((F.datediff(today, F.col("last_updated")) <= RECENT_DAYS), F.lit(2.0)).otherwise(F.lit(0.0))
    stars = F.least(F.lit(5.0), F.log10(F.greatest(F.coalesce(F.col("stars"), F.lit(0)), F.lit(0)) + 1.0)) * 2.0 / 5.0
    score = _size("cited_in", 4) * 3.0 + _size("documented_in", 3) * 2.0 + _size("evaluated_on", 3) * 2.0 + _size("integration_surfaces", 5) * 0.5 + stars + recent
    labels = [label for _, label in MATURITY_BINS]
    rank = lambda c: chain([(c == label, i) for i, label in enumerate(labels)])
    tier = binned(score, MATURITY_BINS, "4")
    cap = chain([(F.lower(F.col("maturity_status")) == k, v) for k, v in MATURITY_CAPS.items()])
    capped = F.when(cap.isNotNull() & (rank(tier) < rank(cap)), cap).otherwise(tier)
    return F.struct(F.round(score, 2).alias("score"), F.coalesce(F.col("maturity_override.tier"), capped).alias("tier"))


def field_fallback(value: Column, confidence: Column, payload: Column) -> Column:
    """[P13] (value, reason): extracted if sure enough, else extracted with a note, else from the payload."""
    v = F.coalesce(F.when(confidence >= ACCEPT, value), F.when(confidence >= KEEP, value), payload)
    why = chain([((confidence >= ACCEPT) & value.isNotNull(), "accepted"), ((confidence >= KEEP) & value.isNotNull(), "kept_with_note"), (payload.isNotNull(), "payload")], "review_required")
    return F.struct(v.alias("value"), why.alias("reason"))


def missing(columns: list[str], arrays: list[str] = ()) -> Column:
    """[P14] Names of columns that are null, or empty lists."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns], *[F.when(F.col(c).isNull() | (F.size(c) == 0), F.lit(c)) for c in arrays]))


def staleness(date: Column, today: Column) -> Column:
    """[P15] (age_days, over_180, over_365)."""
    age = F.datediff(today, date)
    return F.struct(age.alias("age_days"), F.coalesce(age > 180, F.lit(False)).alias("over_180"), F.coalesce(age > 365, F.lit(False)).alias("over_365"))


#: Points by year and by citations, from the first that holds, and by what a reader can see.
YEAR_POINTS = ((2026, 5), (2025, 4), (2024, 2), (2022, 1))
CITATION_POINTS = ((500, 5), (100, 4), (30, 3), (10, 2), (3, 1))
OLD_YEAR, OLD_POINTS, NO_TEXT, NO_ABSTRACT, SHORT_ABSTRACT, SHORT_CHARS = 2018, -3, -1000, -5, -2, 200


def literature(text: Column, weights: dict[str, int], year: Column, citations: Column, tldr: Column, abstract: Column) -> Column:
    """Weights of the keywords that occur, with steps of recency, citations and abstract; a paper without text is out."""
    low, tldr, abstract = F.lower(F.coalesce(text, F.lit(""))), F.coalesce(tldr, F.lit("")), F.coalesce(abstract, F.lit(""))
    year, citations = F.coalesce(year, F.lit(0)), F.coalesce(citations, F.lit(0))
    keywords = reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(k)), F.lit(w)).otherwise(F.lit(0)) for k, w in weights.items()], F.lit(0))
    recent = chain([*[(year >= y, n) for y, n in YEAR_POINTS], ((year > 0) & (year < OLD_YEAR), OLD_POINTS)], 0)
    cited = chain([(citations >= c, n) for c, n in CITATION_POINTS], 0)
    seen = chain([((tldr == "") & (abstract == ""), NO_ABSTRACT), (F.length(F.trim(F.concat(tldr, F.lit(" "), abstract))) < SHORT_CHARS, SHORT_ABSTRACT)], 0)
    return F.when(low == "", F.lit(NO_TEXT)).otherwise(keywords + recent + cited + seen)


def topic_gate(text: Column, domain: list[str], concern: list[str], exclude: list[str], authors: Column, year: Column) -> Column:
    """[P08]"""
    low = F.lower(text)
    hit = lambda ks: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in ks]) if ks else F.lit(False)
    return F.coalesce(hit(domain) & hit(concern) & ~hit(exclude) & (F.size(authors) > 0) & (year >= 2017), F.lit(False))


def surfaces(declared: Column, override: Column, rules: list[tuple[str, str]], text: Column) -> Column:
    """[P16] Declared surfaces, else the override, else those whose pattern matches."""
    some = lambda a: F.when(F.size(a) > 0, a)
    found = F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(s)) for p, s in rules])))
    return F.coalesce(some(declared), some(override), found)


def outcome(code: Column) -> Column:
    """[P17] Of an exit code."""
    return chain([(code == 0, "pass"), (code == 1, "caught")], "error")


def eligible(item: Column, is_agent: Column, asker_is_agent: bool, blocked: list[str], modes: Column) -> Column:
    """[P06] Never what is blocked; an agent that asks gets no agents; something must be addressed."""
    ok = F.size(modes) > 0
    if blocked:
        ok = ok & ~item.isin(*blocked)
    return ok & ~is_agent if asker_is_agent else ok


def facets(filters: dict[str, object]) -> Column:
    """[P05] AND of the filters set: equality, ``modes`` for membership, ``min_stars`` (null stars fail it)."""
    ok = F.lit(True)
    for name, value in filters.items():
        if value is None:
            continue
        if name == "min_stars":
            ok = ok & (F.coalesce(F.col("stars"), F.lit(-1)) >= value)
        elif name == "mode":
            ok = ok & F.coalesce(F.array_contains("addresses", value), F.lit(False))
        else:
            ok = ok & (F.col(name) == value)
    return ok


def cell_tier(addressed: Column, mentioned: Column, cited: Column) -> Column:
    """Evidence of an item for a category: 0 not addressed, 1 declared, 2 also discussed, 3 also cited."""
    return chain([(~addressed, 0), (mentioned & cited, 3), (mentioned, 2)], 1)


def tier_score(best: Column, paradigms: Column) -> Column:
    """[A16] Best tier's base, with a bonus for two paradigms, at most 1."""
    base = F.element_at(F.array(*[F.lit(x) for x in TIER_BASE]), best + 1)
    return F.least(F.lit(1.0), base + F.when(paradigms >= 2, F.lit(DIVERSITY_BONUS)).otherwise(F.lit(0.0)))


def margin_confidence(top: Column, second: Column, strong: float = 0.8, clear: float = 0.75, slim: float = 0.55) -> Column:
    """[W04] From the lead of the best score over the next."""
    return chain([(top.isNull() | (top == 0), 0.30), (second.isNull() | (second == 0), strong), (top >= 2 * second, clear), (top > second, slim)], 0.35)
