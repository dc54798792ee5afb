"""Column expressions over text: addresses, identifiers, names, phrases, excerpts, quotes, dates, hashes.

All are built-in expressions that stay inside generated code; the few that need Python say so.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts, owners and query parameters with a meaning of their own.
RESERVED_OWNERS = ("about", "contact", "features", "login", "logout", "marketplace", "notifications", "orgs", "pricing", "search", "settings", "signup", "sponsors", "topics", "trending")
TRACKING = ("utm_", "ref_", "mc_", "fbclid", "gclid")
STOP_WORDS = ("a", "an", "the", "of", "for", "and", "or", "in", "on", "to", "with", "by", "from", "at", "is", "are", "as", "via", "using")
DAY = "yyyy-MM-dd"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit(""))


# --- assembling text -------------------------------------------------------------------------------------------------


def joined_lines(*parts: Column | str) -> Column:
    """[P01] Parts one a line; a null keeps its empty line."""
    return F.concat_ws("\n", *[F.coalesce(_c(p), F.lit("")) for p in parts])


def joined_nonempty(parts: list[Column | str], sep: str = " ") -> Column:
    """[P02] Trimmed parts that are not empty."""
    return F.concat_ws(sep, F.filter(F.transform(F.array(*[_c(p) for p in parts]), lambda x: F.trim(x)), lambda x: x != ""))


def composed_document(name: Column | str, summary: Column | str, readme: Column | str, readme_chars: int = 12_000, max_chars: int = 25_000) -> Column:
    """[P03] Name, summary and the head of the readme, within budgets."""
    return F.left(joined_nonempty([name, summary, F.left(_c(readme), F.lit(readme_chars))], "\n"), F.lit(max_chars))


def truncated(x: Column | str, n: int) -> Column:
    """At most n characters, the last an ellipsis if any were cut."""
    x = _c(x)
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.left(x, F.lit(n - 1))), F.lit("…"))).otherwise(x)


def cut_at_space(x: Column | str, n: int) -> Column:
    """At most n characters, cut at the last space within."""
    x = _c(x)
    head = F.left(x, F.lit(n))
    return F.when(F.length(x) <= n, x).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"^(?s)(.*)\s", 1), F.lit("")), head))


# --- addresses -------------------------------------------------------------------------------------------------------


def repository_url(url: Column | str) -> Column:
    """``https://github.com/<owner>/<repo>`` in lower case; null for anything that names no repository there."""
    path = F.lower(F.trim(_c(url)))
    path = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"/+$", "")
    path = F.regexp_replace(path, r"\.git$", "")
    pattern = r"^(?:https?://)?(?:[^/@]*@)?(?:www\.)?github\.com(?::\d+)?/([a-z0-9][a-z0-9-]*)/([a-z0-9._-]+)(?:/.*)?$"
    owner, repo = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
    return F.when((owner != "") & ~owner.isin(*RESERVED_OWNERS) & ~repo.isin(".", ".."), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo))


def repository_key(url: Column | str) -> Column:
    """``owner/repo`` of a repository address."""
    return F.nullif(F.regexp_replace(repository_url(url), r"^https://github\.com/", ""), F.lit(""))


def canonical_url(url: Column | str) -> Column:
    """Scheme and host in lower case, default ports, trailing slashes, tracking and blank parameters and the fragment dropped.

    Parameters are decoded and encoded anew, so that one spelling of each is left; an address without a scheme is https.
    """
    u = F.trim(_c(url))
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme, host, path, query = (F.regexp_extract(u, pattern, i) for i in range(1, 5))
    scheme, host, path = F.coalesce(F.nullif(F.lower(scheme), F.lit("")), F.lit("https")), F.lower(host), F.regexp_replace(path, "/+$", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.translate(x, "+", " "))
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", ""))).alias("v")))
    tracked = lambda p: reduce(lambda a, b: a | b, [F.startswith(F.lower(p["k"]), F.lit(t)) for t in TRACKING])
    q = F.array_join(F.transform(F.filter(pairs, lambda p: (F.coalesce(p["v"], F.lit("")) != "") & ~tracked(p)), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    slashes = F.when((host != "") | F.startswith(path, F.lit("/")), F.lit("://")).otherwise(F.lit(":"))
    whole = F.concat(scheme, slashes, host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.when(u != "", whole).otherwise(u)


def url_host(url: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def repository_url_cased(url: Column | str) -> Column:
    """As a repository address, but the case of its path stays."""
    u = F.regexp_replace(F.regexp_replace(F.trim(_c(url)), r"[?#].*$", ""), r"(?:\.git)?/*$", "")
    pattern = r"^(?i:https?://)?(?i:www\.)?(?i:github\.com)/([^/\s]+)/([^/\s]+)(?:/.*)?$"
    return F.when(u.rlike(pattern), F.concat(F.lit("https://github.com/"), F.regexp_extract(u, pattern, 1), F.lit("/"), F.regexp_extract(u, pattern, 2)))


def is_repository_url(url: Column | str) -> Column:
    """Whether the text is one repository address without a path below it."""
    return F.trim(_c(url)).rlike(r"(?i)^https?://(?:www\.)?github\.com/[A-Za-z0-9][A-Za-z0-9-]*/[A-Za-z0-9._-]+/?$")


def first_url(text: Column | str) -> Column:
    """The first address in a text, without the marks that end a sentence."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(text), r"https?://[^\s<>\"]+", 0), r"[.,;:)\]}!?']+$", ""), F.lit(""))


def first_by(values: Column, key) -> Column:
    """Array elements in order, each key (a function of an element) once."""
    step = lambda acc, x: F.when(F.exists(acc, lambda y: key(y) == key(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(values, F.array().cast("array<string>"), step)


def repository_urls(text: Column | str) -> Column:
    """All repository addresses in a text, in order, each once whatever its case."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(?i)https?://(?:www\.)?github\.com/[A-Za-z0-9][A-Za-z0-9-]*/[A-Za-z0-9._-]+"), F.lit(0))
    return first_by(F.transform(found, lambda x: F.regexp_replace(x, r"(?:\.git)?[.,;]*$", "")), F.lower)


def links(html: Column | str) -> Column:
    """[S10 F05] Targets of the links of a page, in order."""
    return F.regexp_extract_all(_c(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


# --- identifiers -----------------------------------------------------------------------------------------------------


def arxiv_ids(text: Column | str) -> Column:
    """New-style ids first, then old ones, each once."""
    new = F.regexp_extract_all(_c(text), F.lit(r"(?<![\d.])(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)"), F.lit(1))
    old = F.regexp_extract_all(_c(text), F.lit(r"\b([a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?\b"), F.lit(1))
    return F.array_distinct(F.concat(new, old))


def dois(text: Column | str) -> Column:
    """DOIs without trailing marks, each once whatever its case."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)"), F.lit(1))
    return first_by(F.transform(found, lambda x: F.regexp_replace(x, r"[.,);\]]+$", "")), F.lower)


def emails(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))


def bare_arxiv_id(x: Column | str) -> Column:
    """Without prefix and version."""
    return blank_to_null(F.regexp_replace(F.regexp_replace(F.trim(_c(x)), r"(?i)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:\s*)", ""), r"(?:v\d+)?(?:\.pdf)?$", ""))


def bare_doi(x: Column | str) -> Column:
    return blank_to_null(F.lower(F.regexp_replace(F.trim(_c(x)), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")))


def proposed_item_id(url: Column | str, title: Column | str) -> Column:
    """[F16] The repository's name, else the title."""
    return F.coalesce(kebab(F.nullif(F.regexp_extract(repository_url(url), "([^/]+)$", 1), F.lit(""))), kebab(title))


def proposed_paper_id(arxiv: Column | str, doi: Column | str, title: Column | str) -> Column:
    """[F16]"""
    return F.coalesce(F.concat(F.lit("arxiv-"), F.regexp_replace(bare_arxiv_id(arxiv), "[./]", "-")), F.concat(F.lit("doi-"), kebab(bare_doi(doi))), kebab(title))


# --- names -----------------------------------------------------------------------------------------------------------


def kebab(x: Column | str) -> Column:
    """Lower case, anything but letters and digits as single hyphens; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def camel_kebab(x: Column | str) -> Column:
    """Kebab case that also parts camel case."""
    return kebab(F.regexp_replace(F.regexp_replace(_c(x), "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2"))


def slug(x: Column | str, words: int = 5) -> Column:
    """The first words that say something."""
    parts = F.filter(F.split(kebab(x), "-"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.nullif(F.array_join(F.slice(parts, 1, words), "-"), F.lit(""))


# Letters with marks and what stands for them.
_MARKED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžčćđőűłńśźż", "aaaaaaceeeeiiiinoooooouuuuyyszccdoulnszz"


def unmarked(x: Column | str) -> Column:
    """Letters without their marks, lower case (a fixed table; letters outside it stay)."""
    return F.translate(F.lower(_c(x)), _MARKED, _PLAIN)


def surname(author: Column | str) -> Column:
    """``Last, First`` or ``First Last Jr.``: the last name, plain."""
    a = F.regexp_replace(F.trim(_c(author)), r"(?i),?\s+(jr|sr|ii|iii|iv)\.?$", "")
    last = F.when(F.instr(a, ",") > 0, F.split_part(a, F.lit(","), F.lit(1))).otherwise(F.regexp_extract(a, r"(\S+)$", 1))
    return F.nullif(F.regexp_replace(unmarked(last), "[^a-z]", ""), F.lit(""))


def compact(x: Column | str) -> Column:
    """[F17]"""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def package_name(x: Column | str) -> Column:
    """A package name in its normal form."""
    return F.regexp_replace(F.lower(F.trim(_c(x))), "[-_.]+", "-")


def display_name(title: Column | str, repo: Column | str) -> Column:
    """The name in brackets after a title, else its head before a colon or dash, else the repository's name."""
    t = F.trim(_c(title))
    bracket = F.nullif(F.regexp_extract(t, r"\(([A-Za-z][\w.-]{1,30})\)\s*$", 1), F.lit(""))
    return F.coalesce(bracket, blank_to_null(F.regexp_extract(t, r"^(.+?)(?:\s+[-–—]\s+|:\s+)", 1)), blank_to_null(t), _c(repo))


# --- phrases and scores ------------------------------------------------------------------------------------------------


def phrase_pattern(words: list[str]) -> str:
    """A phrase by itself in a text of one case: not inside a word, any white space between its words."""
    return r"(?U)(?<!\w)" + r"\s+".join(map(re.escape, words)) + r"(?!\w)"


def phrase_hits(text: Column | str, rules: dict[str, list[str]]) -> Column:
    """[F08 P12] Map of each class that is hit to its phrases, in the rules' order.

    A text is brought to one case once; a phrase's longest word is searched for as plain bytes first, and only where it
    stands does the pattern run, which then mostly ends at that place.
    """

    def hit(low: Column, phrase: str) -> Column:
        words = phrase.upper().lower().split()
        return F.when(F.contains(low, F.lit(max(words, key=len, default=""))) & low.rlike(phrase_pattern(words)), F.lit(phrase))

    def found(low: Column) -> Column:
        hits = [F.struct(F.lit(c).alias("key"), F.array_compact(F.array(*[hit(low, p) for p in ps])).alias("value")) for c, ps in rules.items()]
        return F.map_from_entries(F.filter(F.array(*hits), lambda x: F.size(x["value"]) > 0))

    # an array of one keeps the text in one case for all phrases; upper and then lower is how a pattern compares any case
    return F.transform(F.array(F.lower(F.upper(_c(text)))), found)[0]


def keyword_score(text: Column | str, weights: dict[str, float], ceiling: float = 10.0) -> Column:
    """The weights of the keywords that occur, each once, over the ceiling, within 0 and 1."""
    low = F.lower(_c(text))
    total = reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(k)), F.lit(float(w))).otherwise(F.lit(0.0)) for k, w in weights.items()])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.lit(ceiling)))


# --- excerpts --------------------------------------------------------------------------------------------------------


def without_markup(text: Column | str) -> Column:
    """Tags, images, link targets, rules and heading marks dropped."""
    out = F.regexp_replace(_c(text), r"(?s)<!--.*?-->|<[^>]+>", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(out, r"(?m)^\s*(?:#+|>|[-=*]{3,})\s*", "")


def first_paragraph(text: Column | str, letters: int = 10) -> Column:
    """The first paragraph with enough letters, on one line."""
    parts = F.transform(F.split(without_markup(text), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.get(F.filter(parts, lambda p: F.length(F.regexp_replace(p, "[^A-Za-z]", "")) >= letters), 0)


def first_sentence(text: Column | str, n: int = 140) -> Column:
    """[F19]"""
    whole = F.trim(F.regexp_replace(without_markup(text), r"\s+", " "))
    return truncated(F.coalesce(F.nullif(F.regexp_extract(whole, r"^(.+?[.!?])(?:\s|$)", 1), F.lit("")), whole), n)


def best_paragraph(text: Column | str, weights: dict[str, float], n: int = 400) -> Column:
    """[O15] The paragraph with the largest sum of positive weights, the first of equals, cut at a space."""
    parts = F.transform(F.split(_c(text), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    positive = {k: w for k, w in weights.items() if w > 0}
    scored = F.transform(F.filter(parts, lambda p: p != ""), lambda p, i: F.struct(keyword_score(p, positive, 1e9).alias("s"), (-i).alias("i"), p.alias("p")))
    return cut_at_space(F.array_max(scored)["p"], n)


# --- quotes, dates, hashes ---------------------------------------------------------------------------------------------


def plain_quote(x: Column | str) -> Column:
    """Lower case, typographic quotes and white space made plain, wrapping quotes dropped."""
    x = F.translate(F.lower(_c(x)), "“”„‘’‚«»", "\"\"\"'''\"\"")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "^[\"']+|[\"']+$", ""))


def verified_quotes(quotes: Column | str, source: Column | str) -> Column:
    """(verified, total) of an array of quotes; an empty quote is not verified."""
    text = F.regexp_replace(F.translate(F.lower(_c(source)), "“”„‘’‚«»", "\"\"\"'''\"\""), r"\s+", " ")
    quotes = F.coalesce(_c(quotes), F.array().cast("array<string>"))
    good = F.filter(quotes, lambda q: (F.coalesce(plain_quote(q), F.lit("")) != "") & F.contains(text, plain_quote(q)))
    return F.struct(F.size(good).alias("verified"), F.size(quotes).alias("total"))


def iso_date(x: Column | str) -> Column:
    """The date in the first ten characters; null if it is none."""
    return F.try_to_date(F.left(_c(x), F.lit(10)), DAY)


def relative_time(ts: Column, now: Column) -> Column:
    """How long ago, in the largest unit."""
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    return F.when(s < 60, F.lit("just now")).when(s < 3600, F.format_string("%dm ago", F.floor(s / 60))).when(s < 86400, F.format_string("%dh ago", F.floor(s / 3600))).otherwise(F.format_string("%dd ago", F.floor(s / 86400)))


def duration(seconds: Column) -> Column:
    """As ``1h 02m 03s``, without leading zeros."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%dh %02dm %02ds", h, m, s % 60))


def content_hash(url: Column | str, title: Column | str) -> Column:
    """[F23 K01] Identity of a raw result."""
    return F.md5(F.concat(F.coalesce(_c(url), F.lit("")), F.coalesce(_c(title), F.lit(""))).cast("binary"))


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts with a NUL between them."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256)


def star_text(stars: Column | str) -> Column:
    """1234 as 1.2k."""
    s = _c(stars)
    return F.when(s.isNull(), F.lit("—")).when(s >= 1000, F.format_string("%.1fk", s / 1000.0)).otherwise(s.cast("string"))


def display_size(stars: Column | str) -> Column:
    """[F29]"""
    return F.least(F.lit(36.0), F.greatest(F.lit(18.0), 18 + 4 * F.log10(F.coalesce(_c(stars), F.lit(0)) + 1.0)))


def json_path(payload: Column | str, path: str) -> Column:
    """A value by path; null where the path, a type on it or the text itself does not hold."""
    return F.get_json_object(_c(payload), path)


def closed_json(x: Column | str) -> Column:
    """A truncated object with its missing braces appended."""
    x = _c(x)
    missing = F.length(F.regexp_replace(x, r"[^{]", "")) - F.length(F.regexp_replace(x, r"[^}]", ""))
    return F.concat(x, F.repeat(F.lit("}"), F.greatest(missing, F.lit(0))))


def inline_call(x: Column | str, tool: str) -> Column:
    """The argument object of a call that stands inline in a text."""
    return closed_json(F.nullif(F.regexp_extract(_c(x), r"(?s)" + re.escape(tool) + r"\s*[:(>]*\s*(\{.*)", 1), F.lit("")))


def python_imports(x: Column | str) -> Column:
    """Roots of the packages that Python source imports."""
    found = F.regexp_extract_all(_c(x), F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_]\w*)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def script_imports(x: Column | str) -> Column:
    """Packages that JavaScript or TypeScript source imports; a scope keeps its second part."""
    found = F.regexp_extract_all(_c(x), F.lit(r"""(?:from|import|require\()\s*['"]([^'"./][^'"]*)['"]"""), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.regexp_extract(p, r"^(@[^/]+/[^/]+|[^/]+)", 1))))


def stub_marker(x: Column | str) -> Column:
    """A comment that marks unfinished work."""
    return _c(x).rlike(r"(?i)(?:#|//|/\*|<!--)\s*(?:todo|fixme|xxx|hack|stub)\b")


def is_test_file(path: Column | str) -> Column:
    """[F28]"""
    return _c(path).rlike(r"(?i)(?:^|/)(?:tests?|__tests__|spec)/|(?:^|/)test_[^/]*$|[._-](?:test|spec)\.[a-z]+$")


def tags(pairs: list[tuple[Column, str]], default: str, most: int = 6) -> Column:
    """[F32] Labels of the conditions that hold, in order, at most so many; the default if none does."""
    found = F.slice(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs])), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def ordered_union(a: Column, b: Column) -> Column:
    """[U04 F30] The first array, then what only the second has, in order."""
    return F.concat(a, F.array_distinct(F.array_except(b, a)))


def register(spark) -> list[str]:
    """[X08] The plain expressions as SQL functions of the session."""
    made = {
        "content_hash(url STRING, title STRING) RETURNS STRING": "md5(concat(coalesce(url, ''), coalesce(title, '')))",
        "kebab(x STRING) RETURNS STRING": "nullif(regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-'), '^-+|-+$', ''), '')",
        "compact(x STRING) RETURNS STRING": "regexp_replace(lower(x), '[^a-z0-9]', '')",
        "iso_date(x STRING) RETURNS DATE": "try_to_date(left(x, 10), 'yyyy-MM-dd')",
        "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (s, p) -> s + p)",
    }
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in made]
