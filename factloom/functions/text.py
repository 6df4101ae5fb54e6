"""Normalisers, tokenisers, paths, URLs, dates, ids and similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases of types, complexities and directions, as the tool chain knows them, in its order.
NODE_TYPES = {
    "func": "function", "fn": "function", "method": "function", "interface": "class", "struct": "class",
    "mod": "module", "pkg": "module", "package": "module", "container": "service", "deployment": "service",
    "pod": "service", "doc": "document", "readme": "document", "docs": "document", "job": "pipeline",
    "ci": "pipeline", "route": "endpoint", "api": "endpoint", "query": "endpoint", "mutation": "endpoint",
    "setting": "config", "env": "config", "configuration": "config", "infra": "resource",
    "infrastructure": "resource", "terraform": "resource", "migration": "table", "database": "table", "db": "table",
    "view": "table", "proto": "schema", "protobuf": "schema", "definition": "schema", "typedef": "schema",
    "business_domain": "domain", "business_flow": "flow", "business_process": "flow", "task": "step",
    "business_step": "step", "note": "article", "page": "article", "wiki_page": "article", "person": "entity",
    "actor": "entity", "organization": "entity", "tag": "topic", "category": "topic", "theme": "topic",
    "assertion": "claim", "decision": "claim", "thesis": "claim", "reference": "source", "raw": "source",
    "paper": "source",
}
EDGE_TYPES = {
    "extends": "inherits", "invokes": "calls", "invoke": "calls", "uses": "depends_on", "requires": "depends_on",
    "relates_to": "related", "related_to": "related", "similar": "similar_to", "import": "imports",
    "export": "exports", "contain": "contains", "publish": "publishes", "subscribe": "subscribes",
    "describes": "documents", "documented_by": "documents", "creates": "provisions", "exposes": "serves",
    "listens": "serves", "deploys_to": "deploys", "migrates_to": "migrates", "routes_to": "routes",
    "triggers_on": "triggers", "fires": "triggers", "defines": "defines_schema", "has_flow": "contains_flow",
    "next_step": "flow_step", "interacts_with": "cross_domain", "references": "cites", "cites_source": "cites",
    "conflicts_with": "contradicts", "disagrees_with": "contradicts", "refines": "builds_on",
    "elaborates": "builds_on", "illustrates": "exemplifies", "instance_of": "exemplifies",
    "example_of": "exemplifies", "belongs_to": "categorized_under", "tagged_with": "categorized_under",
    "written_by": "authored_by", "created_by": "authored_by",
}
COMPLEXITIES = {
    "low": "simple", "easy": "simple", "medium": "moderate", "intermediate": "moderate", "high": "complex",
    "hard": "complex", "difficult": "complex",
}
DIRECTIONS = {
    "to": "forward", "outbound": "forward", "from": "backward", "inbound": "backward", "both": "bidirectional",
    "mutual": "bidirectional",
}
PREFIXES = ("file", "function", "class", "module", "service", "table", "document")
STOP_WORDS = ("the", "and", "for", "with", "this", "that")


def alias(column: Column, table: dict[str, str]) -> Column:
    """Through an alias table, ignoring case; itself if unknown."""
    low = F.lower(F.trim(column))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), low), low)


def complexity(column: Column, low_number: str = "moderate") -> Column:
    """Names by alias; numbers 1-3 simple, 4-6 moderate, 7 and up complex, and below 1 what
    the dialect says; anything else moderate."""
    number = F.try_to_number(column, F.lit("999999"))
    named = alias(column, COMPLEXITIES)
    by_number = F.when(number < 1, low_number).when(number <= 3, "simple").when(number <= 6, "moderate").otherwise("complex")
    return F.when(number.isNotNull(), by_number).when(named.isin("simple", "moderate", "complex"), named).otherwise("moderate")


def node_id(column: Column) -> Column:
    """One canonical prefix: a leading project name and repeated prefixes go."""
    known = "|".join(PREFIXES)
    bare = F.regexp_replace(F.trim(column), f"^(?!(?:{known}):)[A-Za-z0-9_-]+:(?=(?:{known}):)", "")
    return F.regexp_replace(bare, f"^({known}):(?:\\1:)+", "$1:")


def weight(column: Column) -> Column:
    """A number held within 0 and 1, 0.5 if it is none."""
    number = column.try_cast("double")  # least and greatest skip nulls
    return F.when(number.isNull() | F.isnan(number), 0.5).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def identifier_tokens(column: Column, shortest: int = 3) -> Column:
    """Camel, acronym and digit borders split, lower case, short and stop words left out."""
    spaced = F.regexp_replace(F.regexp_replace(column, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.lower(spaced), r"[^a-z]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(*STOP_WORDS)))


def request_tokens(column: Column) -> Column:
    """Distinct sorted words of letters of any script."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def normal_path(path: Column) -> Column:
    """Without ``.``, ``..`` and empty segments."""
    step = lambda a, s: F.when(s.isin("", "."), a).when((s == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).when(s == "..", a).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def query_keys(url: Column) -> Column:
    """Sorted distinct names of the query, without session ids."""
    query = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"\?(.*)$", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: (n != "") & ~F.lower(n).isin("jsessionid", "phpsessid"))))


def slug(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), F.lit("-"))


def crud_verb(name: Column) -> Column:
    """Letter of a method name or SQL verb."""
    low = F.lower(name)
    return F.when(low.rlike("^(insert|create|add|save|register|regist)"), "C").when(low.rlike("^(update|modify|edit|set|change)"), "U").when(low.rlike("^(delete|remove|drop)"), "D").when(low.rlike("^(select|find|get|list|search|read|count|exists)"), "R")


def derived_columns(method: Column) -> Column:
    """Snake-case columns of a derived query such as findByFirstNameAndAgeGreaterThan."""
    tail = F.regexp_replace(F.regexp_extract(method, r"^(?:find|get|read|count|exists|delete)[A-Za-z]*?By(.+)$", 1), "OrderBy.*$", "")
    parts = F.filter(F.split(tail, r"And|Or(?=[A-Z])"), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.regexp_replace(p, "(GreaterThan|LessThan|Between|Like|In|IsNull|IsNotNull|Containing|StartingWith|EndingWith|IgnoreCase)$", ""))
    return F.array_sort(F.transform(bare, lambda p: F.lower(F.regexp_replace(p, "([a-z0-9])([A-Z])", "$1_$2"))))


def hash_id(tag: str, *parts: Column, digits: int = 8) -> Column:
    """A type tag and the first digits of a SHA-256."""
    return F.concat(F.lit(f"{tag}:"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def signature(title: Column, keys: Column) -> Column:
    """Hash over the title and the sorted distinct element keys."""
    return F.sha2(F.concat_ws("|", title, F.array_join(F.array_sort(F.array_distinct(keys)), ",")), 256)


def line_count(text: Column) -> Column:
    """Lines, a last line break not counted."""
    return F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n", -1))


def squeeze(text: Column) -> Column:
    """N13."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_case(column: Column) -> Column:
    """N19."""
    return F.initcap(F.regexp_replace(column, "[-_]+", " "))


def band(n: Column, low: int, high: int) -> Column:
    """N20."""
    return F.when(n <= low, "simple").when(n <= high, "moderate").otherwise("complex")


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def month_bounds(month: Column) -> tuple[Column, Column]:
    """First day of a ``YYYY-MM`` month and of the next one; null if it is none."""
    start = F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(month, F.lit("-01"))))
    return start, F.add_months(start, 1)


def weeks_back(instant: Column, weeks: int) -> Column:
    """The day so many weeks before an ISO instant; null if it is none."""
    return F.date_sub(F.to_date(F.try_to_timestamp(instant)), 7 * weeks)


def percent(part: Column, base: Column, empty: float = 0.0) -> Column:
    """Share in percent with one decimal; ``empty`` where the base is 0."""
    return F.when(base == 0, F.lit(empty)).otherwise(F.floor(part / base * 1000 + 0.5) / 10)


def translate_terms(text: Column, terms: dict[str, str]) -> tuple[Column, Column]:
    """The text with all terms replaced, longest first and equals in order of the alphabet,
    and how many were."""
    hits = F.lit(0)
    for old in sorted(terms, key=lambda k: (-len(k), k)):
        hits = hits + F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(old), F.lit("")))) / len(old))
        text = F.replace(text, F.lit(old), F.lit(terms[old]))
    return text, hits.cast("long")
