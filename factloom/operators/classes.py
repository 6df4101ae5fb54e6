"""Languages, categories and secret carriers by path; flows by text and sets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.operators.filters import basename
from factloom.registry import query

# Languages by extension and by file name.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".cs": "csharp", ".swift": "swift", ".lua": "lua", ".rb": "ruby", ".rake": "ruby", ".php": "php",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".vue": "vue", ".svelte": "svelte", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell", ".bat": "batch", ".cmd": "batch",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".sass": "css", ".less": "css",
    ".md": "markdown", ".mdx": "markdown", ".rst": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".jsonc": "jsonc",
    ".toml": "toml", ".xml": "xml", ".xsl": "xml", ".xsd": "xml", ".plist": "xml", ".cfg": "config", ".ini": "config", ".env": "config",
    ".sql": "sql", ".graphql": "graphql", ".gql": "graphql", ".proto": "protobuf", ".prisma": "prisma", ".csv": "csv", ".tsv": "csv",
    ".tf": "terraform", ".tfvars": "terraform", ".gradle": "gradle",
    ".csproj": "csproj", ".sln": "sln", ".properties": "properties", ".mod": "mod", ".sum": "sum",
}
LANGUAGE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "GNUmakefile": "makefile", "makefile": "makefile", "Jenkinsfile": "jenkinsfile", "Procfile": "procfile", "Vagrantfile": "vagrantfile"}
CATEGORIES = {
    "docs": (".md", ".mdx", ".rst", ".txt", ".text"),
    "config": (".yaml", ".yml", ".json", ".jsonc", ".toml", ".xml", ".xsl", ".xsd", ".plist", ".cfg", ".ini", ".env", ".properties", ".csproj", ".sln", ".mod", ".sum", ".gradle"),
    "infra": (".tf", ".tfvars"),
    "data": (".sql", ".graphql", ".gql", ".proto", ".prisma", ".csv", ".tsv"),
    "script": (".sh", ".bash", ".zsh", ".ps1", ".psm1", ".psd1", ".bat", ".cmd"),
    "markup": (".html", ".htm", ".css", ".scss", ".sass", ".less"),
}
INFRA_NAMES = ("Dockerfile", ".dockerignore", "Makefile", "GNUmakefile", "makefile", "Jenkinsfile", "Procfile", "Vagrantfile", ".gitlab-ci.yml")
# What a file that carries secrets is called, and what is no such file.
SECRET_EXTENSIONS = ("env", "pem", "key", "jks", "p12", "pfx", "ppk", "der", "gpg")
TEMPLATE_SUFFIXES = ("example", "sample", "template", "dist")
SOURCE_EXTENSIONS = ("java", "js", "jsx", "ts", "tsx", "jsp", "md", "json", "html", "htm", "xml", "sql", "yml", "yaml", "properties", "kt", "py")


def _extension(path: Column) -> Column:
    """Extension in lower case with its dot; none for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def _dot_key(path: Column) -> Column:
    """What a name that starts with a dot begins with, as an extension."""
    return F.lower(F.regexp_extract(basename(path), r"^(\.[A-Za-z0-9]+)", 1))


def _from(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_of(path: Column) -> Column:
    """Dockerfiles, then the beginning of a dot file, then the extension (itself, if unknown), then the
    file name, else ``unknown``."""
    name, ext = basename(path), _extension(path)
    docker = (name == "Dockerfile") | name.startswith("Dockerfile.")
    by_ext = F.coalesce(_from(LANGUAGES, ext), F.when(F.length(ext) > 1, F.substring(ext, 2, 99)))
    return F.when(docker, "dockerfile").otherwise(F.coalesce(_from(LANGUAGES, _dot_key(path)), by_ext, F.when(ext == "", _from(LANGUAGE_NAMES, name)), F.lit("unknown")))


def category_of(path: Column) -> Column:
    """Licences are code; then infrastructure by name, then by path; then by extension and by the
    beginning of a dot file; else code."""
    name = basename(path)
    table = {e: c for c, exts in CATEGORIES.items() for e in exts}
    infra = name.isin(*INFRA_NAMES, "compose.yml", "compose.yaml") | name.startswith("Dockerfile.") | name.startswith("docker-compose.")
    infra |= path.startswith(".github/workflows/") | path.startswith(".circleci/") | path.rlike("(^|/)(k8s|kubernetes)/") | name.rlike(r"(?i)\.k8s\.ya?ml$")
    return F.when(name == "LICENSE", "code").when(infra, "infra").otherwise(F.coalesce(_from(table, _extension(path)), _from(table, _dot_key(path)), F.lit("code")))


def is_secret_carrier(path: Column) -> Column:
    """Private SSH keys whatever follows (but for public ones); then templates and sources are none;
    then names of key stores and any later part of the name that is a secret's extension."""
    name = basename(path)
    parts = F.split(name, r"\.")
    last = F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -1))).otherwise("")
    rest = F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda s: F.lower(s).isin(*SECRET_EXTENSIONS))
    return F.when(name.rlike(r"(?i)^id_(rsa|dsa|ecdsa|ed25519)\b"), ~name.rlike(r"(?i)\.pub$")).when(last.isin(*TEMPLATE_SUFFIXES, *SOURCE_EXTENSIONS), False).otherwise(name.rlike("(?i)keystore") | rest)


def publishable(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` without those that carry secrets."""
    return files.where(~is_secret_carrier(F.col("path")))


def composed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a text column in Unicode's composed form (NFC). Spark has no function for it, so texts
    that are not all ASCII go through Arrow; the others pass as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            plain = pc.fill_null(pc.string_is_ascii(text), True)
            if not pc.all(plain).as_py():
                composed = [unicodedata.normalize("NFC", x) for x in text.filter(pc.invert(plain)).to_pylist()]
                text = pc.replace_with_mask(text, pc.invert(plain), pa.array(composed, text.type))
            yield pa.record_batch([text if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def filter_flows(flows: DataFrame, text: str = "", groups: Sequence[str] = (), methods: Sequence[str] = (), verdicts: Sequence[str] = ()) -> DataFrame:
    """``flows(name, path, method, group, verdict, ...)``: a composed, case-free part of name, path or
    method, and each set, empty without a bound. A text may not run from one field into the next."""
    kept = flows
    for column, chosen in (("group", groups), ("method", methods), ("verdict", verdicts)):
        if chosen:
            kept = kept.where(F.col(column).isin(*chosen))
    wanted = unicodedata.normalize("NFC", text.strip()).lower()
    if not wanted:
        return kept
    hay = composed(kept.withColumn("_hay", F.concat_ws("\n", F.coalesce("name", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("method", F.lit("")))), "_hay")
    return hay.where(F.contains(F.lower("_hay"), F.lit(wanted))).drop("_hay")


NAMES = ("Dockerfile", "Dockerfile.dev", ".env", ".env.local", "a.TSX", "b.py", "Makefile", "LICENSE", "docker-compose.yml", "x.k8s.yaml", "c.unknownext", "noext", "id_rsa", "id_ed25519.pub", "id_rsa.ts", "my.keystore", "server.key.bak", "prod.env.example", "keystore.java", "cert.PEM", ".bashrc", "q.sql", "t.properties", "w.html", "n.tf", "compose.yaml")
FOLDERS = ("src/", "", ".github/workflows/", "deploy/k8s/", ".circleci/")


def _listed(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_PATHS = f"paths AS (SELECT p_partkey AS seq, concat([{_listed(FOLDERS)}][p_partkey % 5 + 1], [{_listed(NAMES)}][p_size % {len(NAMES)} + 1]) AS path, [{_listed(NAMES)}][p_size % {len(NAMES)} + 1] AS name FROM part)"
_EXT = r"lower(regexp_extract(name, '^.+(\.[^.]*)$', 1))"


def _when(table: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def _paths(t: Tables) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("seq"), F.concat(pick(FOLDERS, F.col("p_partkey") % 5), pick(NAMES, F.col("p_size") % len(NAMES))).alias("path"))


@query(
    "p7_language_category",
    rf"""{_PATHS}, x AS (SELECT *, {_EXT} AS ext, lower(regexp_extract(name, '^(\.[A-Za-z0-9]+)', 1)) AS dot FROM paths)
SELECT seq, path, CASE WHEN name = 'Dockerfile' OR starts_with(name, 'Dockerfile.') THEN 'dockerfile' ELSE coalesce({_when(LANGUAGES, 'dot')}, {_when(LANGUAGES, 'ext')}, CASE WHEN length(ext) > 1 THEN substr(ext, 2) END, CASE WHEN ext = '' THEN {_when(LANGUAGE_NAMES, 'name')} END, 'unknown') END AS language,
CASE WHEN name = 'LICENSE' THEN 'code' WHEN name IN ({_listed(INFRA_NAMES)}, 'compose.yml', 'compose.yaml') OR starts_with(name, 'Dockerfile.') OR starts_with(name, 'docker-compose.') OR starts_with(path, '.github/workflows/') OR starts_with(path, '.circleci/') OR regexp_matches(path, '(^|/)(k8s|kubernetes)/') OR regexp_matches(lower(name), '\.k8s\.ya?ml$') THEN 'infra'
ELSE coalesce({_when({e: c for c, exts in CATEGORIES.items() for e in exts}, 'ext')}, {_when({e: c for c, exts in CATEGORIES.items() for e in exts}, 'dot')}, 'code') END AS category FROM x""",
)
def _p7(t: Tables) -> DataFrame:
    return _paths(t).select("seq", "path", language_of(F.col("path")).alias("language"), category_of(F.col("path")).alias("category"))


@query(
    "p6_publishable",
    rf"""{_PATHS}, x AS (SELECT *, lower(CASE WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$') ELSE '' END) AS last FROM paths)
SELECT seq, path FROM x WHERE NOT CASE WHEN regexp_matches(lower(name), '^id_(rsa|dsa|ecdsa|ed25519)\b') THEN NOT regexp_matches(lower(name), '\.pub$') WHEN last IN ({_listed(TEMPLATE_SUFFIXES + SOURCE_EXTENSIONS)}) THEN FALSE ELSE contains(lower(name), 'keystore') OR len(list_filter(string_split(lower(name), '.')[2:], lambda s: s IN ({_listed(SECRET_EXTENSIONS)}))) > 0 END""",
)
def _p6(t: Tables) -> DataFrame:
    return publishable(_paths(t))


@query(
    "p3_composed_filter",
    """f AS (SELECT page_id AS seq, CASE page_id % 3 WHEN 0 THEN concat('Café ', page_id) WHEN 1 THEN concat('cafe', chr(769), ' ', page_id) ELSE concat('caf', page_id) END AS name, url AS path, CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'ANY' ELSE 'DELETE' END AS method, CASE page_id % 2 WHEN 0 THEN 'http' ELSE 'batch' END AS grp FROM pages)
SELECT seq, method FROM f WHERE grp IN ('http') AND page_id_kind(seq) UNION ALL SELECT -seq, method FROM f WHERE contains(lower(concat(path, chr(10), method)), 'post') OR contains(lower(name), 'post')""".replace("page_id_kind(seq)", "seq % 3 < 2"),
)
def _p3(t: Tables) -> DataFrame:
    n, text = F.col("page_id"), F.col("page_id").cast("string")
    name = F.when(n % 3 == 0, F.concat(F.lit("Café "), text)).when(n % 3 == 1, F.concat(F.lit("café "), text)).otherwise(F.concat(F.lit("caf"), text))
    method = F.when(n % 4 == 0, "GET").when(n % 4 == 1, "POST").when(n % 4 == 2, "ANY").otherwise("DELETE")
    flows = t.pages.select(n.alias("seq"), name.alias("name"), F.col("url").alias("path"), method.alias("method"), F.when(n % 2 == 0, "http").otherwise("batch").alias("group"), F.lit(None).cast("string").alias("verdict"))
    one = filter_flows(flows, " CAFÉ", groups=["http"]).select("seq", "method")
    return one.union(filter_flows(flows, "post").select((-F.col("seq")).alias("seq"), "method"))
