"""Text expressions: normalization, ids, tokens, redaction, attributes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXCERPT_BYTES


def normalize_body(body: Column) -> Column:
    """Body without block comments, docstrings and line comments, white space collapsed."""
    out = F.regexp_replace(body, r"(?s)/\*.*?\*/", " ")
    out = F.regexp_replace(out, r'(?s)""".*?"""', " ")
    out = F.regexp_replace(out, r"(?s)'''.*?'''", " ")
    out = F.regexp_replace(out, r"(//|#)[^\n]*", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def content_hash(body: Column) -> Column:
    return F.substring(F.sha2(normalize_body(body), 256), 1, 16)


def symbol_id(language: Column, path: Column, qualified: Column, body: Column) -> Column:
    return F.concat(language, F.lit(":"), path, F.lit(":"), qualified, F.lit("@"), content_hash(body))


def module_from_path(path: Column) -> Column:
    """Path with slashes turned and the last extension dropped; a dotfile keeps its name."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"([^/])\.[^./]*$", "$1")


def excerpt(text: Column, most: int = EXCERPT_BYTES) -> Column:
    """At most ``most`` bytes of UTF-8, cut between characters."""
    data = F.encode(text, "UTF-8")
    cut = F.substring(data, 1, most)
    # drop a character whose bytes are not all there: a lead byte with too few bytes after it
    tail = F.regexp_replace(F.hex(cut), "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])$", "")
    even = F.when(F.length(tail) % 2 == 0, tail).otherwise(F.hex(cut))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(even), "UTF-8"))


def camel_tokens(text: Column) -> Column:
    """Lower-case parts, longer than one character, of identifiers split at case changes."""
    runs = F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9]+"), F.lit(0)), " ")
    parts = F.regexp_replace(F.regexp_replace(runs, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z0-9])", "$1 $2")
    return F.filter(F.split(F.lower(parts), " "), lambda t: F.length(t) > 1)


def normalize_ident(name: Column) -> Column:
    """snake_case of an identifier, acronym aware, single underscores, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", ""))


def fts_literal(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


# Shapes of secrets (own list; the placeholder is ours too).
SECRETS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"sk-[A-Za-z0-9_\-]{20,}",
    r"xox[abprs]-[A-Za-z0-9\-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r'(?i)(?:token|secret|password|api_key)\s*[=:]\s*"[^"]{16,}"',
)
PLACEHOLDER = "[REDACTED]"
INJECTION = r"(?i)ignore previous|disregard above|you are now"


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, PLACEHOLDER)
    return text


def taint_flags(body: Column, signature: Column, docstring: Column) -> Column:
    """Flags of a symbol; the injection test reads the redacted texts."""
    texts = (body, signature, docstring)
    changed = F.coalesce(*[F.when(redact(t) != t, F.lit(True)) for t in texts], F.lit(False))
    joined = F.concat_ws("\n", *[redact(t) for t in texts])
    return F.filter(
        F.array(
            F.when(changed, F.lit("secret_redacted")),
            F.when(F.length(F.trim(F.coalesce(docstring, F.lit("")))) > 0, F.lit("untrusted_doc")),
            F.when(joined.rlike(INJECTION), F.lit("prompt_injection_high")),
        ),
        lambda f: f.isNotNull(),
    )


# Attribute patterns, key -> (pattern, group, prefix).
SQL_RESERVED = ("SET", "WHERE", "VALUES", "SELECT", "AND", "OR", "ON", "AS", "IN", "BY", "NULL")
ATTRIBUTES = (
    ("db_table", r"(?i)(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+(\w+)", 1, ""),
    ("http_route", r"""(?i)(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\(\s*['"/]([^'"\)\s]+)""", 1, ""),
    ("http_route", r"""(?i)\.(get|post|put|patch|delete|head|options|route)\s*\(\s*['"/]([^'"\)\s]+)""", 2, ""),
    ("env_var", r"""os\.environ\[['"](\w+)['"]\]""", 1, ""),
    ("env_var", r"""os\.getenv\(\s*['"](\w+)['"]\s*(?:,|\))""", 1, ""),
    ("env_var", r"""os\.environ\.get\(\s*['"](\w+)['"]\s*(?:,|\))""", 1, ""),
    ("env_var", r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)", 1, ""),
    ("env_var", r"""process\.env\[['"]([A-Za-z_][A-Za-z0-9_]*)['"]\]""", 1, ""),
    ("env_var", r"""os\.Getenv\(\s*["']([A-Za-z_][A-Za-z0-9_]*)["']\s*\)""", 1, ""),
    ("external_call", r"(?i)(?:^|[^\w])requests\.(get|post|put|delete|head|patch|request)\s*\(", 1, "requests."),
    ("external_call", r"(?i)(?:^|[^\w])httpx\.(get|post|put|delete|head|patch|request|asyncclient|client)\s*[\(\.]", 1, "httpx."),
    ("external_call", r"(?i)(?:^|[^\w])axios\.(get|post|put|delete|patch|create|request)\s*[\(\.]", 1, "axios."),
    ("external_call", r"(?:^|[^\w])(fetch)\s*\(", 1, ""),
    ("external_call", r"(?:^|[^\w])(http\.Get)\s*\(", 1, ""),
    ("external_call", r"(?:^|[^\w])(http\.Post)\s*\(", 1, ""),
    ("external_call", r"(?:^|[^\w])(http\.Client)\b", 1, ""),
)


def attributes(body: Column) -> Column:
    """Array of ``struct(key, value)``: distinct attributes of a body, before redaction."""
    body = F.coalesce(body, F.lit(""))
    found = []
    for key, pattern, group, prefix in ATTRIBUTES:
        values = F.regexp_extract_all(body, F.lit(pattern), F.lit(group))
        if key == "db_table":
            values = F.filter(values, lambda v: ~F.upper(v).isin(*SQL_RESERVED))
        elif key == "http_route":
            values = F.filter(values, lambda v: v.startswith("/"))
        found.append(F.transform(values, _attribute(key, prefix)))
    return F.array_distinct(F.concat(*found))


def _attribute(key: str, prefix: str):
    return lambda v: F.struct(F.lit(key).alias("key"), (F.concat(F.lit(prefix), F.lower(v)) if prefix else v).alias("value"))


def html_routes(html: Column) -> Column:
    """Distinct attribute values that begin with a slash."""
    double = F.regexp_extract_all(html, F.lit(r'=\s*"(/[^"]*)"'), F.lit(1))
    single = F.regexp_extract_all(html, F.lit(r"=\s*'(/[^']*)'"), F.lit(1))
    return F.array_distinct(F.concat(double, single))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.octet_length(text) / 4).cast("long"))


# Keywords of task modes, first match wins.
TASK_MODES = (
    ("bugfix", ("bug", "fix", "error", "fail", "crash", "broken")),
    ("refactor", ("refactor", "rename", "clean up", "restructure")),
    ("test", ("test", "coverage", "assert")),
    ("feature", ("add", "implement", "feature", "build", "create")),
    ("explain", ("how", "why", "explain", "understand", "what")),
)


def task_mode(task: Column) -> Column:
    low, out = F.lower(task), F.lit("chore")
    for mode, words in reversed(TASK_MODES):
        out = F.when(low.rlike("|".join(words)), F.lit(mode)).otherwise(out)
    return out


def string_literals(text: Column) -> Column:
    """Contents of quoted literals that hold no quote of their kind and no backslash."""
    pattern = r"""\"([^\"\\]*)\"|'([^'\\]*)'|`([^`\\]*)`"""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
