"""Point and batch lookups over symbols and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FUZZY_NAMES


def list_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("id")


def list_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src_id", "dst_id", "kind")


def check_table_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"INVALID_ARGUMENT: table {name!r}")
    return name


def symbols_in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path).orderBy("id")


def symbols_by_values(symbols: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose column is one of the (distinct) values, by id; the list is an IN predicate that reaches the scan."""
    if column not in ("id", "qualified_name", "name"):
        raise ValueError(f"INVALID_ARGUMENT: column {column!r}")
    return symbols.where(F.col(column).isin(*sorted(set(values)))).orderBy("id")


def hydrate(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of ``ids(symbol_id, pos)`` in the asked order; unknown ids drop out."""
    return ids.join(symbols, ids["symbol_id"] == symbols["id"]).orderBy("pos")


def resolve_symbols(ids: list[str], symbols: DataFrame, most: int = 50) -> tuple[DataFrame, list[str]]:
    """Known symbols in request order and the ids that are missing; more than ``most`` ids is an error."""
    if len(ids) > most:
        raise ValueError(f"INVALID_ARGUMENT: at most {most} ids")
    asked = symbols.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "symbol_id string, pos int")
    known = hydrate(asked, symbols)
    have = {r["id"] for r in known.select("id").collect()}  # at most `most` rows
    return known, [i for i in ids if i not in have]


def resolve_symbol(symbols: DataFrame, needle: str, kind: str | None = None, fuzzy: int = FUZZY_NAMES) -> DataFrame:
    """The one best symbol: exact id, qualified name, name, case-blind name, then parts among the first names.

    One scan ranks all rungs; the last rung sees only the first ``fuzzy`` symbols by lower-case name.
    """
    pool = symbols if kind is None else symbols.where(F.col("kind") == kind)
    low = needle.lower()
    exact = F.when(F.col("id") == needle, 7).when(F.col("qualified_name") == needle, 6).when(F.col("name") == needle, 5).when(F.lower("name") == low, 4)
    sure = pool.select("*", exact.alias("_rung")).where("_rung IS NOT NULL")
    near = pool.orderBy(F.lower("name"), "id").limit(fuzzy).select("*", part_rank(low).alias("_rung")).where("_rung IS NOT NULL")
    return sure.unionByName(near).orderBy(F.desc("_rung"), "id").limit(1).drop("_rung")


def part_rank(low: str) -> Column:
    """3: name equal, 2: name or qualified name contains, 1: id contains (case-blind)."""
    has = lambda c: F.contains(F.lower(c), F.lit(low))
    return F.when(F.lower("name") == low, 3).when(has("name") | has("qualified_name"), 2).when(has("id"), 1)


def resolve_symbol_scan(symbols: DataFrame, needle: str) -> DataFrame:
    """The same ladder over all symbols, without the bound on the last rung: the oracle of the bounded form."""
    low = needle.lower()
    rank = F.when(F.col("id") == needle, 6).when(F.col("qualified_name") == needle, 5).when(F.col("name") == needle, 4).otherwise(part_rank(low))
    return symbols.select("*", rank.alias("_rung")).where("_rung IS NOT NULL").orderBy(F.desc("_rung"), "id").limit(1).drop("_rung")


def edges_incident(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct edges with an endpoint in ``ids(id)``."""
    keys = ids.select("id").distinct()
    parts = []
    if direction in ("out", "both"):
        parts.append(edges.join(keys, edges["src_id"] == keys["id"], "left_semi"))
    if direction in ("in", "both"):
        parts.append(edges.join(keys, edges["dst_id"] == keys["id"], "left_semi"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.dropDuplicates(["src_id", "dst_id", "kind"])


def resolve_labels(symbols: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels(name, path_part)`` with the symbols of that name whose normalized path contains the part."""
    path = F.lower(F.replace(symbols["file_path"], F.lit("\\"), F.lit("/")))
    return labels.join(symbols, (labels["name"] == symbols["name"]) & F.contains(path, labels["path_part"])).select(labels["*"], symbols["id"].alias("symbol_id"))


def is_test(name: Column, path: Column) -> Column:
    # Marks of test symbols.
    n, p = F.lower(name), F.lower(path)
    ends = ("_test.py", "_test.go", "_test.rs", ".test.ts", ".spec.ts", ".test.js", ".spec.js", "test.java", "tests.cs")
    out = n.startswith("test_") | n.endswith("_test") | F.contains(p, F.lit("/test/")) | F.contains(p, F.lit("/tests/")) | p.startswith("test/") | p.startswith("tests/")
    for e in ends:
        out = out | p.endswith(e)
    return out


def is_entrypoint(kind: Column, name: Column, path: Column) -> Column:
    # Marks of entry points (case matters).
    out = (kind == "route") | (name == "main") | name.startswith("handle_") | name.endswith("Handler") | name.endswith("Controller")
    for part in ("routes", "controllers", "api/"):
        out = out | F.contains(path, F.lit(part))
    return out
