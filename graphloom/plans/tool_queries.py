"""Queries that publish the test tables as a store of symbols and edges, and ask the tools about it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..schema import EDGE, FILE, SYMBOL
from ..sources.store import Batch, Store
from .graph_tables import SMALL_SQL, small_edges, table
from .registry import query, r
from .tools import Engine

_OF = {"c": ("customer", "c_custkey", "c_name"), "s": ("supplier", "s_suppkey", "s_name"), "n": ("nation", "n_nationkey", "n_name"), "r": ("region", "r_regionkey", "r_name")}
_SYM = "sym AS (" + " UNION ALL ".join(f"SELECT '{p}:' || {k} AS id, {n} AS name, '{p}.' || {n} AS qualified_name, '{t}/' || {k} % 10 || '.py' AS file_path FROM {t}" for p, (t, k, n) in _OF.items()) + ")"


def _fit(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in its order, null where ``df`` lacks them."""
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def _store(spark, d) -> Store:
    """Customers, suppliers, nations and regions as symbols in ten files a table, published as generation 1."""
    symbols = None
    for prefix, (name, key, label) in _OF.items():
        k = F.col(key).cast("string")
        rows = table(spark, d, name).select(
            F.concat(F.lit(f"{prefix}:"), k).alias("id"), F.lit("function").alias("kind"), F.col(label).alias("name"), F.concat(F.lit(f"{prefix}."), label).alias("qualified_name"),
            F.lit("python").alias("language"), F.concat(F.lit(f"{name}/"), (F.col(key) % 10).cast("string"), F.lit(".py")).alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
        )
        symbols = rows if symbols is None else symbols.unionByName(rows)
    files = symbols.select(F.col("file_path").alias("path"), "language", F.lit("ok").alias("parse_status")).distinct()
    store = Store(spark, f"{shared_folder(spark)}/graphloom/tools-{uuid.uuid4().hex[:12]}")
    store.publish(Batch({"symbol": _fit(symbols, SYMBOL), "edge": _fit(small_edges(spark, d), EDGE), "file": _fit(files, FILE)}, {}, "initial"))
    return store


def _engine(spark, d) -> Engine:
    return Engine(spark, _store(spark, d), soft=600, hard=900)


# Every text is the name and the qualified name, so each word of a name counts twice in it.
_HITS = rf"""WITH {_SYM}, t AS (SELECT id, name, list_filter(regexp_split_to_array(lower(name || ' ' || qualified_name), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS toks FROM sym),
  c AS (SELECT count(*) AS n, avg(len(toks)) AS al, count(*) FILTER (list_contains(toks, w)) AS df, any_value(w) AS w FROM t, (SELECT lower(regexp_extract(n_name, '[A-Za-z0-9]+')) AS w FROM nation WHERE n_nationkey = 3)),
  h AS (SELECT id, name, len(list_filter(toks, lambda x: x = w)) AS f, len(toks) AS l, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, al FROM t, c WHERE list_contains(toks, w)),
  b AS (SELECT id, name, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al)) AS score FROM h ORDER BY score DESC, id LIMIT 8)"""


def _word(spark, d) -> str:
    return table(spark, d, "nation").where("n_nationkey = 3").select(F.lower(F.regexp_extract("n_name", "[A-Za-z0-9]+", 0))).first()[0]


@query("tool_symbol_search", f"{_HITS} SELECT id AS symbol_id, name, round(score, 6) AS score FROM b")
def tool_symbol_search(spark, d):
    return _engine(spark, d).symbol_search(_word(spark, d), 8).rows.select("symbol_id", "name", r("score").alias("score"))


@query("tool_discover_symbols", f"{_HITS} SELECT id AS symbol_id, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)), 6) AS score, 'lexical' AS sources FROM b")
def tool_discover_symbols(spark, d):
    return _engine(spark, d).discover_symbols(_word(spark, d), 8).rows.select("symbol_id", r("score").alias("score"), F.array_join("match_sources", ",").alias("sources"))


@query("tool_symbol_lookup", f"WITH {_SYM} SELECT id, name, file_path FROM sym WHERE name = (SELECT n_name FROM nation WHERE n_nationkey = 3) ORDER BY id LIMIT 1")
def tool_symbol_lookup(spark, d):
    name = table(spark, d, "nation").where("n_nationkey = 3").select("n_name").first()[0]
    return _engine(spark, d).symbol_lookup(name.swapcase() if name.swapcase() != name else name).rows.select("id", "name", "file_path")


@query(
    "tool_dependency_trace",
    f"""WITH {_SYM}, e AS ({SMALL_SQL}), h1 AS (SELECT DISTINCT src_id AS id FROM e WHERE dst_id = 'r:1'), h2 AS (SELECT DISTINCT src_id AS id FROM e WHERE dst_id IN (SELECT id FROM h1))
    SELECT id AS symbol_id, hop, name, 1.0 / hop AS score FROM (SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2) JOIN sym USING (id)""",
)
def tool_dependency_trace(spark, d):
    return _engine(spark, d).dependency_trace("r:1", "in", 2).rows.select("symbol_id", "hop", "name", "score")


@query("tool_resolve_symbols", f"WITH {_SYM} SELECT id, name FROM sym WHERE id IN ('n:3', 'c:1', 'r:0')")
def tool_resolve_symbols(spark, d):
    return _engine(spark, d).resolve_symbols(["n:3", "none", "c:1", "r:0"]).rows.select("id", "name")


@query(
    "store_generations",
    f"""WITH {_SYM}, e AS ({SMALL_SQL}), gone AS (SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_regionkey = 0)
    SELECT 1 AS generation, (SELECT count(*) FROM sym) AS n_symbols, (SELECT count(*) FROM e) AS n_edges, 0 AS n_flagged
    UNION ALL SELECT 2, (SELECT count(*) FROM sym WHERE id NOT IN (SELECT id FROM gone)), (SELECT count(*) FROM e WHERE src_id NOT IN (SELECT id FROM gone)),
      (SELECT count(*) FROM e WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id IN (SELECT id FROM gone))""",
)
def store_generations(spark, d):
    """Counts of two generations; the second deletes the nations of a region, and the first stays readable."""
    store = _store(spark, d)
    first = store.snapshot()
    gone = table(spark, d, "nation").where("n_regionkey = 0").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"))
    store.publish(Batch({}, {"symbol": gone}, "incremental"))

    def counts(snapshot) -> DataFrame:
        e = snapshot.table("edge").agg(F.count("*").alias("n_edges"), F.count_if(F.coalesce("meta.dst_missing", F.lit(False))).alias("n_flagged"))
        n = snapshot.table("symbol").agg(F.count("*").alias("n_symbols"))
        return n.crossJoin(e).select(F.lit(snapshot.generation).alias("generation"), "n_symbols", "n_edges", "n_flagged")  # two single rows

    return counts(first).unionByName(counts(store.snapshot()))
