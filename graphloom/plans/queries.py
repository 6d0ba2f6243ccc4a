"""Registered queries of the engine's operators over the test tables, each with its SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import fusion, graph, impact, lexical, lookup, resolve, semantic
from ..plans import planner
from ..sources import store
from ..streaming import coalesce
from . import code_queries, tool_queries  # noqa: F401  (register their queries)
from . import samples as S
from .graph_tables import FULL_SQL, SMALL_SQL, TREE_SQL, full_edges, nodes_of, small_edges, table, tree_edges
from .registry import ORACLES, QUERIES, query, r

# ---- text

_CAMEL = "string_split(lower(regexp_replace(regexp_replace(array_to_string(regexp_extract_all({t}, '[A-Za-z][A-Za-z0-9]+'), ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z0-9])', '\\1 \\2', 'g')), ' ')"
_DOCS_TERMS = f"""terms AS (SELECT id, t AS term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_CAMEL.format(t="text")}) AS t FROM documents) WHERE length(t) > 1 GROUP BY ALL)"""


@query("lex_df_terms", f"WITH {_DOCS_TERMS} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM terms GROUP BY term")
def lex_df_terms(spark, d):
    post = lexical.postings(table(spark, d, "documents"), "doc_id", "text", T.camel_tokens)
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    "lex_tfidf_topk",
    f"""WITH {_DOCS_TERMS}, n AS (SELECT count(*) AS n FROM documents),
    idf AS (SELECT term, ln((n + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM terms, n GROUP BY term, n),
    norm AS (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM terms JOIN idf USING (term) GROUP BY id),
    q AS (SELECT * FROM (VALUES ('license', 2), ('licensed', 1), ('apache', 1)) q(term, qf))
    SELECT id AS doc_id, round(sum(qf * tf * idf * idf) / any_value(norm), 6) AS score FROM terms JOIN idf USING (term) JOIN q USING (term) JOIN norm USING (id)
    GROUP BY id ORDER BY sum(qf * tf * idf * idf) / any_value(norm) DESC, id LIMIT 25""",
)
def lex_tfidf_topk(spark, d):
    out = lexical.tfidf_search(table(spark, d, "documents"), "doc_id", "text", "license Licensed apache license", 25)
    return out.select(F.col("id").alias("doc_id"), r("score").alias("score"))


@query(
    "lex_bm25_topk",
    r"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks FROM documents),
    c AS (SELECT count(*) AS n, avg(len(toks)) AS al, count(*) FILTER (list_contains(toks, 'licensed')) AS d1, count(*) FILTER (list_contains(toks, 'under')) AS d2,
      count(*) FILTER (list_contains(toks, 'license')) AS d3 FROM t),
    m AS (SELECT id, len(toks) AS l, len(list_filter(toks, lambda x: x = 'licensed')) AS f1, len(list_filter(toks, lambda x: x = 'under')) AS f2,
      len(list_filter(toks, lambda x: x = 'license')) AS f3 FROM t WHERE list_contains(toks, 'licensed') AND list_contains(toks, 'under') AND list_contains(toks, 'license')),
    s AS (SELECT id, ln((n - d3 + 0.5) / (d3 + 0.5) + 1) * f3 * 2.2 / (f3 + 1.2 * (0.25 + 0.75 * l / al)) + ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / al))
      + ln((n - d2 + 0.5) / (d2 + 0.5) + 1) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / al)) AS score FROM m, c)
    SELECT id AS doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, id LIMIT 1000""",
)
def lex_bm25_topk(spark, d):
    out = lexical.bm25(table(spark, d, "documents"), "doc_id", "text", "licensed under license", 1000)
    return out.select(F.col("id").alias("doc_id"), r("score").alias("score"))


@query(
    "norm_hash",
    r"""SELECT doc_id, substr(sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '(?s)""\".*?""\"', ' ', 'g'),
    '(?s)''''''.*?''''''', ' ', 'g'), '(//|#)[^\n]*', ' ', 'g'), '\s+', ' ', 'g'))), 1, 16) AS content_hash FROM documents""".replace('""\\"', '"""'),
)
def norm_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(
    "ident_norm",
    r"""SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')) AS norm
    FROM (SELECT 'p:' || p_partkey AS id, replace(p_name, ' ', '') || 'HTTPServer_' || p_partkey AS name FROM part)""",
)
def ident_norm(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("HTTPServer_"), F.col("p_partkey").cast("string")).alias("name"))
    return p.select("id", T.normalize_ident(F.col("name")).alias("norm"))


@query(
    "redact_flags",
    r"""WITH x AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '[REDACTED]', 'g'),
      'gh[pousr]_[A-Za-z0-9]{20,}', '[REDACTED]', 'g'), 'sk-[A-Za-z0-9_\-]{20,}', '[REDACTED]', 'g'), 'xox[abprs]-[A-Za-z0-9\-]{10,}', '[REDACTED]', 'g'),
      '-----BEGIN [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g'), '(?i)(?:token|secret|password|api_key)\s*[=:]\s*"[^"]{16,}"', '[REDACTED]', 'g') AS red FROM documents)
    SELECT doc_id, sha256(red) AS redacted_hash, CASE WHEN red <> text THEN 'secret_redacted' ELSE '' END AS flags FROM x""",
)
def redact_flags(spark, d):
    flags = T.taint_flags(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted_hash"), F.array_join(flags, ",").alias("flags"))


@query(
    "attr_extract",
    f"WITH {S.values(S.SNIPPETS, 'snip', ('sid', 'body'))}, "
    + r"""
    a AS (
      SELECT sid, 'db_table' AS key, v AS value FROM (SELECT sid, unnest(regexp_extract_all(body, '(?i)(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+(\w+)', 1)) AS v FROM snip)
        WHERE upper(v) NOT IN ('SET', 'WHERE', 'VALUES', 'SELECT', 'AND', 'OR', 'ON', 'AS', 'IN', 'BY', 'NULL')
      UNION ALL SELECT sid, 'http_route', v FROM (SELECT sid, unnest(list_concat(regexp_extract_all(body, '(?i)(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\(\s*[''"/]([^''"\)\s]+)', 1),
        regexp_extract_all(body, '(?i)\.(get|post|put|patch|delete|head|options|route)\s*\(\s*[''"/]([^''"\)\s]+)', 2))) AS v FROM snip) WHERE v LIKE '/%'
      UNION ALL SELECT sid, 'env_var', unnest(list_concat(regexp_extract_all(body, 'os\.environ\[[''"](\w+)[''"]\]', 1), list_concat(regexp_extract_all(body, 'os\.getenv\(\s*[''"](\w+)[''"]\s*(?:,|\))', 1),
        list_concat(regexp_extract_all(body, 'process\.env\.([A-Za-z_][A-Za-z0-9_]*)', 1), list_concat(regexp_extract_all(body, 'process\.env\[[''"]([A-Za-z_][A-Za-z0-9_]*)[''"]\]', 1),
        regexp_extract_all(body, 'os\.Getenv\(\s*["'']([A-Za-z_][A-Za-z0-9_]*)["'']\s*\)', 1)))))) FROM snip
      UNION ALL SELECT sid, 'external_call', 'requests.' || lower(v) FROM (SELECT sid, unnest(regexp_extract_all(body, '(?i)(?:^|[^\w])requests\.(get|post|put|delete|head|patch|request)\s*\(', 1)) AS v FROM snip)
      UNION ALL SELECT sid, 'external_call', 'axios.' || lower(v) FROM (SELECT sid, unnest(regexp_extract_all(body, '(?i)(?:^|[^\w])axios\.(get|post|put|delete|patch|create|request)\s*[\(\.]', 1)) AS v FROM snip)
      UNION ALL SELECT sid, 'external_call', unnest(regexp_extract_all(body, '(?:^|[^\w])(fetch)\s*\(', 1)) FROM snip
      UNION ALL SELECT sid, 'external_call', unnest(regexp_extract_all(body, '(?:^|[^\w])(http\.Get)\s*\(', 1)) FROM snip)
    SELECT DISTINCT sid, key, value FROM a""",
)
def attr_extract(spark, d):
    snip = spark.createDataFrame(S.SNIPPETS, "sid int, body string")
    return snip.select("sid", F.explode(T.attributes(F.col("body"))).alias("a")).select("sid", "a.key", "a.value")


@query(
    "html_routes",
    r"""SELECT DISTINCT page_id, v AS route FROM (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '=\s*"(/[^"]*)"', 1), regexp_extract_all(html, '=\s*''(/[^'']*)''', 1))) AS v FROM pages)""",
)
def html_routes(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.html_routes(F.col("html"))).alias("route"))


@query("fts_quote", """SELECT item_id, '"' || replace(text, '"', '""') || '"' AS literal FROM benchmark""")
def fts_quote(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.fts_literal(F.col("text")).alias("literal"))


@query(
    "md_sections",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    h AS (SELECT *, CAST(regexp_matches(line, '^ {0,3}[A-Z][a-zA-Z ]{0,12}\.$') AS INT) AS head FROM l),
    s AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
    SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(min(n) AS BIGINT) AS first_line, CAST(max(n) AS BIGINT) AS last_line FROM s GROUP BY ALL""",
)
def md_sections(spark, d):
    """Sections by a running count of heading lines (short capitalised lines stand in for ATX headings here)."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    head = lines.withColumn("head", F.col("line").rlike(r"^ {0,3}[A-Z][a-zA-Z ]{0,12}\.$").cast("int")).withColumn("n", F.col("p") + 1)
    run = F.sum("head").over(Window.partitionBy("doc_id").orderBy("n"))
    return head.withColumn("section", run).groupBy("doc_id", "section").agg(F.min("n").cast("long").alias("first_line"), F.max("n").cast("long").alias("last_line"))


@query(
    "task_mode",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'bug|fix|error|fail|crash|broken') THEN 'bugfix' WHEN regexp_matches(lower(text), 'refactor|rename|clean up|restructure') THEN 'refactor'
    WHEN regexp_matches(lower(text), 'test|coverage|assert') THEN 'test' WHEN regexp_matches(lower(text), 'add|implement|feature|build|create') THEN 'feature'
    WHEN regexp_matches(lower(text), 'how|why|explain|understand|what') THEN 'explain' ELSE 'chore' END AS mode FROM conversations""",
)
def task_mode(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.task_mode(F.col("text")).alias("mode"))


@query(
    "token_budget",
    """WITH c AS (SELECT conv_id, turn, greatest(1, octet_length(encode(text)) // 4) AS cost FROM conversations), u AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM c)
    SELECT conv_id, turn, CAST(cost AS BIGINT) AS cost, CAST(used AS BIGINT) AS used FROM u WHERE used <= 200""",
)
def token_budget(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("cost"))
    return fusion.budget_running(c, "cost", 200, "conv_id", ["turn"])


@query("budget_skip")
def budget_skip(spark, d):
    top = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", T.estimate_tokens(F.col("text")).alias("cost"), F.xxhash64("doc_id").alias("o"))
    return fusion.budget_skip(top, "doc_id", "cost", 4000, "source", "o")


@query("interleave", "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS rn FROM documents")
def interleave(spark, d):
    out = fusion.interleave(table(spark, d, "documents"), "source", [F.desc("n_chars"), "doc_id"])
    return out.select("doc_id", "source", F.col("rn").cast("long").alias("rn"))


@query("diverse_order", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) > 1 AS later FROM documents")
def diverse_order(spark, d):
    return fusion.diverse(table(spark, d, "documents"), "source", [F.desc("n_chars"), "doc_id"]).select("doc_id", "source", "later")


# ---- vectors and fusion

_KNN = """(SELECT vec_id, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS distance
  FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {v}) ORDER BY distance, vec_id LIMIT {k})"""


def _query_vector(spark, d, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def _knn(spark, d, vec_id: int, k: int) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d, vec_id)])
    near = v.select("vec_id", r(semantic.cosine_distance(F.col("embedding"), q)).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(k)


@query("sem_knn", f"SELECT vec_id, distance FROM {_KNN.format(v=0, k=10)}")
def sem_knn(spark, d):
    out = semantic.knn(table(spark, d, "embeddings"), _query_vector(spark, d, 0), 10, "vec_id", "embedding")
    return out.select(F.col("id").alias("vec_id"), r("distance").alias("distance"))


@query("sem_guard", f"SELECT vec_id, distance FROM {_KNN.format(v=1, k=5)} WHERE 'fp-a' = 'fp-a' UNION ALL SELECT vec_id, distance FROM {_KNN.format(v=1, k=5)} WHERE 'fp-a' = 'fp-b'")
def sem_guard(spark, d):
    near = _knn(spark, d, 1, 5)
    return near.where(F.lit(semantic.guard("fp-a", "fp-a"))).unionByName(near.where(F.lit(semantic.guard("fp-a", "fp-b"))))


def _layers(spark, d, k: int = 25) -> DataFrame:
    parts = [_knn(spark, d, v, k).select(F.col("vec_id").cast("string").alias("symbol_id"), (1.0 - F.col("distance")).alias("score"), F.lit(f"layer{v}").alias("layer")) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


_LAYERS = f"""hits AS (SELECT CAST(vec_id AS VARCHAR) AS symbol_id, 1.0 - distance AS score, 'layer0' AS layer FROM {_KNN.format(v=0, k=25)}
  UNION ALL SELECT CAST(vec_id AS VARCHAR), 1.0 - distance, 'layer1' FROM {_KNN.format(v=1, k=25)}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, symbol_id) AS rk FROM hits),
  fused AS (SELECT symbol_id, sum(1.0 / (60 + rk)) AS score FROM ranked GROUP BY symbol_id)"""


@query("rrf_fuse", f"WITH {_LAYERS} SELECT symbol_id, round(score, 9) AS score FROM fused ORDER BY round(score, 9) DESC, symbol_id LIMIT 10")
def rrf_fuse(spark, d):
    return fusion.rrf_fuse(_layers(spark, d), 10, layer_order=["layer0", "layer1"]).select("symbol_id", r("score", 9).alias("score"))


_COMPOSE = f"""WITH {_LAYERS}, p AS (SELECT symbol_id, 0 AS segment, row_number() OVER (ORDER BY round(score, 9) DESC, symbol_id) AS pos FROM fused QUALIFY pos <= 6),
  g AS (SELECT CAST(vec_id AS VARCHAR) AS symbol_id, 1 AS segment, row_number() OVER (ORDER BY distance, vec_id) AS pos FROM {_KNN.format(v=2, k=8)}),
  e AS (SELECT CAST(vec_id AS VARCHAR) AS symbol_id, 2 AS segment, row_number() OVER (ORDER BY distance, vec_id) AS pos FROM {_KNN.format(v=3, k=8)}),
  a AS (SELECT symbol_id, min(struct_pack(segment := segment, pos := pos)) AS s FROM ({{u}}) GROUP BY symbol_id)
  SELECT symbol_id, CAST(s.segment AS INT) AS segment, CAST(row_number() OVER (ORDER BY s.segment, s.pos, symbol_id) AS INT) AS position FROM a QUALIFY position <= {{k}}"""


def _compose(spark, d, k: int, edges: bool) -> DataFrame:
    fused = fusion.rrf_fuse(_layers(spark, d), 6, layer_order=["layer0", "layer1"])
    prefix = graph.row_positions(fused.select("symbol_id", r("score", 9).alias("score")), [F.desc("score"), "symbol_id"])
    lists = [graph.row_positions(_knn(spark, d, v, 8), ["distance", "vec_id"]).select(F.col("vec_id").cast("string").alias("symbol_id"), "pos") for v in (2, 3)]
    return fusion.compose(prefix.select("symbol_id", "pos"), lists[0], k, lists[1] if edges else None)


@query("capsule_compose", _COMPOSE.format(u="SELECT * FROM p UNION ALL SELECT * FROM g", k=10))
def capsule_compose(spark, d):
    return _compose(spark, d, 10, False)


@query("capsule_edges", _COMPOSE.format(u="SELECT * FROM p UNION ALL SELECT * FROM g UNION ALL SELECT * FROM e", k=20))
def capsule_edges(spark, d):
    return _compose(spark, d, 20, True)


@query(
    "seed_distribution",
    f"""WITH {_LAYERS}, m AS (SELECT *, min(score) OVER (PARTITION BY layer) AS lo, max(score) OVER (PARTITION BY layer) AS hi FROM hits),
    s AS (SELECT symbol_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS v FROM m), w AS (SELECT symbol_id, sum(CASE WHEN v <= 0 THEN 1e-3 ELSE v END) AS w FROM s
    WHERE CAST(symbol_id AS INT) % 2 = 0 GROUP BY symbol_id) SELECT symbol_id, round(w / (SELECT sum(w) FROM w), 6) AS mass FROM w""",
)
def seed_distribution(spark, d):
    nodes = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("id"))  # the graph's nodes
    return fusion.seed_distribution(_layers(spark, d), nodes).select("symbol_id", r("mass").alias("mass"))


@query(
    "seed_distribution_full",
    f"""WITH {_LAYERS}, m AS (SELECT *, min(score) OVER (PARTITION BY layer) AS lo, max(score) OVER (PARTITION BY layer) AS hi FROM hits),
    s AS (SELECT symbol_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS v FROM m), w AS (SELECT symbol_id, sum(CASE WHEN v <= 0 THEN 1e-3 ELSE v END) AS w FROM s
    GROUP BY symbol_id) SELECT symbol_id, round(w / (SELECT sum(w) FROM w), 6) AS mass FROM w""",
)
def seed_distribution_full(spark, d):
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"))
    return fusion.seed_distribution(_layers(spark, d), nodes).select("symbol_id", r("mass").alias("mass"))


# ---- lookups

_SYM = S.values(S.SYMBOLS, "symbol", S.SYMBOL_COLUMNS)


@query("symbol_lookup", f"WITH {_SYM} SELECT 'LOGIN' AS needle, id FROM symbol WHERE lower(name) = 'login' UNION ALL SELECT 'Circ', id FROM symbol WHERE name = 'Circle' UNION ALL SELECT 's07', 's07'")
def symbol_lookup(spark, d):
    sym = S.symbols(spark).withColumn("qualified_name", F.concat_ws(":", "language", "file_path", "name"))
    rows = [lookup.resolve_symbol(sym, n).select(F.lit(n).alias("needle"), "id") for n in ("LOGIN", "Circ", "s07")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "symbol_marks",
    f"""WITH {_SYM} SELECT id, (lower(name) LIKE 'test\\_%' ESCAPE '\\' OR lower(file_path) LIKE '%tests.cs') AS is_test,
    (kind = 'route' OR name = 'main' OR name LIKE '%Handler' OR name LIKE 'handle\\_%' ESCAPE '\\' OR contains(file_path, 'routes') OR contains(file_path, 'controllers') OR contains(file_path, 'api/')) AS is_entry FROM symbol""",
)
def symbol_marks(spark, d):
    s = S.symbols(spark)
    return s.select("id", lookup.is_test(F.col("name"), F.col("file_path")).alias("is_test"), lookup.is_entrypoint(F.col("kind"), F.col("name"), F.col("file_path")).alias("is_entry"))


@query("edges_incident", f"WITH e AS ({SMALL_SQL}) SELECT DISTINCT src_id, dst_id, kind, confidence FROM e WHERE src_id IN ('n:3', 'n:4') OR dst_id IN ('n:3', 'n:4')")
def edges_incident(spark, d):
    ids = spark.createDataFrame([("n:3",), ("n:4",)], "id string")
    return lookup.edges_incident(small_edges(spark, d), ids)


@query("label_resolve", f"WITH {_SYM} SELECT name, 'app/' AS path_part, id AS symbol_id FROM symbol WHERE name IN ('login', 'audit') AND contains(lower(replace(file_path, '\\', '/')), 'app/')")
def label_resolve(spark, d):
    labels = spark.createDataFrame([("login", "app/"), ("audit", "app/"), ("run", "nowhere/")], "name string, path_part string")
    return lookup.resolve_labels(S.symbols(spark), labels)


# ---- resolution

_LITS = r"""list_transform(regexp_extract_all(coalesce(signature, '') || ' ' || coalesce(body_excerpt, ''), '"[^"\\]*"|''[^''\\]*''|`[^`\\]*`'), lambda x: substr(x, 2, length(x) - 2))"""
_STOP = "'if', 'for', 'while', 'return', 'new', 'self', 'with', 'match', 'lock', 'using', 'when', 'do', 'case', 'else'"
_CALLS = f"""sites AS (SELECT DISTINCT id AS src_id, file_path AS f, language AS l, unnest(regexp_extract_all(coalesce(body_excerpt, signature, ''), '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS name
    FROM symbol WHERE kind IN ('function', 'method', 'route')),
  cand AS (SELECT s.src_id, t.id AS dst_id, s.name, s.f = t.file_path AS same FROM sites s JOIN symbol t ON s.name = t.name AND s.l = t.language
    AND t.kind IN ('function', 'method', 'route', 'class') WHERE s.src_id <> t.id AND s.name NOT IN ({_STOP})),
  calls AS (SELECT src_id, dst_id, 'calls' AS kind, max(CASE WHEN same THEN 1.0 ELSE 0.6 END) AS confidence FROM (SELECT *, count(*) FILTER (NOT same) OVER (PARTITION BY src_id, name) AS n FROM cand)
    WHERE same OR n <= 8 GROUP BY src_id, dst_id)"""
_OOP = r"""heads AS (SELECT id, language, regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(body_excerpt, signature, ''), '(?s)^([^{]*)', 1), '<[^<>()]*>|\([^<>()]*\)', ' ', 'g'),
    '<[^<>()]*>|\([^<>()]*\)', ' ', 'g'), '<[^<>()]*>|\([^<>()]*\)', ' ', 'g') AS h FROM symbol WHERE kind IN ('class', 'interface') AND language IN ('java', 'csharp')),
  listed AS (SELECT id, 'extends' AS word, unnest(string_split(regexp_extract(h, '(?s)\bextends\b(.*?)(?:\bimplements\b|$)', 1), ',')) AS part FROM heads WHERE language = 'java'
    UNION ALL SELECT id, 'implements', unnest(string_split(regexp_extract(h, '(?s)\bimplements\b(.*)$', 1), ',')) FROM heads WHERE language = 'java'
    UNION ALL SELECT id, 'colon', unnest(string_split(regexp_replace(regexp_extract(h, '(?s):(.*)$', 1), '(?s)\bwhere\b.*$', ''), ',')) FROM heads WHERE language = 'csharp'),
  named AS (SELECT DISTINCT id AS src_id, word, regexp_extract_all(part, '[A-Za-z_][A-Za-z0-9_]*')[-1] AS base FROM listed),
  pairs AS (SELECT src_id, word, t.id AS dst_id, t.kind AS dk, count(*) OVER (PARTITION BY src_id, base, word) AS n FROM named JOIN symbol t ON t.name = base AND t.kind IN ('class', 'interface') WHERE src_id <> t.id),
  oop AS (SELECT src_id, dst_id, CASE WHEN word = 'extends' THEN 'inherits' WHEN word = 'implements' OR dk = 'interface' THEN 'implements' ELSE 'inherits' END AS kind,
    max(CASE WHEN n = 1 THEN 0.9 ELSE 0.5 END) AS confidence FROM pairs GROUP BY ALL)"""
_ROUTES = f"""routes AS (SELECT DISTINCT q.id AS src_id, h.id AS dst_id, 'routes_to' AS kind, 1.0 AS confidence FROM symbol q JOIN (SELECT id, unnest({_LITS}) AS lit FROM symbol
    WHERE language NOT IN ('yaml', 'toml', 'sql', 'html', 'markdown')) h ON h.lit = q.name WHERE q.kind = 'route' AND h.lit LIKE '/%')"""
_CONFIG = f"""keys AS (SELECT id AS dst_id, unnest([full_, string_split(full_, '.')[-1]]) AS lit FROM (SELECT id, array_to_string(list_filter(list_transform(string_split(name, '.'),
    lambda s: regexp_replace(s, '\\[.*$', '')), lambda s: s <> ''), '.') AS full_ FROM symbol WHERE kind IN ('var', 'const') AND language IN ('yaml', 'toml'))),
  readers AS (SELECT DISTINCT id AS src_id, unnest({_LITS}) AS lit FROM symbol WHERE language NOT IN ('yaml', 'toml', 'sql', 'html', 'markdown')),
  config AS (SELECT src_id, dst_id, 'reads' AS kind, 0.7 AS confidence FROM (SELECT *, count(*) OVER (PARTITION BY dst_id) AS n FROM (SELECT DISTINCT src_id, dst_id FROM keys JOIN readers USING (lit))) WHERE n <= 8)"""
_NORM = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'))"
_SQLE = f"""words AS (SELECT id AS src_id, name, regexp_extract_all(coalesce(signature, '') || ' ' || coalesce(body_excerpt, ''), '[A-Za-z_][A-Za-z0-9_]*') AS ws FROM symbol
    WHERE language NOT IN ('yaml', 'toml', 'sql', 'html', 'markdown')),
  verbs AS (SELECT src_id, ws, name, CASE WHEN len(list_filter(ws, lambda w: upper(w) IN ('INSERT', 'UPDATE', 'DELETE', 'UPSERT', 'MERGE', 'REPLACE'))) > 0 THEN 'writes'
    WHEN len(list_filter(ws, lambda w: upper(w) = 'SELECT')) > 0 THEN 'reads' END AS kind FROM words),
  toks AS (SELECT DISTINCT src_id, kind, {_NORM.format(x="w")} AS norm FROM (SELECT src_id, kind, unnest(list_append(ws, name)) AS w FROM verbs WHERE kind IS NOT NULL)),
  sqle AS (SELECT DISTINCT src_id, t.id AS dst_id, toks.kind AS kind, 0.65 AS confidence FROM toks JOIN symbol t ON t.language = 'sql' AND t.kind IN ('class', 'var') AND {_NORM.format(x="t.name")} = norm)"""


def _resolver(name: str, sql: str, cte: str, f) -> None:
    ORACLES[name] = f"WITH {_SYM}, {sql} SELECT src_id, dst_id, kind, CAST(confidence AS DOUBLE) AS confidence FROM {cte}"
    QUERIES[name] = lambda spark, d: f(S.symbols(spark)).select(*resolve.RESOLVED)


_resolver("call_resolve", _CALLS, "calls", resolve.resolve_calls)
_resolver("oop_resolve", _OOP, "oop", resolve.resolve_oop)
_resolver("routes_to", _ROUTES, "routes", resolve.resolve_routes)
_resolver("config_reads", _CONFIG, "config", resolve.resolve_config)
_resolver("sql_edges", _SQLE, "sqle", resolve.resolve_sql)
_ALL = ", ".join((_CALLS, _OOP, _ROUTES, _CONFIG, _SQLE))
_UNION = " UNION ALL ".join(f"SELECT src_id, dst_id, kind, confidence FROM {c}" for c in ("calls", "oop", "routes", "config", "sqle"))
_resolver("merge_edges", f"{_ALL}, merged AS (SELECT src_id, dst_id, kind, max(confidence) AS confidence FROM ({_UNION}) GROUP BY ALL)", "merged", resolve.resolve_edges)


# ---- graphs

_SYMM = """a AS (SELECT u, v, sum(w) AS w FROM (SELECT src_id AS u, dst_id AS v, confidence AS w FROM e UNION ALL SELECT dst_id, src_id, confidence FROM e) WHERE u <> v GROUP BY u, v)"""


@query("graph_build", f"WITH e AS ({FULL_SQL}), {_SYMM} SELECT u, v, round(w, 6) AS w FROM a")
def graph_build(spark, d):
    e = graph.cut(full_edges(spark, d))  # read three times below
    return graph.symmetric(e, nodes_of(e)).select("u", "v", r("w").alias("w"))


@query("degree", f"WITH e AS ({FULL_SQL}), {_SYMM} SELECT u AS id, round(sum(w), 6) AS degree FROM a GROUP BY u")
def degree(spark, d):
    e = graph.cut(full_edges(spark, d))
    return graph.degrees(graph.symmetric(e, nodes_of(e))).select("id", r("degree").alias("degree"))


@query("hubs", f"WITH e AS ({SMALL_SQL}), {_SYMM}, g AS (SELECT u AS id, sum(w) AS degree FROM a GROUP BY u) SELECT id, round(degree, 6) AS degree FROM g ORDER BY degree DESC, id LIMIT (SELECT greatest(1, count(*) // 10) FROM g)")
def hubs(spark, d):
    e = small_edges(spark, d)
    n = nodes_of(e)
    return graph.hubs(graph.symmetric(e, n), n.count()).select("id", r("degree").alias("degree"))


@query("hubs_full", f"WITH e AS ({FULL_SQL}), {_SYMM}, g AS (SELECT u AS id, sum(w) AS degree FROM a GROUP BY u) SELECT id, round(degree, 6) AS degree FROM g ORDER BY degree DESC, id LIMIT (SELECT greatest(1, count(*) // 10) FROM g)")
def hubs_full(spark, d):
    """Hubs of the graph of ``degree``."""
    e = graph.cut(full_edges(spark, d))
    n = graph.cut(nodes_of(e))
    return graph.hubs(graph.symmetric(e, n), n.count()).select("id", r("degree").alias("degree"))


@query(
    "projection_weights",
    f"""WITH e AS ({SMALL_SQL}), g AS (SELECT *, CASE kind WHEN 'calls' THEN 0.95 WHEN 'inherits' THEN 0.9 WHEN 'imports' THEN 0.45 END AS gs, CASE kind WHEN 'calls' THEN 1.0 WHEN 'inherits' THEN 0.5 WHEN 'imports' THEN 0.05 END AS gc FROM e),
    n AS (SELECT src_id AS id FROM e UNION SELECT dst_id FROM e),
    v AS (SELECT 'forward' AS view, src_id AS u, dst_id AS v, sum(confidence) AS w FROM g GROUP BY ALL UNION ALL SELECT 'reverse_structural', dst_id, src_id, sum(confidence * gs) FROM g GROUP BY ALL
      UNION ALL SELECT 'reverse_complexity', dst_id, src_id, sum(confidence * gc) FROM g GROUP BY ALL),
    l AS (SELECT * FROM v UNION ALL SELECT view, id, id, 1.0 FROM (SELECT DISTINCT view FROM v), n WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.view = view AND x.u = id AND view = x.view))
    SELECT view, u, v, round(w, 6) AS w FROM v UNION ALL SELECT k.view, n.id, n.id, 1.0 FROM (SELECT DISTINCT view FROM v) k CROSS JOIN n LEFT JOIN (SELECT DISTINCT view, u FROM v) o ON o.view = k.view AND o.u = n.id WHERE o.u IS NULL""",
)
def projection_weights(spark, d):
    e = small_edges(spark, d)
    views = graph.projections(e, nodes_of(e))
    rows = [views[k].select(F.lit(k).alias("view"), "u", "v", r("w").alias("w")) for k in ("forward", "reverse_structural", "reverse_complexity")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "projection_weights_full",
    f"""WITH e AS ({FULL_SQL}), g AS (SELECT *, CASE kind WHEN 'calls' THEN 0.95 WHEN 'inherits' THEN 0.9 WHEN 'imports' THEN 0.45 ELSE 0.8 END AS gs,
      CASE kind WHEN 'calls' THEN 1.0 WHEN 'inherits' THEN 0.5 WHEN 'imports' THEN 0.05 ELSE 0.6 END AS gc FROM e), n AS (SELECT src_id AS id FROM e UNION SELECT dst_id FROM e),
    v AS (SELECT 'forward' AS view, src_id AS u, dst_id AS v, sum(confidence) AS w FROM g GROUP BY ALL UNION ALL SELECT 'reverse_structural', dst_id, src_id, sum(confidence * gs) FROM g GROUP BY ALL
      UNION ALL SELECT 'reverse_complexity', dst_id, src_id, sum(confidence * gc) FROM g GROUP BY ALL)
    SELECT view, u, v, round(w, 6) AS w FROM v UNION ALL SELECT k.view, n.id, n.id, 1.0 FROM (SELECT DISTINCT view FROM v) k CROSS JOIN n LEFT JOIN (SELECT DISTINCT view, u FROM v) o ON o.view = k.view AND o.u = n.id WHERE o.u IS NULL""",
)
def projection_weights_full(spark, d):
    e = graph.cut(full_edges(spark, d))
    views = graph.projections(e, nodes_of(e))
    rows = [views[k].select(F.lit(k).alias("view"), "u", "v", r("w").alias("w")) for k in ("forward", "reverse_structural", "reverse_complexity")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _trace_sql(arcs: str, depth: int, edges: str = SMALL_SQL) -> str:
    levels = ["l0 AS (SELECT 'n:3' AS id, 0 AS hop)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        levels.append(f"l{k} AS (SELECT DISTINCT b AS id, {k} AS hop FROM arcs JOIN l{k - 1} ON a = id WHERE b NOT IN ({seen}))")
    rows = " UNION ALL ".join(f"SELECT id AS symbol_id, CAST(hop AS INT) AS hop, round(1.0 / hop, 6) AS score FROM l{k}" for k in range(1, depth + 1))
    return f"WITH e AS ({edges}), arcs AS ({arcs}), {', '.join(levels)} {rows}"


for _dir, _arcs in {"out": "SELECT src_id AS a, dst_id AS b FROM e", "in": "SELECT dst_id AS a, src_id AS b FROM e", "both": "SELECT src_id AS a, dst_id AS b FROM e UNION ALL SELECT dst_id, src_id FROM e"}.items():
    ORACLES[f"trace_{_dir}"] = _trace_sql(_arcs, 3)
    ORACLES[f"trace_{_dir}_full"] = _trace_sql(_arcs, 3, FULL_SQL)
    QUERIES[f"trace_{_dir}_full"] = lambda spark, d, w=_dir: graph.trace(graph.cut(full_edges(spark, d)), "n:3", w, 3).select("symbol_id", F.col("hop").cast("int").alias("hop"), r("score").alias("score"))
    QUERIES[f"trace_{_dir}"] = lambda spark, d, w=_dir: graph.trace(small_edges(spark, d), "n:3", w, 3).select("symbol_id", F.col("hop").cast("int").alias("hop"), r("score").alias("score"))


def _ppr_sql(rounds: int) -> str:
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS (SELECT n.id, 0.15 * n.s + 0.85 * coalesce(f, 0) AS mass FROM n LEFT JOIN (SELECT v, sum(p * mass) AS f FROM p JOIN r{k - 1} ON u = id GROUP BY v) x ON x.v = n.id)")
    return f"""WITH e AS ({TREE_SQL}), {_SYMM}, g AS (SELECT u, sum(w) AS g FROM a GROUP BY u), p AS (SELECT a.u, v, w / g AS p FROM a JOIN g ON a.u = g.u),
      n AS (SELECT u AS id, CASE WHEN u = 'r:0' THEN 1.0 ELSE 0.0 END AS s FROM g), r0 AS (SELECT id, s AS mass FROM n), {', '.join(steps)} SELECT id, round(mass, 9) AS mass FROM r{rounds}"""


@query("ppr_power", _ppr_sql(5))
def ppr_power(spark, d):
    e = tree_edges(spark, d)
    seeds = spark.createDataFrame([("r:0", 1.0)], "id string, mass double")
    return graph.ppr_power(graph.symmetric(e, nodes_of(e)), seeds, 5).select("id", r("mass", 9).alias("mass"))


@query("ppr_push")
def ppr_push(spark, d):
    e = tree_edges(spark, d)
    seeds = spark.createDataFrame([("r:0", 1.0)], "id string, mass double")
    return graph.ppr_push_rounds(graph.symmetric(e, nodes_of(e)), seeds, epsilon=1e-4)


@query("diffuse")
def diffuse(spark, d):
    e = tree_edges(spark, d)
    seeds = spark.createDataFrame([("r:0", 0.5), ("s:1", 0.5)], "id string, mass double")
    return graph.diffuse(graph.symmetric(e, nodes_of(e)), seeds, 10, epsilon=1e-4)


@query("ppr_push_grouped")
def ppr_push_grouped(spark, d):
    e = tree_edges(spark, d)
    arcs = graph.symmetric(e, nodes_of(e)).withColumn("repo", F.lit("one"))
    seeds = spark.createDataFrame([("one", "r:0", 1.0)], "repo string, id string, mass double")
    return graph.push_grouped(arcs, seeds, "repo", epsilon=1e-4)


@query("analysis_subgraph")
def analysis_subgraph(spark, d):
    return graph.analysis_subgraph(small_edges(spark, d), spark.createDataFrame([("n:3",)], "id string"))


@query(
    "coverage_stats",
    f"""WITH e AS ({FULL_SQL}), n AS (SELECT src_id AS id FROM e UNION SELECT dst_id FROM e) SELECT (SELECT count(*) FROM n) AS n_nodes, count(*) AS n_edges, count(*) AS n_resolved, CAST(1.0 AS DOUBLE) AS resolution_rate,
    CAST(1.0 AS DOUBLE) AS connectivity, count(*) / (SELECT count(*) FROM n) AS avg_out_degree FROM e""",
)
def coverage_stats(spark, d):
    e = graph.cut(full_edges(spark, d))
    return E.coverage_stats(nodes_of(e), e)


@query("edges_by_kind", f"WITH e AS ({FULL_SQL}) SELECT kind, count(*) AS n FROM e GROUP BY kind")
def edges_by_kind(spark, d):
    return full_edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "edge_prf",
    """WITH f AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS t FROM lineitem WHERE l_quantity > 10), g AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS t FROM lineitem WHERE l_discount < 0.06),
    c AS (SELECT (SELECT count(*) FROM f JOIN g USING (s, t)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM g) AS ng)
    SELECT tp, round(tp / nf, 9) AS precision, round(tp / ng, 9) AS recall, round(2.0 * (tp / nf) * (tp / ng) / (tp / nf + tp / ng), 9) AS f1 FROM c""",
)
def edge_prf(spark, d):
    li = table(spark, d, "lineitem")
    pair = [F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id")]
    m = E.edge_set_metrics(li.where("l_quantity > 10").select(*pair), li.where("l_discount < 0.06").select(*pair))
    return m.select("tp", *[r(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "reach_recall",
    f"""WITH e AS ({SMALL_SQL}), g AS (SELECT 'c:' || c_custkey AS s, 'r:' || (c_custkey % 5) AS t FROM customer),
    p AS (SELECT DISTINCT a.src_id AS s, b.dst_id AS t FROM e a JOIN e b ON a.dst_id = b.src_id UNION SELECT src_id, dst_id FROM e)
    SELECT count(*) AS n, count(p.s) AS reached, round(count(p.s) / count(*), 9) AS recall FROM g LEFT JOIN p ON p.s = g.s AND p.t = g.t""",
)
def reach_recall(spark, d):
    golden = table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("src_id"), F.concat(F.lit("r:"), (F.col("c_custkey") % 5).cast("string")).alias("dst_id"))
    return E.reach_recall(small_edges(spark, d), golden, 2).select("n", "reached", r("recall", 9).alias("recall"))


@query(
    "golden_edges",
    f"""WITH {_SYM}, {_CALLS}, g AS (SELECT * FROM (VALUES ('login', 'app/', 'verify', 'app/'), ('login', 'app/', 'audit', 'app/'), ('boot', 'jobs/', 'start', 'jobs/')) g(sn, sp, tn, tp)),
    p AS (SELECT DISTINCT a.id AS s, b.id AS t FROM g JOIN symbol a ON a.name = sn AND contains(a.file_path, sp) JOIN symbol b ON b.name = tn AND contains(b.file_path, tp)),
    f AS (SELECT DISTINCT src_id AS s, dst_id AS t FROM calls WHERE src_id IN (SELECT s FROM p)), c AS (SELECT (SELECT count(*) FROM f JOIN p USING (s, t)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM p) AS ng)
    SELECT tp, round(tp / nf, 9) AS precision, round(tp / ng, 9) AS recall FROM c""",
)
def golden_edges(spark, d):
    sym = S.symbols(spark)
    doc = {"complete": True, "edges": [{"src": ["login", "app/"], "dst": ["verify", "app/"]}, {"src": ["login", "app/"], "dst": ["audit", "app/"]}, {"src": ["boot", "jobs/"], "dst": ["start", "jobs/"]}, {"src": 1}]}
    complete, rows = E.golden_edges(doc)
    golden = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "gid int, src_name string, src_path string, dst_name string, dst_path string")
    return E.evaluate_golden(sym, resolve.resolve_calls(sym), golden, complete).select("tp", r("precision", 9).alias("precision"), r("recall", 9).alias("recall"))


@query("parity_l1", f"WITH x AS ({_ppr_sql(2)}), y AS ({_ppr_sql(3)}) SELECT round(sum(abs(x.mass - y.mass)), 6) AS l1 FROM x JOIN y USING (id)")
def parity_l1(spark, d):
    e = tree_edges(spark, d)
    seeds = spark.createDataFrame([("r:0", 1.0)], "id string, mass double")
    arcs = graph.symmetric(e, nodes_of(e))
    return E.parity_l1(graph.ppr_power(arcs, seeds, 2), graph.ppr_power(arcs, seeds, 3)).select(r("l1").alias("l1"))


# ---- algebra and impact

_CLS = S.values([(k, *c) for k, c in enumerate(S.CLASSES)], "cls", ("cid", "kind", "degree", "log_power", "power", "base"))
_DEG = "CASE {t}.kind WHEN 'logarithmic' THEN 0.25 * {t}.power WHEN 'sqrt' THEN 0.5 WHEN 'polynomial' THEN {t}.degree + 0.25 * {t}.log_power WHEN 'exponential' THEN 8 + 0.1 * greatest({t}.base, 2) WHEN 'factorial' THEN 10 ELSE 0 END"
_RISK = """CASE WHEN {t}.kind = 'constant' THEN 0.05 WHEN {t}.kind = 'logarithmic' THEN 0.15 WHEN {t}.kind = 'sqrt' THEN 0.2 WHEN {t}.kind IN ('exponential', 'factorial') THEN 1.0
  WHEN {t}.degree = 1 THEN CASE WHEN {t}.log_power = 0 THEN 0.3 ELSE 0.45 END WHEN {t}.degree = 2 THEN 0.75 WHEN {t}.degree = 3 THEN 0.9 ELSE 0.95 END"""
_NOTE = """CASE WHEN {t}.kind = 'constant' THEN 'O(1)' WHEN {t}.kind = 'sqrt' THEN 'O(sqrt(n))' WHEN {t}.kind = 'factorial' THEN 'O(n!)' WHEN {t}.kind = 'exponential' THEN 'O(' || greatest({t}.base, 2) || '^n)'
  WHEN {t}.kind = 'logarithmic' THEN CASE WHEN {t}.power = 1 THEN 'O(log n)' ELSE 'O((log n)^' || {t}.power || ')' END
  ELSE 'O(' || CASE WHEN {t}.degree = 1 THEN 'n' ELSE 'n^' || {t}.degree END || CASE WHEN {t}.log_power = 0 THEN '' WHEN {t}.log_power = 1 THEN ' log n' ELSE ' (log n)^' || {t}.log_power END || ')' END"""


@query("cpx_scalars", f"WITH {_CLS} SELECT cid, CAST({_DEG.format(t='cls')} AS DOUBLE) AS effective_degree, CAST({_RISK.format(t='cls')} AS DOUBLE) AS risk_weight, {_NOTE.format(t='cls')} AS notation FROM cls")
def cpx_scalars(spark, d):
    c = A.cls(F.col("kind"), F.col("degree"), F.col("log_power"), F.col("power"), F.col("base"))
    return S.classes(spark).select("cid", A.effective_degree(c).alias("effective_degree"), A.risk_weight(c).alias("risk_weight"), A.notation(c).alias("notation"))


_NEST = f"""n AS (SELECT a.cid AS a, b.cid AS b, CASE WHEN a.kind = 'constant' THEN b.kind WHEN b.kind = 'constant' THEN a.kind WHEN 'factorial' IN (a.kind, b.kind) THEN 'factorial'
    WHEN 'exponential' IN (a.kind, b.kind) THEN 'exponential' WHEN a.kind = 'logarithmic' AND b.kind = 'logarithmic' THEN 'logarithmic' ELSE 'polynomial' END AS kind,
  CASE WHEN a.kind = 'constant' THEN b.degree WHEN b.kind = 'constant' THEN a.degree ELSE a.degree + b.degree + CASE WHEN 'sqrt' IN (a.kind, b.kind) THEN 1 ELSE 0 END END AS degree,
  CASE WHEN a.kind = 'constant' THEN b.log_power WHEN b.kind = 'constant' THEN a.log_power ELSE a.log_power + b.log_power + a.power + b.power END AS log_power,
  CASE WHEN a.kind = 'constant' THEN b.power WHEN b.kind = 'constant' THEN a.power ELSE a.power + b.power END AS power,
  CASE WHEN a.kind = 'exponential' AND b.kind = 'exponential' THEN a.base * b.base ELSE greatest(a.base, b.base) END AS base,
  CASE WHEN {_DEG.format(t="a")} >= {_DEG.format(t="b")} THEN a.cid ELSE b.cid END AS top FROM cls a, cls b)"""


@query("cpx_ops", f"WITH {_CLS}, {_NEST} SELECT a, b, {_NOTE.format(t='n')} AS nested, top FROM n")
def cpx_ops(spark, d):
    def side(p: str) -> DataFrame:
        return S.classes(spark).select(F.col("cid").alias(p), A.cls(F.col("kind"), F.col("degree"), F.col("log_power"), F.col("power"), F.col("base")).alias(f"{p}_cls"))

    both = side("a").crossJoin(side("b"))  # every pair of a fixed dozen of classes
    top = F.when(A.effective_degree(F.col("a_cls")) >= A.effective_degree(F.col("b_cls")), F.col("a")).otherwise(F.col("b"))
    return both.select("a", "b", A.notation(A.nest_mul_col(F.col("a_cls"), F.col("b_cls"))).alias("nested"), top.alias("top"))


@query(
    "recursion_rule",
    """SELECT l_linenumber % 2 = 0 AS halving, l_linenumber % 3 = 0 AS memo, CAST(l_quantity % 4 AS INT) AS branches, CAST(l_linenumber % 2 AS INT) AS loops, count(*) AS n,
    any_value(CASE WHEN NOT (l_linenumber % 3 = 0) AND (CAST(l_quantity % 4 AS INT) >= 2 OR l_linenumber % 2 > 0) THEN CASE WHEN l_linenumber % 2 = 0 THEN 'O(n log n)' ELSE 'O(' || greatest(2, least(8, CAST(l_quantity % 4 AS INT))) || '^n)' END
    WHEN l_linenumber % 2 = 0 THEN 'O(n log n)' ELSE 'O(n^2)' END) AS rule FROM lineitem GROUP BY ALL""",
)
def recursion_rule(spark, d):
    li = table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 2 == 0).alias("halving"), (F.col("l_linenumber") % 3 == 0).alias("memo"), (F.col("l_quantity") % 4).cast("int").alias("branches"), (F.col("l_linenumber") % 2).cast("int").alias("loops")
    )
    rule = A.notation(A.recursion_rule(F.col("halving"), F.col("memo"), F.col("branches"), F.col("loops"), A.cls("polynomial", 1)))
    return li.groupBy("halving", "memo", "branches", "loops").agg(F.count("*").alias("n")).withColumn("rule", rule)


@query(
    "risk_score",
    f"""WITH {_CLS} SELECT cid, io, cog, rec, round(least(1.0, 0.45 * w + 0.3 * io + 0.15 * least(cog / 25.0, 1.0) + 0.1 * rec), 9) AS risk FROM (SELECT cid, {_RISK.format(t='cls')} AS w FROM cls),
    (VALUES (0), (1)) i(io), (VALUES (0), (5), (40)) c(cog), (VALUES (0), (1)) q(rec)""",
)
def risk_score(spark, d):
    c = A.cls(F.col("kind"), F.col("degree"), F.col("log_power"), F.col("power"), F.col("base"))
    grid = S.classes(spark).withColumn("io", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("cog", F.explode(F.array(F.lit(0), F.lit(5), F.lit(40)))).withColumn("rec", F.explode(F.array(F.lit(0), F.lit(1))))
    return grid.select("cid", "io", "cog", "rec", r(A.symbol_risk(A.risk_weight(c), F.col("io") == 1, F.col("cog").cast("double"), F.col("rec") == 1), 9).alias("risk"))


@query(
    "impact_scores",
    f"""WITH m AS ({_ppr_sql(4)}), k AS (SELECT CASE WHEN id LIKE 's:%' THEN 'tests' ELSE 'code' END AS g, mass, id FROM m WHERE mass >= 1e-4 AND id <> 'r:0'),
    a AS (SELECT sum(mass) FILTER (g = 'code') AS p, sum(mass) FILTER (g = 'tests') AS t, count(*) AS n, count(DISTINCT left(id, 1)) AS md FROM k),
    s AS (SELECT n, 1 - exp(-1.4 * p - 0.18 * ln(n + 1.0) - 0.15 * ln(md + 1.0)) AS blast, tanh(0.45 * 1.0 + 0.04 * 4.0 + 0.3 * p) AS amp, p / (p + 3 * t + 1e-6) AS gap FROM a)
    SELECT round(blast, 6) AS blast, round(amp, 6) AS amp, round(gap, 6) AS gap, round(0.3 * blast + 0.35 * amp + 0.25 * 0.3 + 0.1 * gap, 6) AS score,
    CASE WHEN 0.3 * blast + 0.35 * amp + 0.25 * 0.3 + 0.1 * gap >= 0.7 OR amp >= 0.75 THEN 'critical' WHEN 0.3 * blast + 0.35 * amp + 0.25 * 0.3 + 0.1 * gap >= 0.45 OR amp >= 0.5 THEN 'high' ELSE 'medium' END AS level FROM s""",
)
def impact_scores(spark, d):
    e = tree_edges(spark, d)
    mass = graph.ppr_power(graph.symmetric(e, nodes_of(e)), spark.createDataFrame([("r:0", 1.0)], "id string, mass double"), 4).where("mass >= 1e-4 AND id <> 'r:0'")
    test = F.col("id").startswith("s:")
    a = mass.agg(F.sum(F.when(~test, F.col("mass"))).alias("p"), F.sum(F.when(test, F.col("mass"))).alias("t"), F.count("*").alias("n"), F.count_distinct(F.substring("id", 1, 1)).alias("md"))
    s = a.select("n", impact.blast_radius(F.col("p"), F.col("n"), F.col("md")).alias("blast"), impact.amplification(F.lit(1.0), F.lit(4.0), F.col("p")).alias("amp"), impact.coverage_gap(F.col("p"), F.col("t")).alias("gap"))
    s = s.withColumn("score", impact.composite(F.col("blast"), F.col("amp"), F.lit(0.3), F.col("gap")))
    return s.select(r("blast").alias("blast"), r("amp").alias("amp"), r("gap").alias("gap"), r("score").alias("score"), impact.level(F.col("score"), F.lit(0.3), F.col("amp"), F.col("n")).alias("level"))


@query(
    "lexical_scan",
    f"WITH {S.values(S.SOURCES, 'src', ('sid', 'body'))}, "
    + r"""l AS (SELECT sid, trim(unnest(string_split(body, chr(10)))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM src),
    k AS (SELECT *, sum(CAST(regexp_matches(line, '^(for|while)[ (]') AS INT)) OVER (PARTITION BY sid ORDER BY n) AS depth FROM l)
    SELECT sid, CAST(max(depth) AS BIGINT) AS max_depth, CAST(max(CASE WHEN depth > 0 AND regexp_matches(line, '\.(find|includes|indexOf)\(') THEN depth + 1 ELSE depth END) AS BIGINT) AS degree FROM k GROUP BY sid""",
)
def lexical_scan(spark, d):
    lines = spark.createDataFrame(S.SOURCES, "sid int, body string").select("sid", F.posexplode(F.split("body", "\n")).alias("n", "raw")).withColumn("line", F.trim("raw"))
    depth = F.sum(F.col("line").rlike(r"^(for|while)[ (]").cast("int")).over(Window.partitionBy("sid").orderBy("n"))
    k = lines.withColumn("depth", depth)
    scan = F.when((F.col("depth") > 0) & F.col("line").rlike(r"\.(find|includes|indexOf)\("), F.col("depth") + 1).otherwise(F.col("depth"))
    return k.withColumn("deg", scan).groupBy("sid").agg(F.max("depth").alias("max_depth"), F.max("deg").alias("degree"))


# ---- change planning and state

_V2 = "CASE WHEN doc_id % 7 = 1 THEN text || '!' ELSE text END"


@query(
    "plan_diff",
    f"""WITH a AS (SELECT doc_id, sha256({_V2}) AS h FROM documents WHERE doc_id % 7 <> 2), b AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 11 = 0 THEN 'partial' ELSE 'ok' END AS st FROM documents WHERE doc_id % 7 <> 3)
    SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS path, CASE WHEN a.doc_id IS NULL THEN 'delete' WHEN a.h = b.h AND st = 'ok' THEN 'keep' ELSE 'index' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
)
def plan_diff(spark, d):
    """Two versions of a tree: every seventh document new, changed or gone (that is the scenario, not a sample)."""
    docs = table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    new = docs.where("doc_id % 7 <> 2").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"), F.lit(False).alias("blank"))
    old = docs.where("doc_id % 7 <> 3").select("path", F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, "partial").otherwise("ok").alias("parse_status"), F.lit(True).alias("has_symbols"))
    return planner.plan_changes(new, old)


@query(
    "file_change",
    """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 4 THEN 'removed' WHEN doc_id % 7 = 3 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 7 IN (1, 3, 4)""",
)
def file_change(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    return store.file_changes(docs.where("doc_id % 7 <> 3").select("path"), docs.where("doc_id % 7 IN (1, 3)"), docs.where("doc_id % 7 = 4"))


@query(
    "delete_cascade",
    f"""WITH e AS ({SMALL_SQL}), gone AS (SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2)
    SELECT src_id, dst_id, kind, dst_id IN (SELECT id FROM gone) AS dst_missing FROM e WHERE src_id NOT IN (SELECT id FROM gone)""",
)
def delete_cascade(spark, d):
    e = small_edges(spark, d).withColumn("meta", F.struct(F.lit(False).alias("dst_missing"), F.lit(False).alias("ambiguous"), F.lit(None).cast("int").alias("loop_depth")))
    nodes = nodes_of(e)
    gone = table(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"))
    return store.delete_symbols({"symbol": nodes, "edge": e}, gone)["edge"].select("src_id", "dst_id", "kind", "meta.dst_missing")


@query("edge_dependents", f"WITH e AS ({SMALL_SQL}) SELECT DISTINCT left(src_id, 3) AS path FROM e WHERE dst_id IN ('n:1', 'r:2')")
def edge_dependents(spark, d):
    e = small_edges(spark, d)
    sym = nodes_of(e).withColumn("file_path", F.substring("id", 1, 3))
    return planner.edge_dependents(e, sym, spark.createDataFrame([("n:1",), ("r:2",)], "id string"))


@query("latest_wins", "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS event_type, count(*) AS n_events FROM events GROUP BY user_id")
def latest_wins(spark, d):
    return coalesce.latest_wins(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("stream_latest_wins", ORACLES["latest_wins"])
def stream_latest_wins(spark, d):
    """The events as a file stream, drained by micro-batches into a table of partial winners, then merged."""
    folder = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)

    def merge(batch, number):
        last = batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("n"))
        last.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")  # a repeated batch overwrites itself

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("user_id").agg(F.max("last").alias("l"), F.sum("n").alias("n_events")).select("user_id", F.col("l.event_type").alias("event_type"), "n_events")


@query(
    "overflow",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN count(DISTINCT user_id) > 100 THEN 1 ELSE count(DISTINCT user_id) END AS depth, count(DISTINCT user_id) > 100 AS reconcile FROM events GROUP BY 1",
)
def overflow(spark, d):
    return coalesce.overflow(table(spark, d, "events").withColumn("day", F.col("ts").cast("date").cast("string")), "day", "user_id", 100)


_QUEUE = """q AS (SELECT 'e' || event_id AS symbol_id, 'u' || user_id AS file_path, event_id AS enqueued_at, CAST(user_id % 6 AS INT) AS attempts, CAST(floor(value * 10) AS BIGINT) AS next_attempt_at FROM events WHERE event_type = 'error')"""


def _queue(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("symbol_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), F.col("event_id").alias("enqueued_at"),
        (F.col("user_id") % 6).cast("int").alias("attempts"), F.floor(F.col("value") * 10).cast("bigint").alias("next_attempt_at"), F.lit(None).cast("string").alias("last_error"),
    )


@query("queue_due", f"WITH {_QUEUE} SELECT symbol_id, file_path, next_attempt_at FROM q WHERE next_attempt_at <= 400 ORDER BY next_attempt_at, enqueued_at, symbol_id LIMIT 64")
def queue_due(spark, d):
    return planner.due(_queue(spark, d), 400).select("symbol_id", "file_path", "next_attempt_at")


@query("backoff", f"WITH {_QUEUE} SELECT symbol_id, CAST(attempts + 1 AS INT) AS attempts, CAST(1000 + list_extract([1, 5, 30, 300], least(attempts + 1, 4)) AS BIGINT) AS next_attempt_at FROM q")
def backoff(spark, d):
    q = _queue(spark, d)
    return planner.record_failure(q, q.select("symbol_id", F.lit("down").alias("error")), 1000).select("symbol_id", F.col("attempts").cast("int").alias("attempts"), "next_attempt_at")


@query("pending_files", f"WITH {_QUEUE} SELECT file_path, min(next_attempt_at) AS next_at, min(enqueued_at) AS first_at, count(*) AS n FROM q GROUP BY file_path ORDER BY next_at, first_at, file_path LIMIT 8")
def pending_files(spark, d):
    return planner.pending_files(_queue(spark, d))


_HASH = """sha256(concat_ws('|', length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey, length(c_name) || ':' || c_name, length(c_mktsegment) || ':' || c_mktsegment))"""


@query("digest_rows", f"SELECT c_custkey, {_HASH} AS row_hash FROM customer")
def digest_rows(spark, d):
    return store.row_digest(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", "row_hash")


@query("digest_diff", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'only_left' WHEN c_custkey % 9 = 1 THEN 'only_right' ELSE 'differs' END AS side FROM customer WHERE c_custkey % 9 IN (0, 1, 2)")
def digest_diff(spark, d):
    c = table(spark, d, "customer")
    right = c.where("c_custkey % 9 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 9 == 2, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")))
    return store.digest_diff(c.where("c_custkey % 9 <> 1"), right, "c_custkey", ["c_name", "c_mktsegment"])


# ---- evaluation

_RANKED = "rk AS (SELECT source AS q, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), rel AS (SELECT source AS q, d.doc_id AS id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND n_chars > 3000), hub AS (SELECT doc_id AS id FROM documents WHERE lang = 'de')"
_METRICS = """SELECT rk.q, CASE WHEN any_value(nr) IS NULL THEN 0.0 ELSE sum(CASE WHEN rank <= 10 AND rel.id IS NOT NULL THEN 1 ELSE 0 END) / any_value(nr) END AS recall,
  sum(CASE WHEN rank <= 10 AND rel.id IS NOT NULL THEN 1 ELSE 0 END) / 10.0 AS precision, sum(CASE WHEN rank <= 10 AND hub.id IS NOT NULL THEN 1 ELSE 0 END) / 10.0 AS contamination,
  coalesce(1.0 / min(CASE WHEN rel.id IS NOT NULL THEN rank END), 0.0) AS mrr FROM rk LEFT JOIN rel ON rel.q = rk.q AND rel.id = rk.id LEFT JOIN hub ON hub.id = rk.id LEFT JOIN (SELECT q, count(*) AS nr FROM rel GROUP BY q) n ON n.q = rk.q GROUP BY rk.q"""


def _metrics(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    ranked = docs.select(F.col("source").alias("q"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    rel = docs.where("n_chars > 3000").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select(F.col("source").alias("q"), F.col("doc_id").alias("id"))
    return E.retrieval_metrics(ranked, rel, docs.where("lang = 'de'").select(F.col("doc_id").alias("id")))


_ROUNDED = "round({c}, 6) AS {c}"
_FOUR = ("recall", "precision", "contamination", "mrr")


@query("metrics_eval", f"WITH {_RANKED}, m AS ({_METRICS}) SELECT q, {', '.join(_ROUNDED.format(c=c) for c in _FOUR)} FROM m")
def metrics_eval(spark, d):
    return _metrics(spark, d).select("q", *[r(c).alias(c) for c in _FOUR])


@query("metrics_mean", f"WITH {_RANKED}, m AS ({_METRICS}) SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in _FOUR)} FROM m")
def metrics_mean(spark, d):
    return E.mean_metrics(_metrics(spark, d)).select(*[r(c).alias(c) for c in _FOUR])


@query(
    "gate_regression",
    f"""WITH {_RANKED}, m AS ({_METRICS}) SELECT q, NOT (mrr - mrr * 0.8 > 0.05 OR (contamination + 0.1) - contamination > 0.05) AS passed,
    concat_ws(',', CASE WHEN mrr - mrr * 0.8 > 0.05 THEN 'mrr' END, CASE WHEN (contamination + 0.1) - contamination > 0.05 THEN 'contamination' END) AS reasons FROM m""",
)
def gate_regression(spark, d):
    m = _metrics(spark, d)
    after = m.withColumn("mrr", F.col("mrr") * 0.8).withColumn("contamination", F.col("contamination") + 0.1)
    return E.regression_gate(m, after, "q")


@query("gate_coverage", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN false ELSE n_nationkey / 100.0 >= 0.1 - 0.01 AND n_nationkey > 12 END AS promote FROM nation")
def gate_coverage(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", E.coverage_gate(F.when(k % 5 != 0, F.lit(0.1)), k / 100.0, F.lit(12), k).alias("promote"))


@query("health", f"WITH e AS ({SMALL_SQL}) SELECT unnest(['symbols', 'edges', 'overall']) AS \"check\", unnest(['ok', 'ok', 'ok']) AS status")
def health(spark, d):
    e = small_edges(spark, d)
    return E.health(nodes_of(e), e)


def _gate_side(spark, d, fall: float, swap: bool) -> dict:
    """One side of the gate: rankings by length, the two longest of each source swapped on request, and lowered means."""
    best = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = table(spark, d, "documents").select(F.col("source").alias("q"), F.col("doc_id").alias("id"), F.row_number().over(best).alias("rank"))
    if swap:
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= 2, 3 - F.col("rank")).otherwise(F.col("rank")))
    return {"generation": 1, "corpus": "documents", "ranked": ranked, "metrics": E.mean_metrics(_metrics(spark, d)).withColumn("mrr", F.col("mrr") - fall)}


@query(
    "gate_retrieval",
    """SELECT unnest(['altered', 'same', 'swapped', 'worse']) AS side, unnest([true, true, false, false]) AS passed, unnest([true, true, false, true]) AS stable, unnest(['', '', '', 'mrr']) AS degraded
    WHERE (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) > 1""",
)
def gate_retrieval(spark, d):
    all_q = table(spark, d, "documents").select(F.col("source").alias("q")).distinct()
    none, base = all_q.where("false"), _gate_side(spark, d, 0.0, False)
    sides = {"same": (base, none), "swapped": (_gate_side(spark, d, 0.0, True), none), "altered": (_gate_side(spark, d, 0.0, True), all_q), "worse": (_gate_side(spark, d, 0.1, False), none)}
    out = [E.retrieval_gate(base, side, skip).select(F.lit(name).alias("side"), "passed", "stable", "degraded") for name, (side, skip) in sides.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "harness_offline",
    """WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand || '/' || p_size || '.py' AS path, p_brand AS b FROM part),
    g AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN 'none' ELSE p_brand END AS q, p_name AS name, CASE WHEN p_size % 5 = 0 THEN 'no/such' ELSE p_brand || '/' || p_size END AS part FROM part),
    rel AS (SELECT DISTINCT q, id FROM g JOIN s USING (name) WHERE contains(lower(path), lower(part))),
    rk AS (SELECT b AS q, id, row_number() OVER (PARTITION BY b ORDER BY id) AS up, row_number() OVER (PARTITION BY b ORDER BY id DESC) AS down FROM s),
    two AS (SELECT 'up' AS method, q, id, up AS rank FROM rk UNION ALL SELECT 'down', q, id, down FROM rk),
    m AS (SELECT method, q, sum(CAST(rank <= 10 AND rel.id IS NOT NULL AS INT)) / any_value(n) AS recall, sum(CAST(rank <= 10 AND rel.id IS NOT NULL AS INT)) / 10.0 AS precision,
      sum(CAST(rank <= 10 AND two.id % 7 = 0 AS INT)) / 10.0 AS contamination, coalesce(1.0 / min(CASE WHEN rel.id IS NOT NULL THEN rank END), 0) AS mrr
      FROM two LEFT JOIN rel USING (q, id) JOIN (SELECT q, count(*) AS n FROM rel GROUP BY q) c USING (q) GROUP BY method, q)
    SELECT method, (SELECT count(DISTINCT q) FROM rel) AS n_eval, (SELECT count(DISTINCT q) FROM g) - (SELECT count(DISTINCT q) FROM rel) AS n_skipped, round(avg(recall), 6) AS recall,
      round(avg(precision), 6) AS precision, round(avg(contamination), 6) AS contamination, round(avg(mrr), 6) AS mrr FROM m GROUP BY method""",
)
def harness_offline(spark, d):
    """Parts as symbols, brands as golden queries, two rankings; every fifth size names nothing that exists."""
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    symbols = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("/"), size, F.lit(".py")).alias("file_path"), F.col("p_brand").alias("q"))
    odd = F.col("p_size") % 5 == 0
    golden = p.select(F.when(odd, "none").otherwise(F.col("p_brand")).alias("q"), F.col("p_name").alias("name"), F.when(odd, "no/such").otherwise(F.concat("p_brand", F.lit("/"), size)).alias("part"))
    ranked = {m: symbols.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy(o)).alias("rank")) for m, o in (("up", F.asc("id")), ("down", F.desc("id")))}
    out = E.offline_harness(symbols, golden, ranked, symbols.where("id % 7 = 0").select("id"))
    return out.select("method", "n_eval", "n_skipped", *[r(c).alias(c) for c in _FOUR])


_CARDS = f"""s AS (SELECT p_brand || '/' || p_size || '/x.py' AS file_path, p_name AS name, p_type AS body, p_brand || '/' || p_size AS module, p_brand AS top FROM part),
  w AS (SELECT DISTINCT key, t AS token FROM (SELECT key, unnest({_CAMEL.format(t="concat_ws(' ', key, name, name, body)")}) AS t FROM (SELECT *, {{key}} AS key FROM s)) WHERE length(t) > 1)"""


def _cards(spark, d, level: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("/x.py"))
    symbols = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.col("p_type").alias("body_excerpt"), path.alias("file_path"))
    return E.score_cards(E.cards(symbols, level)[1], "Brand steel STEEL copperRing")


for _level in ("module", "top"):
    query(
        f"cards_{_level}",
        f"WITH {_CARDS.format(key=_level)} SELECT key, CAST(sum(n) AS BIGINT) AS score FROM w JOIN (VALUES ('brand', 1), ('steel', 2), ('copper', 1), ('ring', 1)) q(token, n) USING (token) GROUP BY key",
    )(lambda spark, d, level=_level: _cards(spark, d, level))


# ---- flagship

@query(
    "discover",
    f"""WITH {_DOCS_TERMS}, n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT term, ln((n + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM terms, n GROUP BY term, n),
    norm AS (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM terms JOIN idf USING (term) GROUP BY id),
    s AS (SELECT q.layer, id, sum(tf * idf * idf) / any_value(norm) AS score FROM terms JOIN idf USING (term) JOIN norm USING (id) JOIN (VALUES ('apache', 'a'), ('license', 'a'), ('gnu', 'b'), ('license', 'b')) q(term, layer) USING (term) GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, id) AS rk0 FROM s QUALIFY rk0 <= 25),
    k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, CAST(id AS VARCHAR)) AS rk FROM t)
    SELECT CAST(id AS VARCHAR) AS symbol_id, round(sum(1.0 / (60 + rk)), 9) AS score, any_value(d.source) AS source FROM k JOIN documents d ON d.doc_id = k.id GROUP BY id ORDER BY 2 DESC, 1 LIMIT 10""",
)
def discover(spark, d):
    """Two ranked layers over the documents, fused and hydrated."""
    docs = table(spark, d, "documents")
    layers = [lexical.tfidf_search(docs, "doc_id", "text", q, 25).select(F.col("id").cast("string").alias("symbol_id"), "score", F.lit(n).alias("layer")) for n, q in (("a", "apache license"), ("b", "gnu license"))]
    fused = fusion.rrf_fuse(layers[0].unionByName(layers[1]), 10).select("symbol_id", r("score", 9).alias("score"))
    return fused.join(docs.select(F.col("doc_id").cast("string").alias("symbol_id"), "source"), "symbol_id")


# ---- lookups, texts and budgets over whole tables

_PARTS = """parts AS (SELECT 'part:' || p_partkey AS id, p_type AS kind, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_brand || '/' || p_size || '.py' AS file_path FROM part)"""


def _parts(spark, d) -> DataFrame:
    """Parts seen as symbols: brand and size give the file."""
    text = lambda *c: F.concat(*[F.col(x).cast("string") if x in ("p_partkey", "p_brand", "p_size", "p_name") else F.lit(x) for x in c])
    return table(spark, d, "part").select(
        text("part:", "p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"),
        text("p_brand", ".", "p_name").alias("qualified_name"), text("p_brand", "/", "p_size", ".py").alias("file_path"),
    )


@query("sel_symbols", f"WITH {_PARTS} SELECT * FROM parts ORDER BY id")
def sel_symbols(spark, d):
    return lookup.list_symbols(_parts(spark, d))


@query("sel_edges", f"WITH e AS ({FULL_SQL}) SELECT src_id, dst_id, kind, round(confidence, 6) AS confidence FROM e ORDER BY ALL")
def sel_edges(spark, d):
    return lookup.list_edges(full_edges(spark, d)).select("src_id", "dst_id", "kind", r("confidence").alias("confidence"))


@query("sel_count", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("nation", "part", "orders", "lineitem", "documents")))
def sel_count(spark, d):
    parts = [table(spark, d, lookup.check_table_name(t)).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("nation", "part", "orders", "lineitem", "documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("sel_in_file", f"WITH {_PARTS} SELECT id, name FROM parts WHERE file_path = (SELECT min(file_path) FROM parts) ORDER BY id")
def sel_in_file(spark, d):
    symbols = _parts(spark, d)
    path = symbols.agg(F.min("file_path")).first()[0]
    return lookup.symbols_in_file(symbols, path).select("id", "name")


@query("sel_by_ids", f"WITH {_PARTS} SELECT id, name FROM parts WHERE id IN ('part:1', 'part:7', 'part:150', 'part:none') ORDER BY id")
def sel_by_ids(spark, d):
    return lookup.symbols_by_values(_parts(spark, d), "id", ["part:7", "part:1", "part:7", "part:150", "part:none"]).select("id", "name")


@query("sel_hydrate", f"WITH {_PARTS} SELECT event_id AS pos, id, name FROM events JOIN parts ON id = 'part:' || user_id ORDER BY pos")
def sel_hydrate(spark, d):
    asked = table(spark, d, "events").select(F.concat(F.lit("part:"), F.col("user_id").cast("string")).alias("symbol_id"), F.col("event_id").alias("pos"))
    return lookup.hydrate(asked, _parts(spark, d)).select("pos", "id", "name")


_SCAN = """(SELECT '{needle}' AS needle, id FROM parts WHERE id = '{needle}' OR name = '{needle}' OR contains(lower(name), lower('{needle}')) OR contains(lower(qualified_name), lower('{needle}')) OR contains(lower(id), lower('{needle}'))
  ORDER BY CASE WHEN id = '{needle}' THEN 6 WHEN qualified_name = '{needle}' THEN 5 WHEN name = '{needle}' THEN 4 WHEN lower(name) = lower('{needle}') THEN 3
    WHEN contains(lower(name), lower('{needle}')) OR contains(lower(qualified_name), lower('{needle}')) THEN 2 ELSE 1 END DESC, id LIMIT 1)"""


@query("sel_scan", f"WITH {_PARTS} {_SCAN.format(needle='part:12')} UNION ALL {_SCAN.format(needle='BRAND')} UNION ALL {_SCAN.format(needle='PART:3')}")
def sel_scan(spark, d):
    found = [lookup.resolve_symbol_scan(_parts(spark, d), needle).select(F.lit(needle).alias("needle"), "id") for needle in ("part:12", "BRAND", "PART:3")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("module_path", "SELECT page_id, regexp_replace(regexp_replace(url || '.' || page_id % 3, '\\\\', '/', 'g'), '([^/])\\.[^./]*$', '\\1') AS module FROM pages")
def module_path(spark, d):
    return table(spark, d, "pages").select("page_id", T.module_from_path(F.concat("url", F.lit("."), (F.col("page_id") % 3).cast("string"))).alias("module"))


@query("embedding_text", "SELECT c_custkey, concat_ws(chr(10), c_name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_nationkey % 3 > 0 THEN c_mktsegment || '!' END) AS text FROM customer")
def embedding_text(spark, d):
    c = table(spark, d, "customer")
    doc = F.when(F.col("c_nationkey") % 3 > 0, F.concat("c_mktsegment", F.lit("!"))).otherwise("")
    return c.select("c_custkey", semantic.embedding_text(F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")), doc, F.lit(None).cast("string")).alias("text"))


@query(
    "budget_skip_turns",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, greatest(1, octet_length(encode(text)) // 4) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations
      WHERE greatest(1, octet_length(encode(text)) // 4) <= 120),
    f AS (SELECT conv_id, turn, k, cost <= 120 AS taken, CASE WHEN cost <= 120 THEN cost ELSE 0 END AS used FROM c WHERE k = 1
      UNION ALL SELECT c.conv_id, c.turn, c.k, f.used + cost <= 120, CASE WHEN f.used + cost <= 120 THEN f.used + cost ELSE f.used END FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1)
    SELECT conv_id, CAST(turn AS VARCHAR) AS id, CAST(used AS BIGINT) AS used FROM f WHERE taken""",
)
def budget_skip_turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("cost"))
    return fusion.budget_skip(c, "turn", "cost", 120, "conv_id", "turn")


ORACLES["analysis_subgraph"] = f"""WITH e AS ({SMALL_SQL}), g AS (SELECT * FROM e WHERE kind <> 'imports' AND confidence > 0 AND src_id <> dst_id),
    arcs AS (SELECT src_id AS a, dst_id AS b FROM g UNION SELECT dst_id, src_id FROM g), l0 AS (SELECT 'n:3' AS id),
    l1 AS (SELECT DISTINCT b AS id FROM arcs JOIN l0 ON a = id WHERE b NOT IN (SELECT id FROM l0)),
    l2 AS (SELECT DISTINCT b AS id FROM arcs JOIN l1 ON a = id WHERE b NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1))
    SELECT id, CAST(hop AS INT) AS hop FROM (SELECT id, 0 AS hop FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2) ORDER BY hop, id LIMIT 96"""


@query(
    "reference_dependents",
    """WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM benchmark WHERE item_id <= 5),
    used AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(concat_ws(' ', source, text), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents)
    SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path FROM used JOIN names USING (name)""",
)
def reference_dependents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("source").alias("signature"), F.col("text").alias("body_excerpt"))
    names = table(spark, d, "benchmark").where("item_id <= 5").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    return planner.reference_dependents(docs, names)


@query("resolved_pairs", f"WITH e AS ({FULL_SQL}) SELECT DISTINCT src_id, dst_id FROM e WHERE confidence > 0 AND src_id <> dst_id AND kind = 'writes'")
def resolved_pairs(spark, d):
    return graph.resolved_pairs(full_edges(spark, d), "writes")


_LOOP = "CASE p_size % 5 WHEN 0 THEN 'constant' WHEN 1 THEN 'logarithmic' WHEN 2 THEN 'sqrt' ELSE 'linear' END"


@query(
    "loop_class",
    f"""WITH p AS (SELECT p_partkey, {_LOOP} AS bound FROM part) SELECT p_partkey, CASE bound WHEN 'linear' THEN 'polynomial' ELSE bound END AS kind,
    CAST(bound = 'linear' AS INT) AS degree, 0 AS log_power, CAST(bound = 'logarithmic' AS INT) AS power, 0 AS base FROM p""",
)
def loop_class(spark, d):
    return table(spark, d, "part").select("p_partkey", A.loop_class(F.expr(_LOOP)).alias("c")).select("p_partkey", "c.*")


@query(
    "arg_reduction",
    """WITH t AS (SELECT page_id AS id, html AS x FROM pages) SELECT id, CASE WHEN contains(x, '/ 2') OR contains(x, '/2') OR contains(x, '// 2') OR contains(x, '>> 1') OR contains(x, 'mid') THEN 'halving'
    WHEN contains(x, '- 1') OR contains(x, '-1') OR contains(x, '- 2') OR contains(x, '+ 1') THEN 'decrement' ELSE 'none' END AS reduction FROM t""",
)
def arg_reduction(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), A.arg_reduction(F.col("html")).alias("reduction"))


_IO_NAME = "list_extract(['query', 'fetch', 'post', 'ReadFile', 'other', 'raw', 'delete'], CAST(1 + event_id % 7 AS INT))"
_IO_CALLEE = "list_extract(['db.run', 'axios', 'list', 'fs.open', 'requests', 'my.client'], CAST(1 + event_id % 6 AS INT))"
_IO_TEXT = "CASE WHEN event_type = 'view' THEN 'SELECT x' WHEN event_type = 'purchase' THEN 'Insert Into t' ELSE event_type END"


@query(
    "io_kind",
    f"""WITH c AS (SELECT event_id, {_IO_NAME} AS name, {_IO_CALLEE} AS callee, lower({_IO_TEXT}) AS text FROM events) SELECT event_id,
    CASE WHEN name IN ('query', 'raw') OR contains(callee, 'db.') OR contains(text, 'select ') OR contains(text, 'insert into ') THEN 'database_query'
      WHEN name = 'fetch' OR (name IN ('fetch', 'post', 'put', 'delete') AND (contains(callee, 'axios') OR contains(callee, 'requests') OR contains(callee, 'client') OR contains(callee, 'http'))) THEN 'network_rpc'
      WHEN name = 'ReadFile' OR starts_with(callee, 'fs.') THEN 'filesystem_blocking' END AS kind FROM c""",
)
def io_kind(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n).cast("int") + 1)
    name, callee = pick(("query", "fetch", "post", "ReadFile", "other", "raw", "delete"), 7), pick(("db.run", "axios", "list", "fs.open", "requests", "my.client"), 6)
    return table(spark, d, "events").select("event_id", A.io_kind(name, callee, F.expr(_IO_TEXT)).alias("kind"))


@query(
    "sel_resolve",
    f"WITH {_PARTS}, q AS (SELECT unnest(['part:9', 'part:3', 'part:none', 'part:200']) AS symbol_id, unnest([0, 1, 2, 3]) AS pos) SELECT CAST(pos AS INT) AS pos, id, name FROM q JOIN parts ON id = symbol_id",
)
def sel_resolve(spark, d):
    return lookup.resolve_symbols(["part:9", "part:3", "part:none", "part:200"], _parts(spark, d))[0].select("pos", "id", "name")


@query(
    "symbol_upsert",
    """SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 5 = 0 THEN '*' ELSE '' END AS name FROM customer UNION ALL SELECT -c_custkey, c_name || '*' FROM customer WHERE c_custkey % 5 = 1""",
)
def symbol_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = old.where("id % 5 IN (0, 1)").select(F.when(F.col("id") % 5 == 1, -F.col("id")).otherwise(F.col("id")).alias("id"), F.concat("name", F.lit("*")).alias("name"))
    return store.upsert(old, new, ("id",))


@query(
    "edge_upsert",
    f"""WITH e AS ({SMALL_SQL}) SELECT src_id, dst_id, kind, CASE WHEN kind = 'imports' THEN 0.25 ELSE confidence END AS confidence FROM e UNION ALL SELECT dst_id, src_id, 'imports', 0.25 FROM e WHERE kind = 'inherits'""",
)
def edge_upsert(spark, d):
    e = small_edges(spark, d)
    low = F.lit(0.25).alias("confidence")
    fresh = e.where("kind = 'imports'").select("src_id", "dst_id", "kind", low).unionByName(e.where("kind = 'inherits'").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.lit("imports").alias("kind"), low))
    return store.upsert(e, fresh, ("src_id", "dst_id", "kind"))


@query(
    "parity_lists",
    """WITH a AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_name) AS pos, n_nationkey / 7.0 AS score FROM nation WHERE n_nationkey > 1),
    b AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_regionkey, n_name) AS pos, n_nationkey / 7.0 + CASE WHEN n_nationkey % 5 = 0 THEN 1e-9 ELSE 0 END AS score FROM nation WHERE n_nationkey < 22)
    SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS n_both, count(*) FILTER (b.id IS NULL) AS only_left, count(*) FILTER (a.id IS NULL) AS only_right,
      count(*) FILTER (a.pos <> b.pos) AS moved, count(*) FILTER (a.id % 5 = 0 AND b.id IS NOT NULL) AS changed FROM a FULL JOIN b ON a.id = b.id""",
)
def parity_lists(spark, d):
    n = table(spark, d, "nation").withColumn("score", F.col("n_nationkey") / 7.0)
    left = n.where("n_nationkey > 1").select(F.col("n_nationkey").alias("id"), F.row_number().over(Window.orderBy("n_name")).alias("pos"), "score")
    moved = F.col("score") + F.when(F.col("n_nationkey") % 5 == 0, 1e-9).otherwise(0.0)
    right = n.where("n_nationkey < 22").select(F.col("n_nationkey").alias("id"), F.row_number().over(Window.orderBy("n_regionkey", "n_name")).alias("pos"), moved.alias("score"))
    return E.parity_lists(left, right)
