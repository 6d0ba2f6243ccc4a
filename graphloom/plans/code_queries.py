"""Queries that run the extractors and the complexity analysis: every part becomes a source file per language.

The files are written out from templates over the whole ``part`` table; the SQL states the symbols that each must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis
from ..sources import walk
from ..sources.extract import extract_symbols
from .graph_tables import table
from .registry import query
from .samples import literal

Symbol = tuple[str, str, str, int, int]
#: Path, text, and ``kind, name, qualified name, first line, last line`` of its symbols; ``{k}`` is the part's key.
FILES: dict[str, tuple[str, str, list[Symbol]]] = {
    "python": (
        "src/p{k}.py",
        'LIMIT_{k} = 3\ndef load_{k}(a, b=1):\n    """Doc."""\n    def inner():\n        return a\n    return inner()\n\nclass Part{k}:\n    rate = 2\n    def cost(self):\n        return self.rate\n',
        [("const", "LIMIT_{k}", "LIMIT_{k}", 1, 1), ("function", "load_{k}", "load_{k}", 2, 6), ("class", "Part{k}", "Part{k}", 8, 11), ("method", "cost", "Part{k}.cost", 10, 11)],
    ),
    "typescript": (
        "web/p{k}.ts",
        'export interface Shape{k} {\n  side: number;\n}\nconst MAX_{k} = 5;\nexport const grow_{k} = (x: number) => {\n  return x + 1;\n};\nexport function make{k}(x: number) {\n  // class Hidden {}\n'
        '  return "class Hidden {}";\n}\nexport class Box{k} {\n  size(): number {\n    return MAX_{k};\n  }\n}\n',
        [("interface", "Shape{k}", "Shape{k}", 1, 3), ("const", "MAX_{k}", "MAX_{k}", 4, 4), ("function", "grow_{k}", "grow_{k}", 5, 7), ("function", "make{k}", "make{k}", 8, 11),
         ("class", "Box{k}", "Box{k}", 12, 16), ("method", "size", "Box{k}.size", 13, 15)],
    ),
    "go": (
        "srv/p{k}.go",
        "package srv\n\ntype Disk{k} struct {\n\tn int\n}\n\ntype Store{k} interface {\n\tGet() int\n}\n\nfunc (d *Disk{k}) Read(x int) int {\n\treturn d.n + x\n}\n\nfunc New{k}() int {\n\treturn 1\n}\n",
        [("class", "Disk{k}", "Disk{k}", 3, 5), ("interface", "Store{k}", "Store{k}", 7, 9), ("method", "Read", "Disk{k}.Read", 11, 13), ("function", "New{k}", "New{k}", 15, 17)],
    ),
    "java": (
        "j/P{k}.java",
        "public class Outer{k} {\n  static class Inner {\n    int get() {\n      return 1;\n    }\n  }\n  public void run(int x) {\n    if (x > 0) { call(x); }\n  }\n}\ninterface Shape{k} {\n}\n",
        [("class", "Outer{k}", "Outer{k}", 1, 10), ("class", "Inner", "Outer{k}.Inner", 2, 6), ("method", "get", "Outer{k}.Inner.get", 3, 5), ("method", "run", "Outer{k}.run", 7, 9), ("interface", "Shape{k}", "Shape{k}", 11, 12)],
    ),
    "csharp": (
        "c/P{k}.cs",
        "public struct Point{k}\n{\n  public int Sum(int a)\n  {\n    return a;\n  }\n}\npublic enum Color{k} { Red }\n",
        [("class", "Point{k}", "Point{k}", 1, 7), ("method", "Sum", "Point{k}.Sum", 3, 6), ("class", "Color{k}", "Color{k}", 8, 8)],
    ),
    "rust": (
        "r/p{k}.rs",
        "pub struct Tank{k} {\n    level: u32,\n}\nimpl Tank{k} {\n    pub fn fill(&mut self) {\n        self.level += 1;\n    }\n}\npub trait Flow{k} {\n}\nfn main_{k}() {\n}\n",
        [("class", "Tank{k}", "Tank{k}", 1, 3), ("method", "fill", "Tank{k}.fill", 5, 7), ("interface", "Flow{k}", "Flow{k}", 9, 10), ("function", "main_{k}", "main_{k}", 11, 12)],
    ),
    "c": (
        "c/p{k}.c",
        "struct node{k} {\n  int v;\n};\nstatic int add_{k}(int a, int b) {\n  return a + b;\n}\n",
        [("class", "node{k}", "node{k}", 1, 3), ("function", "add_{k}", "add_{k}", 4, 6)],
    ),
    "cpp": (
        "c/p{k}.cpp",
        "struct node{k} {\n  int v;\n};\nint add_{k}(int a) {\n  return a;\n}\n",
        [("class", "node{k}", "node{k}", 1, 3), ("function", "add_{k}", "add_{k}", 4, 6)],
    ),
    "ruby": (
        "b/p{k}.rb",
        "class Cart{k}\n  def total\n    1\n  end\nend\ndef helper_{k}\n  while x do\n    y\n  end\nend\n",
        [("class", "Cart{k}", "Cart{k}", 1, 5), ("method", "total", "Cart{k}.total", 2, 4), ("function", "helper_{k}", "helper_{k}", 6, 10)],
    ),
    "php": (
        "h/p{k}.php",
        "<?php\nclass Mail{k} {\n  public function send($to) {\n    return $to;\n  }\n}\nfunction run_{k}() {\n  return 1;\n}\n",
        [("class", "Mail{k}", "Mail{k}", 2, 6), ("method", "send", "Mail{k}.send", 3, 5), ("function", "run_{k}", "run_{k}", 7, 9)],
    ),
    "yaml": (
        "conf/p{k}.yaml",
        "server:\n  port: {k}\n  hosts:\n    - alpha\n    - name: beta\n      role: db\n# comment\nnote: |\n  first\n  second\n",
        [("var", x, x, a, b) for x, a, b in (("server.port", 2, 2), ("server.hosts[0]", 4, 4), ("server.hosts[1].name", 5, 5), ("server.hosts[1].role", 6, 6), ("note", 8, 10))],
    ),
    "toml": (
        "conf/p{k}.toml",
        'title = "x"\n[owner]\nid = {k}\ntags = ["a", "b"]\n[[item]]\nsku = 1\n[[item]]\nsku = 2\n',
        [("var", x, x, a, a) for x, a in (("title", 1), ("owner.id", 3), ("owner.tags[0]", 4), ("owner.tags[1]", 4), ("item[0].sku", 6), ("item[1].sku", 8))],
    ),
    "sql": (
        "db/p{k}.sql",
        "CREATE TABLE IF NOT EXISTS shop.t{k} (\n  id int, -- key, of rows\n  name varchar(10, 2),\n  PRIMARY KEY (id)\n);\nCREATE TABLE copy{k} AS SELECT 1;\n",
        [("class", "t{k}", "t{k}", 1, 5), ("var", "id", "t{k}.id", 2, 2), ("var", "name", "t{k}.name", 3, 3)],
    ),
    "html": (
        "web/p{k}.html",
        "<a href=\"/p/{k}\">go</a>\n<a href='/p/{k}'>again</a>\n<script>\nfunction open{k}() {\n  fetch(\"/api/{k}\");\n}\n</script>\n",
        [("route", "/p/{k}", "/p/{k}", 1, 1), ("route", "/api/{k}", "/api/{k}", 5, 5), ("function", "open{k}", "open{k}", 4, 6)],
    ),
    "markdown": (
        "docs/p{k}.md",
        "intro\n# One {k}\ntext\n```\n# not a heading\n```\n### Two ##\n   #### Three\n    # code\nlast",
        [("var", "preamble", "preamble", 1, 1), ("var", "One {k}", "One {k}", 2, 6), ("var", "Two", "Two", 7, 7), ("var", "Three", "Three", 8, 10)],
    ),
}


def _filled(template: str, key: str = "p_partkey"):
    return F.replace(F.lit(template), F.lit("{k}"), F.col(key).cast("string"))


def _expected(language: str) -> str:
    path, _, rows = FILES[language]
    put = lambda c: f"replace({c}, '{{k}}', CAST(p_partkey AS VARCHAR))"
    named = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return (
        f"SELECT {put(literal(path))} AS file_path, kind, {put('name')} AS name, '{language}:' || {put(literal(path))} || ':' || {put('qual')} AS qualified_name, "
        f"CAST(a AS INT) AS line_start, CAST(b AS INT) AS line_end FROM part, (VALUES {named}) t(kind, name, qual, a, b)"
    )


def _register(language: str) -> None:
    path, text, _ = FILES[language]

    @query(f"src_{language}", _expected(language))
    def run(spark, d):
        files = table(spark, d, "part").select(_filled(path).alias("path"), _filled(text).alias("content"))
        return extract_symbols(files).where("id IS NOT NULL").select("file_path", "kind", "name", "qualified_name", "line_start", "line_end")


for _language in FILES:
    _register(_language)


# Paths, texts and the state of their files: blank, unknown, broken, without symbols, and artifacts that fall back.
_STATES = [
    ("a/p{k}.py", "x = 1\n", "partial", "python", 0), ("b/p{k}.py", "def (:\n", "failed", "python", 0), ("c/p{k}.py", "  \n", "ok", "python", 0), ("d/p{k}.xyz", "words", "failed", "text", 0),
    ("e/p{k}.md", "no heading", "ok", "markdown", 1), ("f/p{k}.ts", "function f{k}() {", "partial", "typescript", 1), ("g/p{k}.mjs", "function f() { }", "ok", "javascript", 1),
    ("h/Dockerfile{k}", "a: 1\n", "ok", "yaml", 1), ("i/p{k}.sql", "SELECT 1", "ok", "sql", 1),
]


@query(
    "parse_status",
    "SELECT replace(path, '{k}', CAST(p_partkey AS VARCHAR)) AS file_path, status, language, CAST(n AS BIGINT) AS n_symbols FROM part, (VALUES "
    + ", ".join("(" + ", ".join(literal(x) for x in (p, s, g, n)) + ")" for p, _, s, g, n in _STATES)
    + ") t(path, status, language, n)",
)
def parse_status(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t, *_ in _STATES]))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = table(spark, d, "part").select("p_partkey").repartition(tasks, "p_partkey")  # a small file of keys makes many files to parse
    files = keys.select("p_partkey", each.alias("f"))
    fill = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("p_partkey").cast("string"))
    rows = extract_symbols(files.select(fill("f.p").alias("path"), fill("f.t").alias("content")))
    return rows.groupBy("file_path").agg(F.max(F.when(F.col("id").isNull(), F.col("status"))).alias("status"), F.max(F.when(F.col("id").isNull(), F.col("language"))).alias("language"), F.count("id").alias("n_symbols"))


# Paths and the language the walker admits them under; null: not admitted.
_PATHS = [
    ("src/p{k}.TS", "typescript"), ("src/p{k}.js", None), ("src/p{k}.hxx", "cpp"), ("node_modules/p{k}.ts", None), ("x/dist/p{k}.py", None), ("dist{k}/p.py", "python"), ("p{k}.rake", "ruby"),
    ("doc/p{k}.htm", "html"), ("ci/Jenkinsfile{k}", "yaml"), ("ci/p{k}.gitlab-ci", "yaml"), ("bin/p{k}", None), ("p{k}.YML", "yaml"), ("a.b/p{k}", None),
]


@query(
    "admission",
    "SELECT replace(path, '{k}', CAST(p_partkey AS VARCHAR)) AS path, language FROM part, (VALUES " + ", ".join(f"({literal(p)}, {literal(g)})" for p, g in _PATHS) + ") t(path, language) WHERE language IS NOT NULL",
)
def admission(spark, d):
    paths = table(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.lit(p) for p, _ in _PATHS])).alias("p"))
    paths = paths.select(F.replace("p", F.lit("{k}"), F.col("p_partkey").cast("string")).alias("path")).where(~walk.pruned(F.col("path")))
    return paths.select("path", walk.language_of(F.col("path")).alias("language")).where("language IS NOT NULL")


# ---- complexity


def _nest(depth: int) -> str:
    loops = "".join("    " * (j + 1) + f"for x{j} in xs:\n" for j in range(depth))
    return f"def f(xs):\n{loops}" + "    " * (depth + 1) + "use(xs)\n"


@query(
    "local_complexity",
    """WITH p AS (SELECT p_partkey, p_size % 4 AS n FROM part) SELECT p_partkey, CASE n WHEN 0 THEN 'O(1)' WHEN 1 THEN 'O(n)' ELSE 'O(n^' || n || ')' END AS local_time,
    CAST(n AS INT) AS max_loop_depth, CAST(1 + n AS INT) AS cyclomatic, CAST(n * (n + 1) // 2 AS INT) AS cognitive, CAST(1 AS INT) AS n_call_sites, false AS recursive FROM p""",
)
def local_complexity(spark, d):
    body = F.element_at(F.array(*[F.lit(_nest(n)) for n in range(4)]), (F.col("p_size") % 4 + 1).cast("int"))
    symbols = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit("m.py").alias("file_path"), F.lit(1).alias("line_start"), body.alias("body_excerpt")
    )
    out = analysis.summaries(symbols)
    return out.select(F.col("symbol_id").cast("long").alias("p_partkey"), "local_time", "max_loop_depth", "cyclomatic", "cognitive", "n_call_sites", "recursive")


@query(
    "lexical_scan_docs",
    r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    k AS (SELECT *, least(255, sum(CAST(regexp_matches(line, '^(for|while)[ (]') AS INT)) OVER (PARTITION BY doc_id ORDER BY n)) AS depth FROM l),
    m AS (SELECT doc_id, max(depth) AS depth, max(CASE WHEN depth > 0 AND regexp_matches(line, '\.(find|includes|indexOf)\(') THEN depth + 1 ELSE depth END) AS degree FROM k GROUP BY doc_id)
    SELECT doc_id, CAST(depth AS INT) AS max_loop_depth, CASE degree WHEN 0 THEN 'O(1)' WHEN 1 THEN 'O(n)' ELSE 'O(n^' || CAST(degree AS BIGINT) || ')' END AS local_time FROM m""",
)
def lexical_scan_docs(spark, d):
    """The fallback scan of texts in a language without a parser, over all documents."""
    symbols = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit("x.rb").alias("file_path"), F.lit(1).alias("line_start"), F.col("text").alias("body_excerpt")
    )
    return analysis.summaries(symbols).select(F.col("symbol_id").cast("long").alias("doc_id"), "max_loop_depth", "local_time")


# Three functions a part: the first calls the second in a loop, the second calls the third, which loops; a fourth calls itself.
_CHAIN = [
    ("a", "def a(xs):\n    for x in xs:\n        b(xs)\n", "O(n)", "O(n^2)", "none"), ("b", "def b(xs):\n    return c(xs)\n", "O(1)", "O(n)", "none"),
    ("c", "def c(xs):\n    for x in xs:\n        pass\n", "O(n)", "O(n)", "none"), ("fib", "def fib(n):\n    return fib(n - 1) + fib(n - 2)\n", "O(1)", "O(2^n)", "direct_recursion"),
]


@query(
    "complexity_chain",
    "SELECT p_partkey || ':' || name AS symbol_id, local, propagated_time, recursion_kind FROM part, (VALUES "
    + ", ".join(f"('{n}', '{a}', '{b}', '{k}')" for n, _, a, b, k in _CHAIN)
    + ") t(name, local, propagated_time, recursion_kind)",
)
def complexity_chain(spark, d):
    """One small workspace a part, propagated bottom-up over its calls."""
    key = F.col("p_partkey").cast("string")
    parts = table(spark, d, "part")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t, *_ in _CHAIN]))
    symbols = parts.select(key.alias("g"), rows.alias("s")).select(
        "g", F.concat("g", F.lit(":"), "s.n").alias("id"), F.lit("function").alias("kind"), F.col("s.n").alias("name"), F.col("s.n").alias("qualified_name"), F.lit("m").alias("module"),
        F.lit("m.py").alias("file_path"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"), F.col("s.t").alias("body_excerpt"),
    )
    calls = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ("ab", "bc")] + [F.struct(F.lit("fib").alias("a"), F.lit("fib").alias("b"))]))
    meta = F.lit(None).cast("struct<dst_missing:boolean,ambiguous:boolean,loop_depth:int>").alias("meta")
    edges = parts.select(key.alias("g"), calls.alias("e")).select("g", F.concat("g", F.lit(":"), "e.a").alias("src_id"), F.concat("g", F.lit(":"), "e.b").alias("dst_id"), F.lit("calls").alias("kind"), meta)
    out = analysis.workspace_complexity(symbols, edges, "g")
    return out.select("symbol_id", F.col("local_time").alias("local"), "propagated_time", "recursion_kind")
