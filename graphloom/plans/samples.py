"""Small symbol tables for queries whose inputs the test tables do not hold (source code)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYMBOL_COLUMNS = ("id", "kind", "name", "language", "module", "file_path", "signature", "body_excerpt")
SYMBOLS: list[tuple] = [
    ("s01", "function", "login", "python", "app/auth", "app/auth.py", "def login(u)", "def login(u):\n    return verify(u) and audit(u)"),
    ("s02", "function", "verify", "python", "app/auth", "app/auth.py", "def verify(u)", "def verify(u):\n    return hash_pw(u)"),
    ("s03", "function", "audit", "python", "app/log", "app/log.py", "def audit(u)", "def audit(u):\n    db.execute('INSERT INTO audit_log VALUES (1)')"),
    ("s04", "function", "hash_pw", "python", "app/util", "app/util.py", "def hash_pw(x)", "def hash_pw(x):\n    if (x): return hash_pw(x)\n    return 1"),
    ("s05", "function", "load", "typescript", "web/load", "web/load.ts", "function load()", 'function load() { return fetch("/api/users") + cfg("server.port") }'),
    ("s06", "function", "handler", "typescript", "web/h", "web/h.ts", "function handler()", "function handler() { app.get('/api/users'); load(); }"),
    ("s07", "route", "/api/users", "html", "web/index", "web/index.html", None, "/api/users"),
    ("s08", "var", "server.port", "yaml", "conf", "conf.yaml", None, "server.port 80"),
    ("s09", "var", "limits[0].port", "yaml", "conf", "conf.yaml", None, "limits[0].port 1"),
    ("s10", "class", "audit_log", "sql", "db/schema", "db/schema.sql", "table audit_log (id, userName)", "table audit_log (id, userName)"),
    ("s11", "var", "userName", "sql", "db/schema", "db/schema.sql", None, "audit_log.userName text"),
    ("s12", "method", "report", "python", "app/log", "app/log.py", "def report(self)", "def report(self):\n    rows = db.query('SELECT user_name FROM audit_log')\n    return audit(rows)"),
    ("s13", "class", "Base", "java", "J", "src/Base.java", "class Base", "class Base { }"),
    ("s14", "interface", "Shape", "java", "J", "src/Shape.java", "interface Shape", "interface Shape { }"),
    ("s15", "class", "Circle", "java", "J", "src/Circle.java", "class Circle", "class Circle<T extends Num> extends Base implements Shape, Other { }"),
    ("s16", "class", "Repo", "csharp", "C", "src/Repo.cs", "class Repo", "class Repo : Base, IStore<int> where T : new() { }"),
    ("s17", "interface", "IStore", "csharp", "C", "src/IStore.cs", "interface IStore", "interface IStore { }"),
    ("s18", "class", "Base", "csharp", "C", "src/Base.cs", "class Base", "class Base { }"),
    ("s19", "module", "readme", "markdown", "readme", "readme.md", None, "see '/api/users'"),
    ("s20", "function", "port", "go", "g", "g.go", "func port() int", 'func port() int { return read("port") }'),
    *[(f"t{k:02d}", "function", "run", "python", f"jobs/j{k}", f"jobs/j{k}.py", "def run()", "def run():\n    start()") for k in range(10)],
    ("u01", "function", "start", "python", "jobs/j0", "jobs/j0.py", "def start()", "def start():\n    run()"),
    ("u02", "function", "boot", "python", "jobs/boot", "jobs/boot.py", "def boot()", "def boot():\n    run()\n    start()"),
]
CLASSES: list[tuple] = [
    ("constant", 0, 0, 0, 0), ("logarithmic", 0, 0, 1, 0), ("logarithmic", 0, 0, 2, 0), ("sqrt", 0, 0, 0, 0), ("polynomial", 1, 0, 0, 0), ("polynomial", 1, 1, 0, 0),
    ("polynomial", 1, 2, 0, 0), ("polynomial", 2, 0, 0, 0), ("polynomial", 3, 1, 0, 0), ("polynomial", 4, 2, 0, 0), ("exponential", 0, 0, 0, 2), ("exponential", 0, 0, 0, 3),
    ("factorial", 0, 0, 0, 0),
]
SNIPPETS: list[tuple] = [
    (1, "os.environ['HOME'] and os.getenv('A_B', 1)"), (2, "cur.execute('select * from users join Orders on 1=1 where x')"), (3, "app.get('/x/y'); requests.POST('http://z')"),
    (4, "process.env.TOKEN + process.env['K2'] + os.Getenv(\"GO\")"), (5, "await fetch(url); axios.Create({}); http.Get(u)"), (6, "UPDATE SET x"), (7, ""), (8, "nothing here"),
]
SOURCES: list[tuple] = [
    (1, "for x in a:\n  for y in b:\n    a.find(y)\nwhile True:\n  pass"), (2, "x = 1\nreturn xs.includes(y)"), (3, "while(a) {\n a.indexOf(b)\n}"), (4, ""), (5, "  for(i) xs.find(i)\nforeach"),
]


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOLS, ", ".join(f"{c} string" for c in SYMBOL_COLUMNS))


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *c) for k, c in enumerate(CLASSES)], "cid int, kind string, degree int, log_power int, power int, base int")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'" if "\n" not in value else " || chr(10) || ".join("'" + v.replace("'", "''") + "'" for v in value.split("\n"))
    return str(value)


def values(rows: list[tuple], name: str, columns: tuple[str, ...]) -> str:
    """A SQL common table expression with these rows."""
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(literal(v) for v in r) + ')' for r in rows)})"
