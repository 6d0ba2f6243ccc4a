"""Edge resolution: five resolvers as equi-joins, their merge, and persisted edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ident, string_literals
from ..schema import AMBIGUOUS_BELOW, ARTIFACT_LANGUAGES, CALLABLE_KINDS, FAN_OUT, STOP_CALLS

# Confidences.
SAME_FILE, CROSS_FILE, OOP_UNIQUE, OOP_AMBIGUOUS, ROUTES, CONFIG, SQL = 1.0, 0.6, 0.9, 0.5, 1.0, 0.7, 0.65
RESOLVED = ("src_id", "dst_id", "kind", "confidence")


def _text(a: str = "signature", b: str = "body_excerpt") -> Column:
    return F.concat_ws(" ", a, b)


def _is_artifact() -> Column:
    return F.col("language").isin(*ARTIFACT_LANGUAGES)


def integration_candidates(symbols: DataFrame) -> DataFrame:
    """Symbols that integration joins see: all but modules of markdown files."""
    return symbols.where(~((F.col("kind") == "module") & (F.col("language") == "markdown")))


def _best(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src_id", "dst_id", "kind").agg(F.max("confidence").alias("confidence"))


def resolve_calls(symbols: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Call sites matched by name: sure in the same file; in other files of the language only up to ``fan_out`` targets.

    The guard counts candidates before it keeps any, so a name that many symbols carry costs one window over the
    caller's own candidates and never fans out.
    """
    body = F.coalesce(F.col("body_excerpt"), F.col("signature"), F.lit(""))
    names = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))
    sites = symbols.where(F.col("kind").isin(*CALLABLE_KINDS)).select(
        F.col("id").alias("src_id"), F.col("file_path").alias("src_file"), F.col("language").alias("src_lang"), F.explode(F.array_except(names, F.array(*[F.lit(w) for w in STOP_CALLS]))).alias("name")
    )
    targets = symbols.where(F.col("kind").isin(*CALLABLE_KINDS, "class")).select(F.col("id").alias("dst_id"), F.col("name").alias("t_name"), F.col("file_path").alias("dst_file"), F.col("language").alias("dst_lang"))
    called = (F.col("name") == F.col("t_name")) & (F.col("src_lang") == F.col("dst_lang"))
    same = sites.join(targets, called & (F.col("src_file") == F.col("dst_file"))).where("src_id <> dst_id")
    same = same.select("src_id", "dst_id", F.lit("calls").alias("kind"), F.lit(SAME_FILE).alias("confidence"))
    # per name and language, how many targets there are in all and in the caller's file: their difference is guarded
    everywhere = targets.groupBy(F.col("t_name").alias("name"), F.col("dst_lang").alias("src_lang")).agg(F.count("*").alias("n_all"))
    here = targets.groupBy(F.col("t_name").alias("name"), F.col("dst_lang").alias("src_lang"), F.col("dst_file").alias("src_file")).agg(F.count("*").alias("n_here"))
    few = sites.join(everywhere, ["name", "src_lang"]).join(here, ["name", "src_lang", "src_file"], "left")
    few = few.where(F.col("n_all") - F.coalesce("n_here", F.lit(0)) <= fan_out)
    cross = few.join(targets, called & (F.col("src_file") != F.col("dst_file")))
    cross = cross.select("src_id", "dst_id", F.lit("calls").alias("kind"), F.lit(CROSS_FILE).alias("confidence"))
    return _best(same.unionByName(cross))


def _strip_groups(text: Column, depth: int = 6) -> Column:
    for _ in range(depth):
        text = F.regexp_replace(text, r"<[^<>()]*>|\([^<>()]*\)", " ")
    return text


def resolve_oop(symbols: DataFrame) -> DataFrame:
    """Base types named in C# and Java headers; a unique target is surer than an ambiguous one."""
    types = symbols.where(F.col("kind").isin("class", "interface"))
    head = _strip_groups(F.regexp_extract(F.coalesce("body_excerpt", "signature", F.lit("")), r"(?s)^([^{]*)", 1))
    extends = F.regexp_extract(head, r"(?s)\bextends\b(.*?)(?:\bimplements\b|$)", 1)
    implements = F.regexp_extract(head, r"(?s)\bimplements\b(.*)$", 1)
    colon = F.regexp_replace(F.regexp_extract(head, r"(?s):(.*)$", 1), r"(?s)\bwhere\b.*$", "")

    def named(part: Column, word: str) -> Column:
        entries = F.transform(F.split(part, ","), lambda e: F.try_element_at(F.regexp_extract_all(e, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.lit(-1)))
        return F.transform(F.filter(entries, lambda e: e.isNotNull()), lambda e: F.struct(e.alias("base"), F.lit(word).alias("word")))

    listed = F.when(F.col("language") == "java", F.concat(named(extends, "extends"), named(implements, "implements"))).otherwise(named(colon, "colon"))
    sites = types.where(F.col("language").isin("csharp", "java")).select(F.col("id").alias("src_id"), F.explode(listed).alias("b")).select("src_id", "b.base", "b.word").distinct()
    targets = types.select(F.col("id").alias("dst_id"), F.col("name").alias("base"), F.col("kind").alias("dst_kind"))
    pairs = sites.join(targets, "base").where("src_id <> dst_id")
    n = F.count("*").over(Window.partitionBy("src_id", "base", "word"))
    kind = F.when(F.col("word") == "extends", "inherits").when(F.col("word") == "implements", "implements").when(F.col("dst_kind") == "interface", "implements").otherwise("inherits")
    return _best(pairs.select("src_id", "dst_id", kind.alias("kind"), F.when(n == 1, OOP_UNIQUE).otherwise(OOP_AMBIGUOUS).alias("confidence")))


def _literals() -> Column:
    return F.array_distinct(F.concat(*[string_literals(F.coalesce(F.col(c), F.lit(""))) for c in ("signature", "body_excerpt")]))


def resolve_routes(symbols: DataFrame) -> DataFrame:
    """Route symbols to the code symbols that declare the same path literal, byte for byte."""
    pool = integration_candidates(symbols)
    handlers = pool.where(~_is_artifact()).select(F.col("id").alias("dst_id"), F.explode(F.filter(_literals(), lambda v: v.startswith("/"))).alias("path"))
    routes = pool.where((F.col("kind") == "route") & (F.trim("name") != "")).select(F.col("id").alias("src_id"), F.col("name").alias("path"))
    return routes.join(handlers, "path").where("src_id <> dst_id").select("src_id", "dst_id", F.lit("routes_to").alias("kind"), F.lit(ROUTES).alias("confidence")).distinct()


def resolve_config(symbols: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Code that quotes a config key's full path or last segment, if at most ``fan_out`` symbols do."""
    pool = integration_candidates(symbols)
    parts = F.filter(F.transform(F.split("name", r"\."), lambda s: F.regexp_replace(s, r"\[.*$", "")), lambda s: F.trim(s) != "")
    full = F.trim(F.array_join(parts, "."))
    last = F.trim(F.try_element_at(F.split(full, r"\."), F.lit(-1)))
    keys = pool.where(F.col("kind").isin("var", "const") & F.col("language").isin("yaml", "toml"))
    keys = keys.select(F.col("id").alias("dst_id"), F.explode(F.filter(F.array_distinct(F.array(full, last)), lambda v: v != "")).alias("lit"))
    readers = pool.where(~_is_artifact()).select(F.col("id").alias("src_id"), F.explode(F.filter(_literals(), lambda v: v != "")).alias("lit"))
    # a literal that more than fan_out readers quote already exceeds the guard for each key that carries it
    over = keys.join(readers.groupBy("lit").agg(F.count_distinct("src_id").alias("n")).where(F.col("n") > fan_out + 1), "lit").select("dst_id").distinct()
    hits = keys.join(over, "dst_id", "left_anti").join(readers, "lit").where("src_id <> dst_id").select("src_id", "dst_id").distinct()
    n = F.count("*").over(Window.partitionBy("dst_id"))
    return hits.withColumn("n", n).where(F.col("n") <= fan_out).select("src_id", "dst_id", F.lit("reads").alias("kind"), F.lit(CONFIG).alias("confidence"))


def resolve_sql(symbols: DataFrame) -> DataFrame:
    """Code with SQL verbs to the tables and columns it names; writing wins over reading."""
    pool = integration_candidates(symbols)
    tables = pool.where((F.col("language") == "sql") & F.col("kind").isin("class", "var")).select(F.col("id").alias("dst_id"), normalize_ident(F.col("name")).alias("norm")).where("norm <> ''")
    words = F.regexp_extract_all(_text(), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    verbs = F.transform(words, lambda w: F.upper(w))
    writes = F.exists(verbs, lambda v: v.isin("INSERT", "UPDATE", "DELETE", "UPSERT", "MERGE", "REPLACE"))
    kind = F.when(writes, "writes").when(F.array_contains(verbs, "SELECT"), "reads")
    norms = F.array_distinct(F.transform(F.concat(words, F.array("name")), lambda w: normalize_ident(w)))
    sites = pool.where(~_is_artifact()).select(F.col("id").alias("src_id"), kind.alias("kind"), norms.alias("norms")).where("kind IS NOT NULL")
    sites = sites.select("src_id", "kind", F.explode("norms").alias("norm")).where("norm <> ''")
    return sites.join(tables, "norm").where("src_id <> dst_id").select("src_id", "dst_id", "kind", F.lit(SQL).alias("confidence")).distinct()


def merge_edges(parts: list[DataFrame]) -> DataFrame:
    """Highest confidence per edge key."""
    return _best(reduce(DataFrame.unionByName, [p.select(*RESOLVED) for p in parts]))


def resolve_edges(symbols: DataFrame) -> DataFrame:
    return merge_edges([resolve_calls(symbols), resolve_oop(symbols), resolve_routes(symbols), resolve_config(symbols), resolve_sql(symbols)])


def to_edges(resolved: DataFrame) -> DataFrame:
    """Persisted form: ambiguous iff the confidence is below 0.6."""
    meta = F.struct(F.lit(False).alias("dst_missing"), (F.col("confidence") < AMBIGUOUS_BELOW).alias("ambiguous"), F.lit(None).cast("int").alias("loop_depth"))
    return resolved.select(*RESOLVED, meta.alias("meta"))
