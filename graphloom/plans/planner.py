"""Change planning: hash diff of a tree against the file cache, dependents, and the batch to publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import attributes, redact, taint_flags
from ..operators.resolve import resolve_edges, to_edges
from ..schema import BACKOFF_MS, DRAIN_BUDGET, PENDING_FILES
from ..sources.extract import extract_symbols
from ..sources.store import Batch, Snapshot


def plan_changes(tree: DataFrame, cache: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``path, action``: index, delete or keep.

    ``tree(path, content_hash, blank)`` against ``cache(path, content_hash, parse_status, has_symbols)``. A file is kept
    if its byte hash stands, it parsed, and it has symbols or is blank; a cached path not in the tree goes. With
    ``touched(path)`` only those paths are judged.
    """
    a = tree.select("path", F.col("content_hash").alias("new_hash"), "blank")
    b = cache.select("path", F.col("content_hash").alias("old_hash"), "parse_status", "has_symbols")
    if touched is not None:
        a, b = (x.join(touched.select("path").distinct(), "path", "left_semi") for x in (a, b))
    same = (F.col("new_hash") == F.col("old_hash")) & (F.col("parse_status") == "ok") & (F.col("has_symbols") | F.col("blank"))
    action = F.when(F.col("new_hash").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "keep").otherwise("index")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def edge_dependents(edges: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of sources of edges into any changed symbol ``changed(id)``."""
    into = edges.join(changed.select(F.col("id").alias("dst_id")).distinct(), "dst_id", "left_semi").select(F.col("src_id").alias("id")).distinct()
    return symbols.join(into, "id", "left_semi").select(F.col("file_path").alias("path")).distinct()


def reference_dependents(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Files of symbols whose text names one of ``names(name)`` as a word."""
    words = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "signature", "body_excerpt"), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    used = symbols.select("file_path", F.explode(words).alias("name"))
    return used.join(names.select("name").distinct(), "name", "left_semi").select(F.col("file_path").alias("path")).distinct()


def enrich(rows: DataFrame) -> DataFrame:
    """Symbols with secrets redacted in body, signature and docstring, taint flags, and bookkeeping columns."""
    flags = taint_flags(F.col("body_excerpt"), F.col("signature"), F.col("docstring"))
    out = rows.withColumn("untrusted_flags", flags)
    for c in ("body_excerpt", "signature", "docstring"):
        out = out.withColumn(c, redact(F.col(c)))
    return out.select(
        "id", "kind", "name", "qualified_name", "language", "module", "file_path", "line_start", "line_end", "signature", "docstring", "content_hash", "body_excerpt",
        F.lit(None).cast("string").alias("semantic_summary"), F.lit(0.0).alias("risk_score"), F.lit(False).alias("ambiguous"), "untrusted_flags", F.lit(0).cast("bigint").alias("updated_at"),
    )


def symbol_attributes(rows: DataFrame) -> DataFrame:
    """``symbol_id, key, value`` from bodies before redaction."""
    return rows.select(F.col("id").alias("symbol_id"), F.explode(attributes(F.col("body_excerpt"))).alias("a")).select("symbol_id", "a.key", "a.value")


def build_batch(snapshot: Snapshot, files: DataFrame, reason: str = "reconcile", touched: DataFrame | None = None) -> tuple[Batch, DataFrame]:
    """Batch that turns a snapshot into the state of ``files(path, content, content_hash, size_bytes, language)``.

    Changed files are parsed; their dependents are re-resolved with them, so an incremental batch gives the edges a clean
    rebuild would. Returns the batch and the plan.
    """
    old, edges, cache = snapshot.table("symbol"), snapshot.table("edge"), snapshot.table("file")
    has = old.select(F.col("file_path").alias("path")).distinct().withColumn("has_symbols", F.lit(True))
    known = cache.join(has, "path", "left").withColumn("has_symbols", F.coalesce("has_symbols", F.lit(False)))
    tree = files.withColumn("blank", ~F.col("content").cast("string").rlike(r"\S"))
    plan = plan_changes(tree, known, touched).cache()
    index, gone = plan.where("action = 'index'").select("path"), plan.where("action = 'delete'").select("path")
    parsed = extract_symbols(files.join(index, "path", "left_semi")).cache()
    raw = parsed.where("id IS NOT NULL").dropDuplicates(["id"])
    new = enrich(raw)
    leaving = old.join(index.union(gone).withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    stale = leaving.select("id").join(new.select("id"), "id", "left_anti")
    remaining = old.join(leaving.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)
    resolved = to_edges(resolve_edges(remaining))
    # a clean resolution of what remains; only keys that changed are written
    before = edges.select("src_id", "dst_id", "kind").join(stale.withColumnRenamed("id", "src_id"), "src_id", "left_anti")
    drop = before.join(resolved.select("src_id", "dst_id", "kind"), ["src_id", "dst_id", "kind"], "left_anti")
    state = parsed.where("id IS NULL").select(F.col("file_path").alias("path"), "status")
    rows = files.join(state, "path").select("path", "language", F.col("size_bytes").cast("bigint").alias("size_bytes"), "content_hash", F.lit(0).cast("bigint").alias("parsed_at"), F.col("status").alias("parse_status"))
    upserts = {"symbol": new, "edge": resolved, "file": rows, "symbol_attribute": symbol_attributes(raw)}
    return Batch(upserts, {"symbol": stale, "edge": drop, "file": gone}, reason), plan


# ---- embedding queue


def due(queue: DataFrame, now: int, budget: int = DRAIN_BUDGET) -> DataFrame:
    return queue.where(F.col("next_attempt_at") <= now).orderBy("next_attempt_at", "enqueued_at", "symbol_id").limit(budget)


def backoff_seconds(attempts: Column) -> Column:
    """Delay after a failure: the ladder's rung, the last one repeating; milliseconds rounded up to seconds."""
    ladder = F.array(*[F.lit(-(-ms // 1000)) for ms in BACKOFF_MS])
    return F.element_at(ladder, F.least(F.greatest(attempts, F.lit(1)), F.lit(len(BACKOFF_MS))).cast("int"))


def record_failure(queue: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """Queue with ``failed(symbol_id, error)`` pushed back."""
    f = failed.select("symbol_id", F.col("error").alias("_error"))
    tries = F.col("attempts") + F.when(F.col("_error").isNotNull(), 1).otherwise(0)
    out = queue.join(f, "symbol_id", "left").withColumn("attempts", tries)
    return (
        out.withColumn("next_attempt_at", F.when(F.col("_error").isNotNull(), F.lit(now) + backoff_seconds(F.col("attempts"))).otherwise(F.col("next_attempt_at")).cast("bigint"))
        .withColumn("last_error", F.coalesce("_error", "last_error"))
        .drop("_error")
    )


def pending_files(queue: DataFrame, most: int = PENDING_FILES) -> DataFrame:
    by = queue.groupBy("file_path").agg(F.min("next_attempt_at").alias("next_at"), F.min("enqueued_at").alias("first_at"), F.count("*").alias("n"))
    return by.orderBy("next_at", "first_at", "file_path").limit(most)
