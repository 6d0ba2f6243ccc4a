"""Generation-stamped snapshots: Parquet tables per generation and one atomically replaced pointer.

A publish writes all tables of generation N+1 beside those of N, then renames a pointer file over the old one; readers
resolve the pointer once and so see exactly one generation. A crash before the rename leaves N. Tables that a batch does
not touch are referenced, not copied. The pointer goes through the Hadoop file system API, so any store will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEYS, PUBLISH_REASONS, TABLES


@dataclass
class Batch:
    """Upserts (frames of a table's schema) and deletes (frames of its key) by table, and what to record."""

    upserts: dict[str, DataFrame] = field(default_factory=dict)
    deletes: dict[str, DataFrame] = field(default_factory=dict)
    reason: str = "incremental"
    fingerprint: str | None = None
    dim: int | None = None


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Old rows whose key is not in ``new``, and ``new`` (one row a key)."""
    new = new.dropDuplicates(list(keys))
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_symbols(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove symbols ``gone(id)`` with their vectors, attributes, queue rows and outbound edges; flag inbound edges."""
    ids = gone.select("id").distinct()
    out = dict(tables)
    out["symbol"] = tables["symbol"].join(ids, "id", "left_anti")
    for name in ("symbol_vec", "symbol_attribute", "embedding_queue"):
        if name in tables:
            out[name] = tables[name].join(ids, tables[name]["symbol_id"] == ids["id"], "left_anti")
    out["edge"] = flag_missing(tables["edge"].join(ids, tables["edge"]["src_id"] == ids["id"], "left_anti"), ids)
    return out


def flag_missing(edges: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    meta = F.struct(
        F.coalesce(F.col("_gone").isNotNull() | F.col("meta.dst_missing"), F.col("_gone").isNotNull()).alias("dst_missing"),
        F.coalesce("meta.ambiguous", F.lit(False)).alias("ambiguous"),
        F.col("meta.loop_depth").alias("loop_depth"),
    )
    return edges.join(ids, edges["dst_id"] == F.col("_gone"), "left").withColumn("meta", meta).select(*edges.columns)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- pointer

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        fs, path = self._fs(), self._path("CURRENT")
        if not fs.exists(path):
            return {"generation": 0, "semantic_generation": 0, "fingerprint": None, "dim": None, "tables": {}, "log": []}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, state: dict) -> None:
        fs, temp, path = self._fs(), self._path(f".CURRENT-{uuid.uuid4().hex}"), self._path("CURRENT")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(context.makeQualified(temp), context.makeQualified(path), options)

    # -- reads

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.pointer())

    # -- writes

    def publish(self, batch: Batch) -> dict:
        """Apply a batch as the next generation; an empty batch advances it too. Returns the receipt."""
        if batch.reason not in PUBLISH_REASONS:
            raise ValueError(f"INVALID_ARGUMENT: reason {batch.reason!r}")
        state = self.pointer()
        now = Snapshot(self.spark, state)
        tables = {name: now.table(name) for name in TABLES}
        changes = classify_files(tables["file"], batch.upserts.get("file"), batch.deletes.get("file"))
        touched: set[str] = set()
        if "symbol" in batch.deletes:
            tables = delete_symbols(tables, batch.deletes["symbol"])
            touched |= {"symbol", "edge", "symbol_vec", "symbol_attribute", "embedding_queue"}
        for name in TABLES:
            if name != "symbol" and name in batch.deletes:
                tables[name] = tables[name].join(batch.deletes[name].select(*KEYS[name]).distinct(), list(KEYS[name]), "left_anti")
                touched.add(name)
        switch = batch.fingerprint is not None and batch.fingerprint != state["fingerprint"]
        if "symbol_vec" in batch.upserts or switch or (batch.dim and batch.dim != state["dim"]):
            tables["symbol_vec"] = self._vectors(tables, batch, state)
            touched.add("symbol_vec")
        for name in TABLES:
            if name != "symbol_vec" and name in batch.upserts:
                tables[name] = upsert(tables[name], batch.upserts[name], KEYS[name])
                touched.add(name)
        generation = state["generation"] + 1
        paths = dict(state["tables"])
        for name in sorted(touched):
            paths[name] = f"{self.root}/gen={generation}-{uuid.uuid4().hex[:8]}/{name}"
            tables[name].write.parquet(paths[name])
        queue_empty = not paths.get("embedding_queue") or self.spark.read.parquet(paths["embedding_queue"]).isEmpty()
        receipt = {"generation": generation, "reason": batch.reason, "files": changes}
        self._swap(
            state
            | {"generation": generation, "tables": paths, "semantic_generation": generation if queue_empty else state["semantic_generation"],
               "fingerprint": batch.fingerprint or state["fingerprint"], "dim": batch.dim or state["dim"], "log": [*state["log"][-999:], receipt]}
        )
        return receipt

    def _vectors(self, tables: dict[str, DataFrame], batch: Batch, state: dict) -> DataFrame:
        """Vectors after a batch: a first write needs a fingerprint, another space drops all old rows, dimensions must fit."""
        new = batch.upserts.get("symbol_vec")
        fingerprint, dim = batch.fingerprint or state["fingerprint"], batch.dim or state["dim"]
        if new is not None and not fingerprint:
            raise ValueError("INVALID_ARGUMENT: the first vectors need a fingerprint")
        old = tables["symbol_vec"]
        if (batch.fingerprint and batch.fingerprint != state["fingerprint"]) or (batch.dim and batch.dim != state["dim"]):
            old = old.limit(0)
        if new is None:
            return old
        if dim and not new.where(F.size("embedding") != dim).isEmpty():
            raise ValueError("INVALID_ARGUMENT: vector dimension")
        known = new.join(tables["symbol"].select(F.col("id").alias("symbol_id")).unionByName(_ids(batch)), "symbol_id", "left_semi")
        return upsert(old, known, KEYS["symbol_vec"])


def _ids(batch: Batch) -> DataFrame:
    rows = batch.upserts.get("symbol")
    frame = rows if rows is not None else next(iter(batch.upserts.values())).sparkSession.createDataFrame([], "id string")
    return frame.select(F.col("id").alias("symbol_id"))


def classify_files(old: DataFrame, upserts: DataFrame | None, deletes: DataFrame | None) -> dict[str, int]:
    """Counts of removed, changed and added paths, judged before anything is applied."""
    if upserts is None and deletes is None:
        return {}
    rows = file_changes(old.select("path"), upserts, deletes)
    return {r["change"]: r["n"] for r in rows.groupBy("change").agg(F.count("*").alias("n")).collect()}  # at most three rows


def file_changes(old: DataFrame, upserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
    """``path, change``: removed if deleted, changed if it existed, else added."""
    spark = old.sparkSession
    empty = spark.createDataFrame([], "path string")
    gone = (deletes if deletes is not None else empty).select("path").distinct().withColumn("gone", F.lit(True))
    seen = (upserts if upserts is not None else empty).select("path").distinct().withColumn("fresh", F.lit(True))
    both = gone.join(seen, "path", "full").join(old.select("path").distinct().withColumn("was", F.lit(True)), "path", "left")
    return both.select("path", F.when(F.col("gone"), "removed").when(F.col("was"), "changed").otherwise("added").alias("change"))


class Snapshot:
    """Tables of the one generation that the pointer named when this was made."""

    def __init__(self, spark: SparkSession, state: dict):
        self.spark, self.state = spark, state

    @property
    def generation(self) -> int:
        return self.state["generation"]

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"INVALID_ARGUMENT: table {name!r}")
        path = self.state["tables"].get(name)
        reader = self.spark.read.schema(TABLES[name])
        return reader.parquet(path) if path else self.spark.createDataFrame([], TABLES[name])

    def missing(self) -> list[str]:
        """Tables that queries need and this generation lacks, in declared order."""
        return [name for name in ("symbol", "edge", "file") if name not in self.state["tables"]]

    def freshness(self) -> dict:
        s = self.state
        return {"source_generation": s["generation"], "semantic_generation": s["semantic_generation"], "semantic_stale": s["semantic_generation"] < s["generation"], "fingerprint": s["fingerprint"]}


DIGESTED = {
    "symbols": ("symbol", ["id", "kind", "name", "qualified_name", "language", "module", "file_path", "line_start", "line_end", "content_hash"]),
    "edges": ("edge", ["src_id", "dst_id", "kind", "confidence"]),
    "vector_ids": ("symbol_vec", ["symbol_id"]),
    "files": ("file", ["path", "language", "size_bytes", "content_hash", "parse_status"]),
}


def row_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """``row_hash`` of each row: length-prefixed values in column order; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return df.select("*", F.sha2(F.concat_ws("|", *parts), 256).alias("row_hash"))


def fold_digest(hashes: DataFrame, widths: tuple[int, ...] = (8, 6, 4, 2)) -> str:
    """One digest of a set of row hashes, folded level by level: per hash prefix a digest of its sorted rows, then one over
    the prefixes of each shorter prefix, at last one over at most 256.

    A prefix of 8 digits holds a few rows at 10^10 and later levels 256 entries at most, so no array grows with the set.
    """
    rows = F.sha2(F.array_join(F.array_sort(F.collect_list("row_hash")), ""), 256).alias("h")
    part = hashes.groupBy(F.substring("row_hash", 1, widths[0]).alias("p")).agg(rows)
    over = F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])), 256)
    for width in widths[1:]:
        part = part.groupBy(F.substring("p", 1, width).alias("up")).agg(over.alias("h")).withColumnRenamed("up", "p")
    return part.agg(over.alias("d")).first()["d"]


def digest(snapshot: Snapshot) -> dict[str, str]:
    """Digest per category and combined; timestamps, generations and vector payloads do not count."""
    import hashlib

    out = {k: fold_digest(row_digest(snapshot.table(t), cols).select("row_hash")) or "" for k, (t, cols) in DIGESTED.items()}
    return out | {"combined": hashlib.sha256("".join(f"{len(v)}:{v}" for v in out.values()).encode()).hexdigest()}


def digest_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, side``: ids only on one side, or on both with other contents."""
    a = row_digest(left, columns).select(key, F.col("row_hash").alias("a"))
    b = row_digest(right, columns).select(key, F.col("row_hash").alias("b"))
    side = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").when(F.col("a") != F.col("b"), "differs")
    return a.join(b, key, "full").select(key, side.alias("side")).where("side IS NOT NULL")
