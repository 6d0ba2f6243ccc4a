"""The query surface: twelve read-only tools over one pinned snapshot, with clamps, deadlines and admission."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, task_mode
from ..operators import fusion, graph, impact, lexical, lookup, resolve, semantic
from ..operators.analysis import propagate
from ..schema import ALPHA, EPSILON, SEED_DEPTH, SUBGRAPH_NODES
from ..sources.store import Store

# Error codes that a caller may retry.
RETRYABLE = {"TIMEOUT", "INDEX_NOT_READY"}


class ToolError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message

    def envelope(self) -> dict:
        return {"code": self.code, "message": self.message, "retryable": self.code in RETRYABLE}


def clamp(value: int, low: int, high: int) -> int:
    return min(high, max(low, int(value)))


def clamp_k(k: int) -> int:
    return clamp(k, 1, 50)


def clamp_depth(depth: int) -> int:
    return clamp(depth, 1, 8)


def clamp_tokens(tokens: int) -> int:
    return clamp(tokens, 500, 32_000)


class Deadline:
    """Soft limit: later stages are left out and the result is marked truncated. Hard limit: the call fails."""

    def __init__(self, soft: float = 5.0, hard: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.soft, self.hard, self.clock, self.began, self.truncated = soft, hard, clock, clock(), False

    def open(self) -> bool:
        spent = self.clock() - self.began
        if spent >= self.hard:
            raise ToolError("TIMEOUT", f"over {self.hard:g} s")
        self.truncated |= spent >= self.soft
        return not self.truncated


class Admission:
    """At most ``most`` calls in flight; others are turned away at once."""

    def __init__(self, most: int = 16):
        self.slots = threading.BoundedSemaphore(most)

    def __enter__(self) -> Admission:
        if not self.slots.acquire(blocking=False):
            raise ToolError("TIMEOUT", "too many calls in flight")
        return self

    def __exit__(self, *_) -> None:
        self.slots.release()


def audit_line(tool: str, args: dict, ok: bool, ts: int) -> str:
    """One JSON line with a digest of the canonical arguments."""
    canonical = json.dumps(args, sort_keys=True, separators=(",", ":"))
    return json.dumps({"ts": ts, "tool": tool, "args_hash": hashlib.sha256(canonical.encode()).hexdigest(), "ok": ok}, separators=(",", ":"))


class AuditLog:
    """Appends one line a call to a file; a log that cannot be written never fails the call."""

    def __init__(self, path: str, clock: Callable[[], float] = time.time):
        self.path, self.clock = path, clock

    def record(self, tool: str, args: dict, ok: bool) -> None:
        try:
            with open(self.path, "a", encoding="utf-8") as out:
                out.write(audit_line(tool, args, ok, int(self.clock())) + "\n")
        except (OSError, TypeError, ValueError):
            pass


class Resident:
    """The symmetric graph of one generation, kept until another generation is asked for. Engines may share one."""

    def __init__(self):
        self.lock, self.key, self.arcs = threading.Lock(), None, None

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        with self.lock:
            if key != self.key:
                if self.arcs is not None:
                    self.arcs.unpersist()
                self.key, self.arcs = key, make().persist(StorageLevel.MEMORY_AND_DISK)
            return self.arcs


@dataclass
class Result:
    rows: DataFrame | None
    value: dict = field(default_factory=dict)
    truncated: bool = False
    freshness: dict = field(default_factory=dict)


class Engine:
    """Tools over the generation that was current when the engine was made."""

    def __init__(self, spark: SparkSession, store: Store, embedder: semantic.Embedder | None = None, fingerprint: str | None = None, soft: float = 5.0, hard: float = 10.0, admission: Admission | None = None, resident: Resident | None = None, audit: AuditLog | None = None):
        self.resident, self.audit = resident or Resident(), audit
        self.spark, self.snapshot = spark, store.snapshot()
        self.embedder, self.fingerprint = embedder, fingerprint
        self.limits, self.admission = (soft, hard), admission or Admission()
        lacking = self.snapshot.missing()
        if lacking:
            raise ToolError("INDEX_NOT_READY", f"missing {', '.join(lacking)}")
        self.symbols, self.edges = self.snapshot.table("symbol"), self.snapshot.table("edge")

    def _result(self, rows: DataFrame | None, deadline: Deadline, **value) -> Result:
        return Result(rows, value, deadline.truncated, self.snapshot.freshness())

    def _deadline(self) -> Deadline:
        return Deadline(*self.limits)

    # -- layers

    def lexical(self, text: str, k: int) -> DataFrame:
        fields = F.concat_ws(" ", "name", "qualified_name", "signature", "docstring", "body_excerpt")
        found = lexical.bm25(self.symbols.select("id", fields.alias("text")), "id", "text", text.strip(), k)
        return found.select(F.col("id").alias("symbol_id"), "score", F.lit("lexical").alias("layer"))

    def semantic(self, text: str, k: int) -> DataFrame:
        """KNN behind the vector-space guard; without an embedder or on another space the layer is empty."""
        empty = self.spark.createDataFrame([], fusion.HIT)
        if self.embedder is None or not text.strip() or not semantic.guard(self.snapshot.state["fingerprint"], self.fingerprint):
            return empty
        query = self.embedder.embed_batch([text])[0].tolist()
        found = semantic.knn(self.snapshot.table("symbol_vec"), query, k)
        return found.select(F.col("id").alias("symbol_id"), "score", F.lit("semantic").alias("layer"))

    def _hydrate(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.symbols.withColumnRenamed("id", "symbol_id").select("symbol_id", "kind", "name", "qualified_name", "file_path", "line_start", "untrusted_flags"), "symbol_id")

    def _diffuse(self, hits: DataFrame, k: int, alpha: float, eps: float) -> DataFrame:
        state = self.snapshot.state
        key = (self.spark.sparkContext.applicationId, state["generation"], state["tables"]["symbol"], state["tables"]["edge"])
        arcs = self.resident.get(key, lambda: graph.symmetric(self.edges, self.symbols.select("id")))
        seeds = fusion.seed_distribution(hits, self.symbols.select("id"))
        return graph.diffuse(arcs, seeds.select(F.col("symbol_id").alias("id"), "mass"), k, alpha, eps)

    def call(self, tool: str, **args) -> Result:
        """A tool by name, with a line in the audit log whether it succeeds or fails."""
        if tool not in TOOLS:
            raise ToolError("INVALID_ARGUMENT", f"tool {tool!r}")
        ok = False
        try:
            out = getattr(self, tool)(**args)
            ok = True
            return out
        finally:
            if self.audit:
                self.audit.record(tool, args, ok)

    # -- tools

    def symbol_search(self, query: str, k: int = 8) -> Result:
        with self.admission:
            t = self._deadline()
            return self._result(self._hydrate(self.lexical(query, clamp_k(k))).orderBy(F.desc("score"), "symbol_id"), t)

    def semantic_search(self, query: str, k: int = 10) -> Result:
        with self.admission:
            t = self._deadline()
            return self._result(self._hydrate(self.semantic(query, clamp_k(k))).orderBy(F.desc("score"), "symbol_id"), t)

    def discover_symbols(self, query: str, k: int = 10) -> Result:
        with self.admission:
            t, k = self._deadline(), clamp_k(k)
            hits = self.lexical(query, k).unionByName(self.semantic(query, k))
            sources = hits.groupBy("symbol_id").agg(F.array_sort(F.collect_set("layer")).alias("match_sources"))
            fused = fusion.rrf_fuse(hits, k, layer_order=["lexical", "semantic"]).join(sources, "symbol_id")
            return self._result(self._hydrate(fused).orderBy("rank"), t)

    def diffuse_context(self, query: str, k: int = 10, alpha: float = ALPHA, eps: float = EPSILON) -> Result:
        with self.admission:
            t = self._deadline()
            hits = self.lexical(query, SEED_DEPTH).unionByName(self.semantic(query, SEED_DEPTH))
            if not t.open():
                return self._result(None, t)
            return self._result(self._hydrate(self._diffuse(hits, clamp_k(k), alpha, eps)).orderBy(F.desc("score"), "symbol_id"), t)

    def symbol_lookup(self, name_or_id: str, kind: str | None = None) -> Result:
        with self.admission:
            t = self._deadline()
            row = lookup.resolve_symbol(self.symbols, name_or_id, kind)
            if row.isEmpty():
                raise ToolError("SYMBOL_NOT_FOUND", name_or_id)
            return self._result(row, t)

    def dependency_trace(self, symbol_id: str, direction: str = "out", depth: int = 3) -> Result:
        if direction not in ("in", "out", "both"):
            raise ToolError("INVALID_ARGUMENT", f"direction {direction!r}")
        with self.admission:
            t = self._deadline()
            hops = graph.trace(self.edges, symbol_id, direction, clamp_depth(depth))
            known = self.symbols.select(F.col("id").alias("symbol_id"), "name", "file_path")
            return self._result(hops.join(known, "symbol_id", "left").orderBy("hop", "symbol_id"), t)

    def resolve_symbols(self, symbol_ids: list[str]) -> Result:
        with self.admission:
            t = self._deadline()
            try:
                known, missing = lookup.resolve_symbols(symbol_ids, self.symbols)
            except ValueError as e:
                raise ToolError("INVALID_ARGUMENT", str(e)) from e
            return self._result(known, t, missing=missing, requested_count=len(symbol_ids), resolved_count=len(symbol_ids) - len(missing))

    def retrieve_context_capsule(self, task: str, max_tokens: int = 8000) -> Result:
        with self.admission:
            t, budget = self._deadline(), clamp_tokens(max_tokens)
            rows = max(1, budget // 50)
            direct = self.lexical(task, SEED_DEPTH).unionByName(self.semantic(task, SEED_DEPTH))
            prefix = graph.row_positions(fusion.rrf_fuse(direct, rows, layer_order=["lexical", "semantic"]), ["rank"])
            spread = self._diffuse(direct, rows, ALPHA, EPSILON) if t.open() else self.spark.createDataFrame([], "symbol_id string, score double")
            ranked = graph.row_positions(spread, [F.desc("score"), "symbol_id"])
            parts = self._hydrate(fusion.compose(prefix.select("symbol_id", "pos"), ranked.select("symbol_id", "pos"), rows))
            text = F.concat_ws("\n", "qualified_name", "file_path")
            costed = parts.withColumn("cost", estimate_tokens(text)).withColumn("one", F.lit(0))
            fits = fusion.budget_running(costed, "cost", budget, "one", ["position"]).drop("one")
            mode = self.spark.createDataFrame([(task,)], "t string").select(task_mode(F.col("t"))).first()[0]
            empty = fits.isEmpty()
            return self._result(fits.orderBy("position"), t, task_mode=mode, confidence=0.0 if empty else 0.75, untrusted=[])

    # -- tools over a bounded subgraph

    def _subgraph(self, files: list[str], names: list[str], query: str | None) -> tuple[list[dict], list[dict]]:
        """At most 96 symbols around the files, names or query (or the first symbols), and the edges among them."""
        seeds = self.symbols.where(F.col("file_path").isin(*files)).select("id") if files else self.spark.createDataFrame([], "id string")
        for n in names:
            seeds = seeds.union(lookup.resolve_symbol(self.symbols, n).select("id"))
        if query:
            seeds = seeds.union(self.lexical(query, 10).select("symbol_id"))
        few = self.symbols.select("id").orderBy("id").limit(SUBGRAPH_NODES + 1)
        if seeds.isEmpty() or few.count() <= SUBGRAPH_NODES:
            seeds = seeds.union(few.limit(SUBGRAPH_NODES))
        ids = graph.analysis_subgraph(self.edges, seeds, SUBGRAPH_NODES).select("id")
        rows = self.symbols.join(F.broadcast(ids), "id", "left_semi").orderBy("id")  # at most 96 ids
        inside = self.edges.join(F.broadcast(ids.withColumnRenamed("id", "src_id")), "src_id", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "dst_id")), "dst_id", "left_semi")
        flat = inside.select("src_id", "dst_id", "kind", "confidence", "meta.dst_missing", "meta.loop_depth").orderBy("src_id", "dst_id", "kind")
        return [r.asDict() for r in rows.collect()], [r.asDict() for r in flat.collect()]

    def _resolve_local(self, symbols: list[dict]) -> list[dict]:
        frame = self.spark.createDataFrame([tuple(s.get(c) for c in _RESOLVE) for s in symbols], ", ".join(f"{c} string" for c in _RESOLVE))
        return [r.asDict() for r in resolve.resolve_edges(frame).collect()]  # edges among a few hundred symbols

    def analyze_patch_impact(self, file_edits: dict[str, str] | None = None, targets: list[str] | None = None, query: str | None = None) -> Result:
        with self.admission:
            t = self._deadline()
            symbols, edges = self._subgraph(list(file_edits or {}), targets or [], query)
            out = impact.shadow_patch(symbols, edges, file_edits or {}, targets or [], self._resolve_local)
            return self._result(None, t, **out)

    def inspect_symbol_complexity(self, name_or_id: str | None = None, k: int = 10) -> Result:
        with self.admission:
            t = self._deadline()
            symbols, edges = self._subgraph([], [name_or_id] if name_or_id else [], None)
            reports = list(propagate(symbols, edges)[0].values())
            n = name_or_id or ""
            picked = [x for x in reports if n and (n in (x.symbol_id, x.qualified_name, x.file_path) or x.qualified_name.endswith(f".{n}") or n in x.qualified_name)] or reports
            picked.sort(key=lambda x: (-x.effective_degree, -x.risk_score, x.symbol_id))
            return self._result(None, t, reports=[x.row() for x in picked[: clamp_k(k)]])

    def trace_blast_radius(self, symbol_id: str, signature_changed: bool = False, new_complexity: str | None = None) -> Result:
        from ..functions.algebra import parse_notation

        with self.admission:
            t = self._deadline()
            symbols, edges = self._subgraph([], [symbol_id], None)
            reports, depths = propagate(symbols, edges)
            at = next((s["id"] for s in symbols if symbol_id in (s["id"], s["qualified_name"], s["name"])), None)
            if at is None:
                raise ToolError("SYMBOL_NOT_FOUND", symbol_id)
            old = parse_notation(reports[at].propagated_time)
            seed = impact.Seed(at, 0.85 if signature_changed else 0.0, None, old, parse_notation(new_complexity) if new_complexity else old)
            return self._result(None, t, **impact.evaluate(symbols, edges, [seed], depths))

    def suggest_optimal_refactor(self, target: str | None = None, file_path: str | None = None, code_snippet: str | None = None) -> Result:
        edits = {file_path: code_snippet} if file_path and code_snippet else {}
        found = self.analyze_patch_impact(edits, [target] if target else [])
        return Result(None, {"verdict": found.value["verdict"], "advisories": found.value["advisories"]}, found.truncated, found.freshness)

    def live_resource(self) -> Result:
        return self.analyze_patch_impact()


# The tools that can be called by name.
TOOLS = (
    "symbol_search", "semantic_search", "discover_symbols", "diffuse_context", "symbol_lookup", "dependency_trace", "resolve_symbols", "retrieve_context_capsule",
    "analyze_patch_impact", "inspect_symbol_complexity", "trace_blast_radius", "suggest_optimal_refactor",
)
_RESOLVE = ("id", "kind", "name", "language", "module", "file_path", "signature", "body_excerpt")
