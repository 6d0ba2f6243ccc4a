"""Graph projections, traversal and personalized PageRank over edge tables ``u, v, w``.

Iterations are frontier joins and partially aggregated sums; every few rounds the state is written to the session's
checkpoint folder, so a lost executor costs rounds, not the run.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ALPHA, EPSILON, GAMMA_COMPLEXITY, GAMMA_STRUCTURAL


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def live_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``src_id, dst_id, kind, confidence`` without missing targets, self loops, non-positive weights, unknown ends."""
    w = F.coalesce(F.col("confidence"), F.lit(1.0))
    missing = F.coalesce(F.col("meta.dst_missing"), F.lit(False)) if "meta" in edges.columns else F.lit(False)
    out = edges.where(~missing & (w > 0) & (F.col("src_id") != F.col("dst_id"))).withColumn("confidence", w)
    if nodes is not None:
        ids = nodes.select(F.col("id").alias("_id"))
        out = out.join(ids, out["src_id"] == ids["_id"], "left_semi").join(ids, out["dst_id"] == ids["_id"], "left_semi")
    return out


def with_self_loops(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unit self loop on each node without an outgoing arc, so transitions stay stochastic."""
    lonely = nodes.select("id").join(arcs.select(F.col("u").alias("id")), "id", "left_anti")
    return arcs.unionByName(lonely.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w")))


def _sum_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u", "v").agg(F.sum("w").alias("w"))


def symmetric(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Retrieval graph: both directions, parallel weights summed, isolated nodes looped."""
    e = live_edges(edges, nodes)
    if kinds is not None:
        e = e.where(F.col("kind").isin(*kinds))
    both = F.explode(F.array(F.struct(F.col("src_id").alias("u"), F.col("dst_id").alias("v")), F.struct(F.col("dst_id").alias("u"), F.col("src_id").alias("v"))))
    arcs = e.select(both.alias("p"), F.col("confidence").alias("w")).select("p.u", "p.v", "w")
    return with_self_loops(_sum_arcs(arcs), nodes)


def _gamma(table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for kind, g in table.items():
        out = F.when(F.col("kind") == kind, g).otherwise(out)
    return out


def projections(edges: DataFrame, nodes: DataFrame, loop_depths: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four directed views: forward, reverse_structural, reverse_complexity, symmetrized."""
    e = live_edges(edges, nodes)
    stated = F.col("meta.loop_depth") if "meta" in edges.columns else F.lit(None).cast("int")
    e = e.withColumn("_stated", stated)
    if loop_depths is not None:
        e = e.join(loop_depths.select("src_id", "dst_id", F.col("loop_depth").alias("_computed")), ["src_id", "dst_id"], "left")
    else:
        e = e.withColumn("_computed", F.lit(None).cast("int"))
    depth = F.least(F.coalesce("_computed", "_stated", F.lit(0)), F.lit(4))
    forward = e.select(F.col("src_id").alias("u"), F.col("dst_id").alias("v"), F.col("confidence").alias("w"))
    back = e.select(F.col("dst_id").alias("u"), F.col("src_id").alias("v"), (F.col("confidence") * _gamma(GAMMA_STRUCTURAL)).alias("w"))
    cost = e.select(F.col("dst_id").alias("u"), F.col("src_id").alias("v"), (F.col("confidence") * _gamma(GAMMA_COMPLEXITY) * F.pow(F.lit(4.0), depth)).alias("w"))
    views = {"forward": forward, "reverse_structural": back, "reverse_complexity": cost}
    return {k: with_self_loops(_sum_arcs(v), nodes) for k, v in views.items()} | {"symmetrized": symmetric(edges, nodes)}


def degrees(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("degree"))


def transitions(arcs: DataFrame) -> DataFrame:
    """``u, v, p`` with ``p`` the share of ``u``'s weight."""
    return arcs.join(degrees(arcs), arcs["u"] == F.col("id")).select("u", "v", (F.col("w") / F.col("degree")).alias("p"))


def hubs(arcs: DataFrame, n_nodes: int, fraction: float = 0.10) -> DataFrame:
    """The top tenth (at least one) of the nodes by weighted degree, ties by id."""
    return degrees(arcs).orderBy(F.desc("degree"), "id").limit(max(1, int(n_nodes * fraction)))


def trace(edges: DataFrame, start: str, direction: str = "out", depth: int = 3) -> DataFrame:
    """``symbol_id, hop, score`` of nodes first reached at a hop, start excluded, score one over the hop."""
    e = live_edges(edges).select("src_id", "dst_id")
    steps = []
    if direction in ("out", "both"):
        steps.append(e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
    if direction in ("in", "both"):
        steps.append(e.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b")))
    arcs = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    seen = e.sparkSession.createDataFrame([(start, 0)], "symbol_id string, hop int")
    frontier = seen
    for hop in range(1, depth + 1):
        found = arcs.join(frontier.select(F.col("symbol_id").alias("a")), "a", "left_semi").select(F.col("b").alias("symbol_id")).distinct()
        frontier = cut(found.join(seen.select("symbol_id"), "symbol_id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen.where("hop > 0").select("symbol_id", "hop", (1.0 / F.col("hop")).alias("score"))


def reachable(edges: DataFrame, start: str, depth: int) -> DataFrame:
    return trace(edges, start, "out", depth).select("symbol_id")


def ppr_power(arcs: DataFrame, seeds: DataFrame, rounds: int = 5, alpha: float = ALPHA, tolerance: float | None = None) -> DataFrame:
    """``id, mass`` after ``rounds`` of r <- alpha s + (1 - alpha) P r; stops early within ``tolerance`` (L1)."""
    p = transitions(arcs)
    nodes = arcs.select(F.col("u").alias("id")).union(arcs.select("v")).distinct()
    start = nodes.join(seeds.select("id", F.col("mass").alias("s")), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
    state = start.select("id", F.col("s").alias("mass"))
    for k in range(1, rounds + 1):
        flow = p.join(state, p["u"] == state["id"]).groupBy(F.col("v").alias("id")).agg(F.sum(F.col("p") * F.col("mass")).alias("f"))
        nxt = start.join(flow, "id", "left").select("id", (alpha * F.col("s") + (1 - alpha) * F.coalesce("f", F.lit(0.0))).alias("mass"))
        if tolerance is not None or k % 4 == 0:
            nxt = cut(nxt)
        if tolerance is not None:
            moved = nxt.join(state.select("id", F.col("mass").alias("old")), "id").agg(F.sum(F.abs(F.col("mass") - F.col("old"))).alias("d")).first()["d"]
            state = nxt
            if (moved or 0.0) <= tolerance:
                break
        state = nxt
    return state


def ppr_push_rounds(arcs: DataFrame, seeds: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, most: int = 200) -> DataFrame:
    """``id, estimate, residual``: forward push of all active nodes a round.

    Each push moves at least alpha * epsilon * degree out of the residual, so pushed degrees sum to at most
    1 / (alpha * epsilon) as in the sequential form; an active-set filter keeps every round's join to the frontier. A push
    that is not done after ``most`` rounds raises an error.
    """
    deg = cut(degrees(arcs))
    state = cut(seeds.select("id", F.lit(0.0).alias("estimate"), F.col("mass").alias("residual")))
    for _ in range(most):
        ranked = state.join(deg, "id", "left").withColumn("hot", F.coalesce(F.col("residual") >= epsilon * F.col("degree"), F.lit(False)))
        hot = ranked.where("hot")
        if hot.isEmpty():
            return state
        spread = arcs.join(hot.select(F.col("id").alias("u"), "residual", "degree"), "u")
        gained = spread.select(F.col("v").alias("id"), F.lit(0.0).alias("estimate"), ((1 - alpha) * F.col("residual") * F.col("w") / F.col("degree")).alias("residual"))
        kept = ranked.select("id", (F.col("estimate") + F.when(F.col("hot"), alpha * F.col("residual")).otherwise(0.0)).alias("estimate"), F.when(F.col("hot"), 0.0).otherwise(F.col("residual")).alias("residual"))
        state = cut(kept.unionByName(gained).groupBy("id").agg(F.sum("estimate").alias("estimate"), F.sum("residual").alias("residual")))
    raise RuntimeError(f"residuals are still over the threshold after {most} rounds")


class Csr:
    """Sorted adjacency arrays of one bounded graph: parallel weights summed, isolated nodes looped."""

    def __init__(self, ids: list[str], triples: list[tuple[str, str, float]], symmetrize: bool = False):
        self.ids = list(ids)
        self.index = {x: k for k, x in enumerate(self.ids)}
        rows: list[dict[int, float]] = [{} for _ in self.ids]
        for u, v, w in triples:
            a, b = self.index.get(u), self.index.get(v)
            if a is None or b is None or a == b or not w > 0:
                continue
            for x, y in ((a, b), (b, a)) if symmetrize else ((a, b),):
                rows[x][y] = rows[x].get(y, 0.0) + w
        for k, row in enumerate(rows):
            if not row:
                row[k] = 1.0
        self.rows = [sorted(r.items()) for r in rows]
        self.degree = [sum(w for _, w in r) for r in self.rows]


def push_sequential(g: Csr, seeds: list[tuple[int, float]], alpha: float = ALPHA, epsilon: float = EPSILON) -> tuple[dict[int, float], dict[int, float], float, int]:
    """Last-in-first-out forward push on one bounded graph: estimate, residual, pushed degree, pushes."""
    if not 0 < alpha <= 1 or epsilon <= 0:
        raise ValueError("INVALID_ARGUMENT: alpha in (0, 1], epsilon above 0")
    estimate: dict[int, float] = {}
    residual: dict[int, float] = {}
    stack, queued = [], set()
    for node, mass in seeds:
        residual[node] = residual.get(node, 0.0) + mass
    for node in residual:
        if residual[node] >= epsilon * g.degree[node]:
            stack.append(node)
            queued.add(node)
    work, pushes = 0.0, 0
    while stack:
        u = stack.pop()
        queued.discard(u)
        while (r := residual.get(u, 0.0)) >= epsilon * g.degree[u] and r > 0:
            pushes += 1
            work += g.degree[u]
            estimate[u] = estimate.get(u, 0.0) + alpha * r
            residual[u] = 0.0
            for v, w in g.rows[u]:
                residual[v] = residual.get(v, 0.0) + (1 - alpha) * r * w / g.degree[u]
                if v != u and v not in queued and residual[v] >= epsilon * g.degree[v]:
                    stack.append(v)
                    queued.add(v)
            if not any(v == u for v, _ in g.rows[u]):
                break
    return estimate, residual, work, pushes


def ppr_exact(g: Csr, seeds: list[tuple[int, float]], alpha: float = ALPHA) -> np.ndarray:
    """Solve alpha (I - (1 - alpha) P)^-1 s on one small graph."""
    n = len(g.ids)
    p, s = np.zeros((n, n)), np.zeros(n)
    for u, row in enumerate(g.rows):
        for v, w in row:
            p[v, u] += w / g.degree[u]
    for node, mass in seeds:
        s[node] += mass
    return alpha * np.linalg.solve(np.eye(n) - (1 - alpha) * p, s)


def push_grouped(arcs: DataFrame, seeds: DataFrame, group: str, alpha: float = ALPHA, epsilon: float = EPSILON) -> DataFrame:
    """``group, id, estimate`` by the sequential push, one bounded graph a group (``arcs``, ``seeds`` carry ``group``)."""

    def run(key: tuple, a: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*a["u"], *a["v"], *s["id"]})
        g = Csr(ids, list(a[["u", "v", "w"]].itertuples(index=False, name=None)))
        got, *_ = push_sequential(g, [(g.index[i], m) for i, m in s[["id", "mass"]].itertuples(index=False, name=None)], alpha, epsilon)
        return pd.DataFrame([(key[0], g.ids[k], float(x)) for k, x in sorted(got.items())], columns=[group, "id", "estimate"])

    kind = dict(arcs.dtypes)[group]
    return arcs.groupBy(group).cogroup(seeds.groupBy(group)).applyInPandas(run, f"{group} {kind}, id string, estimate double")


def diffuse(arcs: DataFrame, seeds: DataFrame, k: int = 10, alpha: float = ALPHA, epsilon: float = EPSILON) -> DataFrame:
    """``symbol_id, score, on_path``: top masses of a push from ``seeds(id, mass)``, ties by id."""
    mass = ppr_push_rounds(arcs, seeds, alpha, epsilon).where("estimate > 0")
    seed = seeds.select(F.col("id").alias("_seed"))
    out = mass.join(seed, mass["id"] == seed["_seed"], "left").select(F.col("id").alias("symbol_id"), F.col("estimate").alias("score"), F.col("_seed").isNull().alias("on_path"))
    return out.orderBy(F.desc("score"), "symbol_id").limit(k)


def resolved_pairs(edges: DataFrame, kind: str | None = None) -> DataFrame:
    e = live_edges(edges)
    return (e if kind is None else e.where(F.col("kind") == kind)).select("src_id", "dst_id").distinct()


def analysis_subgraph(edges: DataFrame, seeds: DataFrame, most: int = 96, hops: int = 2) -> DataFrame:
    """At most ``most`` node ids: seeds first, then hop by hop both ways over edges other than imports, ties by id."""
    e = live_edges(edges).where("kind <> 'imports'")
    arcs = e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).union(e.select("dst_id", "src_id"))
    seen = cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 1):
        found = arcs.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("hop", "id").limit(most)


def row_positions(df: DataFrame, order: list) -> DataFrame:
    """Positions over a bounded result list."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
