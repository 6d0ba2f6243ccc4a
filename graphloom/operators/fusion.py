"""Rank fusion, composition of result lists, and ordering utilities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RRF_K

HIT = "symbol_id string, score double, layer string"


def layer_ranks(hits: DataFrame) -> DataFrame:
    """``layer, symbol_id, rank``: one dense position per symbol and layer, by best score, ties by id."""
    best = hits.groupBy("layer", "symbol_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("layer").orderBy(F.desc("score"), "symbol_id")
    return best.select("layer", "symbol_id", F.row_number().over(order).alias("rank"))


def rrf_fuse(hits: DataFrame, k: int = 10, rrf_k: int = RRF_K, layer_order: list[str] | None = None) -> DataFrame:
    """``symbol_id, score, rank`` by reciprocal-rank fusion. ``k`` or ``rrf_k`` not positive: empty.

    Contributions are added in layer order, so sums are the same on every run.
    """
    if k <= 0 or rrf_k <= 0:
        return hits.sparkSession.createDataFrame([], "symbol_id string, score double, rank int")
    place = F.col("layer")
    if layer_order:
        place = F.array_position(F.array(*[F.lit(x) for x in layer_order]), F.col("layer"))
    parts = layer_ranks(hits).select("symbol_id", F.struct(place.alias("p"), (1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("c")).alias("part"))
    folded = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda s, x: s + x["c"])
    top = parts.groupBy("symbol_id").agg(folded.alias("score")).orderBy(F.desc("score"), "symbol_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "symbol_id")))


def compose(prefix: DataFrame, graph: DataFrame, k: int, edges: DataFrame | None = None) -> DataFrame:
    """``symbol_id, segment, position`` : a ranked prefix, then graph hits not in it, then edge context, cut at ``k``.

    Inputs are ``symbol_id, pos``, each already bounded to ``k`` rows or so by its own top-k.
    """
    parts = prefix.select("symbol_id", F.lit(0).alias("segment"), "pos").unionByName(graph.select("symbol_id", F.lit(1).alias("segment"), "pos"))
    if edges is not None:
        parts = parts.unionByName(edges.select("symbol_id", F.lit(2).alias("segment"), "pos"))
    first = parts.groupBy("symbol_id").agg(F.min(F.struct("segment", "pos")).alias("at"))
    ordered = first.select("symbol_id", "at.segment", "at.pos").orderBy("segment", "pos", "symbol_id").limit(k)
    return ordered.select("symbol_id", "segment", F.row_number().over(Window.orderBy("segment", "pos", "symbol_id")).alias("position"))


def seed_distribution(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``symbol_id, mass``: per-layer min-max scores (a flat layer counts 1, zero becomes 0.001), summed and normalised.

    Layers are scaled over all their hits; only hits on ``nodes(id)`` keep mass.
    """
    span = Window.partitionBy("layer")
    lo, hi = F.min("score").over(span), F.max("score").over(span)
    scaled = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0))
    floor = hits.select("symbol_id", F.when(scaled <= 0, F.lit(1e-3)).otherwise(scaled).alias("w"))
    known = floor.join(nodes.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
    mass = known.groupBy("symbol_id").agg(F.sum("w").alias("w"))
    total = mass.agg(F.sum("w").alias("total"))
    return mass.crossJoin(F.broadcast(total)).select("symbol_id", (F.col("w") / F.col("total")).alias("mass"))


def interleave(rows: DataFrame, group: str, order: list) -> DataFrame:
    """Round-robin over groups: every group's first row, then every group's second, and so on (``rn``)."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def diverse(rows: DataFrame, group: str, order: list) -> DataFrame:
    """``later`` is false on the first row of each group: sort by it, then by the own order."""
    return rows.withColumn("later", F.row_number().over(Window.partitionBy(group).orderBy(*order)) > 1)


def budget_running(rows: DataFrame, cost: str, budget: int, group: str, order: list) -> DataFrame:
    """Rows whose running cost within the group stays inside the budget (stops at the first that does not fit)."""
    total = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", total).where(F.col("used") <= budget)


def budget_skip(rows: DataFrame, id_col: str, cost: str, budget: int, group: str, order: str) -> DataFrame:
    """Greedy with skipping: take a row if it still fits, else pass over it and go on. ``group, id, used``.

    A group's rows stream through in order, however many; only the cost used so far is kept.
    """
    kind = rows.schema[group].dataType.simpleString()
    fitting = rows.where(F.col(cost) <= budget).repartition(F.col(group)).sortWithinPartitions(group, order, id_col, cost)
    line = fitting.select(group, F.col(id_col).cast("string").alias("_id"), F.col(cost).cast("long").alias("_cost"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, used = (), 0  # no group equals the empty tuple
        for batch in batches:
            at, sums = [], []
            for i, (g, c) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if g != of:
                    of, used = g, 0
                if used + c <= budget:
                    used += c
                    at.append(i)
                    sums.append(used)
            picked = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(sums, pa.int64())], names=[group, "id", "used"])

    return line.mapInArrow(take, f"`{group}` {kind}, id string, used bigint")
