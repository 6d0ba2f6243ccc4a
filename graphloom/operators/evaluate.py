"""Retrieval metrics, edge-set metrics, coverage statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, hub_ids: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall and precision at ``k``, contamination by hubs over ``k``, reciprocal rank over the full order.

    ``ranked(q, id, rank)``, ``relevant(q, id)``, ``hub_ids(id)``.
    """
    rel = relevant.select("q", "id").distinct()
    n = rel.groupBy("q").agg(F.count("*").alias("n_rel"))
    hubs = hub_ids.select("id").distinct().withColumn("hub", F.lit(1))
    marked = ranked.join(rel.withColumn("hit", F.lit(1)).hint("merge"), ["q", "id"], "left").join(hubs.hint("merge"), "id", "left")
    top = F.col("rank") <= k
    agg = marked.groupBy("q").agg(
        F.sum(F.when(top & F.col("hit").isNotNull(), 1).otherwise(0)).alias("hits"),
        F.sum(F.when(top & F.col("hub").isNotNull(), 1).otherwise(0)).alias("hubs"),
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"),
    )
    return agg.join(n, "q", "left").select(
        "q",
        F.when(F.coalesce("n_rel", F.lit(0)) == 0, 0.0).otherwise(F.col("hits") / F.col("n_rel")).alias("recall"),
        (F.col("hits") / F.lit(float(k))).alias("precision"),
        (F.col("hubs") / F.lit(float(k))).alias("contamination"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def mean_metrics(per_query: DataFrame, method: str | None = None) -> DataFrame:
    cols = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall", "precision", "contamination", "mrr")]
    return per_query.groupBy(method).agg(*cols) if method else per_query.agg(*cols)


def regression_gate(before: DataFrame, after: DataFrame, key: str, noise: float = 0.05) -> DataFrame:
    """``key, passed, reasons``: recall or reciprocal rank fell, or contamination rose, beyond the noise."""
    b = before.select(key, *[F.col(c).alias(f"b_{c}") for c in ("recall", "mrr", "contamination")])
    both = after.join(b, key)
    reasons = F.filter(
        F.array(
            F.when(F.col("b_recall") - F.col("recall") > noise, F.lit("recall")),
            F.when(F.col("b_mrr") - F.col("mrr") > noise, F.lit("mrr")),
            F.when(F.col("contamination") - F.col("b_contamination") > noise, F.lit("contamination")),
        ),
        lambda r: r.isNotNull(),
    )
    return both.select(key, (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"))


def rankings_stable(before: DataFrame, after: DataFrame, altered: DataFrame, k: int = 10) -> DataFrame:
    """One row ``stable``: every query of ``before(q, id, rank)`` that is not in ``altered(q)`` has the same ``k`` best after.

    A query that ranks nothing has no row on either side and is stable; queries only ``after`` has do not matter.
    """
    queries = before.select("q").distinct().join(altered.select("q").distinct(), "q", "left_anti")
    b, a = (x.where(F.col("rank") <= k).select("q", "rank", "id").join(queries, "q", "left_semi") for x in (before, after))
    both = b.withColumnRenamed("id", "b_id").join(a.withColumnRenamed("id", "a_id"), ["q", "rank"], "full")
    return both.agg((F.count_if(~F.col("b_id").eqNullSafe(F.col("a_id"))) == 0).alias("stable"))


def retrieval_gate(before: dict, after: dict, altered: DataFrame, k: int = 10, tolerance: float = 0.05) -> DataFrame:
    """One row ``passed, stable, degraded``: unaltered queries keep their ``k`` best and no mean metric is worse than tolerated.

    Sides are ``{generation, corpus, ranked, metrics}`` with ``ranked(q, id, rank)`` and one row of mean ``metrics``. Sides
    of another generation or corpus are not comparable and are refused.
    """
    for what in ("generation", "corpus"):
        if before[what] != after[what]:
            raise ValueError(f"EVAL: refused, {what} {before[what]} != {after[what]}")
    names = ("recall", "precision", "mrr", "contamination")
    b = before["metrics"].select(*[F.col(c).alias(f"b_{c}") for c in names])
    worse = [F.when((F.col("contamination") > F.col("b_contamination") + tolerance) if c == "contamination" else (F.col(c) < F.col(f"b_{c}") - tolerance), F.lit(c)) for c in names]
    one = after["metrics"].crossJoin(b).crossJoin(rankings_stable(before["ranked"], after["ranked"], altered, k))  # three single rows
    degraded = F.concat_ws(",", *worse)
    return one.select((F.col("stable") & (degraded == "")).alias("passed"), "stable", degraded.alias("degraded"))


def coverage_gate(code_before: Column, code_after: Column, other_before: Column, other_after: Column, epsilon: float = 0.01) -> Column:
    """Promote only if code holds within epsilon and the rest is strictly better; anything unmeasured blocks."""
    known = code_before.isNotNull() & code_after.isNotNull() & other_before.isNotNull() & other_after.isNotNull()
    return F.coalesce(known & (code_after >= code_before - epsilon) & (other_after > other_before), F.lit(False))


def edge_set_metrics(found: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: true positives, precision, recall, F1 of distinct ``src_id, dst_id`` pairs; empty sides count zero."""
    f, g = (x.select("src_id", "dst_id").distinct() for x in (found, golden))
    both = f.withColumn("f", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["src_id", "dst_id"], "full")
    n = both.agg(F.count(F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"), F.count("f").alias("nf"), F.count("g").alias("ng"))
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    p, r = ratio("tp", "nf"), ratio("tp", "ng")
    return n.select("tp", p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def coverage_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, share of resolved edges, share of connected nodes, average out-degree."""
    missing = F.coalesce(F.col("meta.dst_missing"), F.lit(False)) if "meta" in edges.columns else F.lit(False)
    e = edges.select("src_id", "dst_id", missing.alias("missing"))
    ends = e.where("NOT missing").select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    linked = nodes.select("id").join(ends, "id", "left_semi").agg(F.count("*").alias("linked"))
    totals = e.agg(F.count("*").alias("n_edges"), F.count_if(~F.col("missing")).alias("n_resolved"))
    one = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(totals).crossJoin(linked)  # three single rows
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return one.select(
        "n_nodes", "n_edges", "n_resolved", ratio("n_resolved", "n_edges").alias("resolution_rate"), ratio("linked", "n_nodes").alias("connectivity"), ratio("n_resolved", "n_nodes").alias("avg_out_degree")
    )


def parity_l1(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: L1 distance of two ``id, mass`` tables, missing ids as zero."""
    b = right.select("id", F.col("mass").alias("other"))
    return left.join(b, "id", "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))), F.lit(0.0)).alias("l1"))


def parity_lists(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for two ranked lists ``id, pos, score``: ids on both sides and on one only, ids at other positions, and ids
    whose scores are not the same double. All but the first are zero where two surfaces agree in set, order and bits."""
    b = right.select("id", F.col("pos").alias("other_pos"), F.col("score").alias("other_score"), F.lit(True).alias("r"))
    both = left.select("id", "pos", "score", F.lit(True).alias("l")).join(b, "id", "full")
    met = F.col("l").isNotNull() & F.col("r").isNotNull()
    return both.agg(
        F.count_if(met).alias("n_both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"),
        F.count_if(met & ~F.col("pos").eqNullSafe(F.col("other_pos"))).alias("moved"), F.count_if(met & ~F.col("score").eqNullSafe(F.col("other_score"))).alias("changed"),
    )


def health(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``check, status`` rows and their roll-up: fail dominates warn dominates ok; no symbol is a failure."""
    n, m = symbols.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    both = n.crossJoin(m)
    rows = F.array(
        F.struct(F.lit("symbols").alias("check"), F.when(F.col("n") == 0, 2).otherwise(0).alias("severity")),
        F.struct(F.lit("edges").alias("check"), F.when(F.col("m") == 0, 1).otherwise(0).alias("severity")),
        F.struct(F.lit("overall").alias("check"), F.greatest(F.when(F.col("n") == 0, 2).otherwise(0), F.when(F.col("m") == 0, 1).otherwise(0)).alias("severity")),
    )
    status = F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.col("r.severity") + 1)
    return both.select(F.explode(rows).alias("r")).select("r.check", status.alias("status"))


def golden_queries(rows: list[dict]) -> list[tuple[str, str, str]]:
    """``q, name, path part`` of a golden set; malformed entries are skipped, a missing ``queries`` key is an error."""
    out = []
    for doc in rows:
        if "queries" not in doc:
            raise ValueError("INVALID_ARGUMENT: golden set without queries")
        for q in doc["queries"]:
            if isinstance(q, dict) and isinstance(q.get("q"), str):
                out += [(q["q"], r[0], r[1]) for r in q.get("relevant", []) if isinstance(r, list | tuple) and len(r) == 2]
    return out


def golden_edges(doc: dict) -> tuple[bool, list[tuple[str, str, str, str]]]:
    """``complete`` and ``src name, src path, dst name, dst path`` rows of a golden edge set; malformed rows are skipped."""
    rows = []
    for e in doc.get("edges", []):
        pair = [e.get(k) for k in ("src", "dst")] if isinstance(e, dict) else []
        if len(pair) == 2 and all(isinstance(x, list | tuple) and len(x) == 2 for x in pair):
            rows.append((*pair[0], *pair[1]))
    return bool(doc.get("complete")), rows


def golden_pairs(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """``gid, src_id, dst_id``: every resolved source with every resolved target of one golden row.

    ``rows(gid, src_name, src_path, dst_name, dst_path)``; a label is a name and a part of the normalized path, so a row
    resolves to few symbols and the product stays inside it.
    """
    path = F.lower(F.replace("file_path", F.lit("\\"), F.lit("/")))
    known = symbols.select("id", "name", path.alias("path"))

    def side(end: str) -> DataFrame:
        named = rows.select("gid", F.col(f"{end}_name").alias("name"), F.col(f"{end}_path").alias("part"))
        return named.join(known, "name").where(F.contains("path", "part")).select("gid", F.col("id").alias(f"{end}_id"))

    return side("src").join(side("dst"), "gid").distinct()


def evaluate_golden(symbols: DataFrame, edges: DataFrame, rows: DataFrame, complete: bool) -> DataFrame:
    """One row of edge metrics against a golden set; found edges count only from golden sources, and precision is null
    unless the set says it is complete."""
    pairs = golden_pairs(symbols, rows).select("src_id", "dst_id").distinct()
    missing = F.coalesce(F.col("meta.dst_missing"), F.lit(False)) if "meta" in edges.columns else F.lit(False)
    found = edges.where(~missing).select("src_id", "dst_id").join(pairs.select("src_id").distinct(), "src_id", "left_semi")
    m = edge_set_metrics(found, pairs)
    return m if complete else m.withColumn("precision", F.lit(None).cast("double")).withColumn("f1", F.lit(None).cast("double"))


def reach_recall(edges: DataFrame, golden: DataFrame, depth: int) -> DataFrame:
    """One row: the share of golden ``src_id, dst_id`` pairs (repeats count) whose target is within ``depth`` hops.

    All sources advance together: a level is one join of the frontier with the edges, and pairs already reached stop.
    """
    arcs = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).where("a <> b").distinct()
    reached = golden.select("src_id", F.col("src_id").alias("at")).distinct()
    frontier = reached
    for _ in range(depth):
        step = frontier.join(arcs, frontier["at"] == arcs["a"]).select("src_id", F.col("b").alias("at")).distinct()
        frontier = step.join(reached, ["src_id", "at"], "left_anti")
        reached = reached.unionByName(frontier)
    hit = golden.join(reached.where("src_id <> at").withColumn("hit", F.lit(1)), (golden["src_id"] == reached["src_id"]) & (golden["dst_id"] == F.col("at")), "left")
    return hit.agg(F.count("*").alias("n"), F.count("hit").alias("reached")).select("n", "reached", F.when(F.col("n") == 0, 0.0).otherwise(F.col("reached") / F.col("n")).alias("recall"))


def relevant_symbols(symbols: DataFrame, golden: DataFrame) -> DataFrame:
    """``q, id`` of symbols that a golden row ``q, name, part`` names: an equal name, and the part in the normalized path.

    Distinct golden rows meet distinct paths of a name; repeats of either and the ids come in only where a part is found, so
    a name that many symbols share costs no product of its repeats. No side is broadcast: repeats make small files.
    """
    path = F.lower(F.replace("file_path", F.lit("\\"), F.lit("/")))
    known = symbols.select("id", "name", path.alias("path"))
    part = F.lower(F.replace("part", F.lit("\\"), F.lit("/")))
    asked = golden.select("q", "name", part.alias("part")).distinct()
    files = known.select("name", "path").distinct()
    found = asked.join(files.hint("merge"), "name").where(F.contains("path", "part")).select("q", "name", "path").distinct()
    return found.join(known.hint("merge"), ["name", "path"]).select("q", "id").distinct()


def offline_harness(symbols: DataFrame, golden: DataFrame, rankings: dict[str, DataFrame], hub_ids: DataFrame, k: int = 10) -> DataFrame:
    """``method, n_eval, n_skipped`` and mean metrics of each ranking ``q, id, rank`` over a golden set.

    Queries without a resolvable label are skipped and counted. A query that a method ranks nothing for counts as zeros.
    """
    relevant = cut(relevant_symbols(symbols, golden))  # each method reads it again
    asked = golden.select("q").distinct()
    judged = relevant.select("q").distinct()
    counts = asked.join(judged.withColumn("known", F.lit(1)), "q", "left").agg(F.count("known").alias("n_eval"), F.count_if(F.col("known").isNull()).alias("n_skipped"))
    out = None
    for method, ranked in rankings.items():
        rows = retrieval_metrics(ranked.join(judged, "q", "left_semi"), relevant, hub_ids, k)
        means = mean_metrics(judged.join(rows, "q", "left").fillna(0.0))
        one = counts.crossJoin(means).select(F.lit(method).alias("method"), "n_eval", "n_skipped", "recall", "precision", "contamination", "mrr")  # two single rows
        out = one if out is None else out.unionByName(one)
    return out


def graph_ranking(symbols: DataFrame, arcs: DataFrame, query: str, seed_k: int = 10, k: int = 10, text_col: str = "text") -> DataFrame:
    """``id, rank``: masses diffused over ``arcs`` from the ``seed_k`` best tf-idf hits of ``symbols(id, text)``; no seed, no rows."""
    from .fusion import seed_distribution
    from .graph import diffuse, row_positions
    from .lexical import tfidf_search

    hits = tfidf_search(symbols, "id", text_col, query, seed_k).select(F.col("id").alias("symbol_id"), "score", F.lit("lexical").alias("layer"))
    seeds = seed_distribution(hits, symbols.select("id")).select(F.col("symbol_id").alias("id"), "mass")
    best = diffuse(arcs, seeds, k)
    return row_positions(best, [F.desc("score"), "symbol_id"]).select(F.col("symbol_id").alias("id"), F.col("pos").alias("rank"))


def cards(symbols: DataFrame, level: str = "module") -> tuple[DataFrame, DataFrame]:
    """Cards of symbols by directory (``module``) or first directory (``top``): ``key, id`` members and ``key, token`` words.

    Both are long tables, so a directory of any size stays distributed.
    """
    from ..functions.text import camel_tokens

    parts = F.filter(F.split(F.replace("file_path", F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    if level == "top":
        key = F.when(F.size(parts) == 0, F.lit("<root>")).otherwise(F.get(parts, 0))
    else:
        key = F.when(F.size(parts) <= 1, F.lit("<root>")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/"))
    text = F.concat_ws(" ", "key", "name", "qualified_name", "body_excerpt")
    keyed = symbols.withColumn("key", key)
    return keyed.select("key", "id"), keyed.select("key", F.explode(F.array_distinct(camel_tokens(text))).alias("token")).distinct()


def score_cards(words: DataFrame, query: str) -> DataFrame:
    """``key, score``: how many of the query's words (repeats count) a card holds, best first, ties by key."""
    from ..functions.text import camel_tokens

    asked = words.sparkSession.createDataFrame([(query,)], "q string").select(F.explode(camel_tokens(F.col("q"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    hits = words.join(F.broadcast(asked), "token")  # as many rows as the query has words
    return hits.groupBy("key").agg(F.sum("n").alias("score")).orderBy(F.desc("score"), "key")


def structure_report(stats: dict, by_kind: dict[str, int], metrics: dict | None = None) -> tuple[str, str]:
    """JSON and Markdown of one structure evaluation."""
    import json

    body = {"coverage": stats, "edges_by_kind": dict(sorted(by_kind.items())), "golden": metrics}
    lines = ["# Structure report", "", "| measure | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in stats.items())]
    lines += ["", "| kind | edges |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in sorted(by_kind.items()))]
    if metrics:
        lines += ["", "| golden | value |", "| --- | --- |", *(f"| {k} | {'-' if v is None else v} |" for k, v in metrics.items())]
    return json.dumps(body, sort_keys=True), "\n".join(lines) + "\n"
