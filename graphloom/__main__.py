"""Command line: ``python -m graphloom index|query|digest|health STORE ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    from .operators.evaluate import health
    from .plans.planner import build_batch
    from .plans.tools import Engine
    from .sources.store import Store, digest
    from .sources.walk import walk

    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("command", choices=["index", "query", "digest", "health"])
    p.add_argument("store")
    p.add_argument("rest", nargs="*")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    store = Store(spark, a.store)
    if a.command == "index":
        batch, _ = build_batch(store.snapshot(), walk(spark, a.rest[0]), "full")
        print(json.dumps(store.publish(batch)))
    elif a.command == "query":
        Engine(spark, store).symbol_search(" ".join(a.rest)).rows.show(truncate=False)
    elif a.command == "digest":
        print(json.dumps(digest(store.snapshot())))
    else:
        snap = store.snapshot()
        print(json.dumps({r["check"]: r["status"] for r in health(snap.table("symbol"), snap.table("edge")).collect()} | snap.freshness()))


if __name__ == "__main__":
    main()
