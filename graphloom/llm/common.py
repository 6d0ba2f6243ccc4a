"""Helpers shared by the training-data operators: stage tables, components, table reads."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (unit tests on one machine) a folder is made and removed at exit; on
    a cluster without the setting this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex[:12]}"


#: Makes Spark delete the shuffle files of an execution at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: cuts lineage, survives lost executors.

    The shuffle files of the write go when it is done, as nothing reads them again (the plan of a write is its own).
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def drop_stage(*tables: DataFrame) -> None:
    """Delete stage tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffled_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Join neither side of which is broadcast. For exploded rows: Spark's estimate does not know how many rows an explode
    makes, so it would send a table to the driver that is a hundred times as large as it believes."""
    return left.hint("merge").join(right.hint("merge"), on)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 64) -> DataFrame:
    """Component label of every node of ``edges(a, b)`` (longs): ``node, label`` with the smallest node as label.

    Hook-and-shortcut rounds: each node hooks its parent and itself onto the smallest grandparent among its
    neighbours, then jumps to its own grandparent, so the number of rounds is logarithmic in practice. Every
    round is two equi-joins and two partially aggregated minimums, written to the shared folder (the tables of earlier
    rounds are deleted); the driver sees one count per round. Labels that still move after ``max_rounds`` rounds raise an
    error. An empty edge list gives an empty result.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct()
    both = stage_table(both, f"{name}-edges")
    state = stage_table(
        both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("f")), f"{name}-0"
    )
    for k in range(1, max_rounds + 1):
        parent = state.select(F.col("u").alias("p"), F.col("f").alias("g"))
        grand = state.join(parent, F.col("f") == F.col("p")).select("u", "f", "g")
        grand = stage_table(grand, f"{name}-g{k}")
        seen = both.join(grand.select(F.col("u").alias("v"), F.col("g").alias("gv")), "v")
        low = seen.groupBy("u").agg(F.min("gv").alias("m"))
        hooks = (
            grand.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.least("f", "g", "m").alias("c")), F.struct(F.col("f").alias("u"), F.col("m").alias("c")))).alias("h"))
            .select("h.u", "h.c")
        )
        fresh = stage_table(hooks.groupBy("u").agg(F.min("c").alias("f")), f"{name}-{k}")
        moved = fresh.join(grand.select("u", F.col("g").alias("old")), "u").where("f <> old").limit(1).count()
        drop_stage(state, grand)
        state = fresh
        if not moved:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    drop_stage(both)
    return state.select(F.col("u").alias("node"), F.col("f").alias("label"))
