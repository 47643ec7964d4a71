"""Scratch tables, table access and connected components shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: White space that separates words in the contracts: blank and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="partloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def free(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished plans now, not when the driver next collects garbage.

    Python's references go first, and the cleaner works beside the driver, so it takes two turns.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def materialize(df: DataFrame, clean: bool = False) -> DataFrame:
    """Cuts lineage: writes ``df`` to a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/partloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if clean:
        free(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._partloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of :func:`materialize` that no later plan reads."""
    path = getattr(df, "_partloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "32m") -> None:
    """Bounds Arrow batches in rows and bytes, so that very long texts do not meet in one batch; sends the package to the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def unit(*cols: Column | str) -> Column:
    """A reproducible number in (0, 1) from a hash of ``cols``."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach; nodes are those in ``edges``.

    Distributed union-find by alternating large-star and small-star rounds: in each,
    every node points its neighbours to the smallest one it knows. Both are a grouped
    minimum (combined before the shuffle) and a join, so a node with very many links
    is never gathered. Each round is a table in the shared folder.
    """
    one = lambda df, x, y: df.select(F.col(x).alias("u"), F.col(y).alias("v"))

    def both(df: DataFrame) -> DataFrame:
        return one(df, "u", "v").union(one(df, "v", "u"))

    def large(df: DataFrame) -> DataFrame:
        e = both(df)
        m = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return e.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small(df: DataFrame) -> DataFrame:
        e = df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        to_min = e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return to_min.union(one(m, "u", "m")).where("u <> v").distinct()

    def total(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    cur = materialize(one(edges, a, b).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        nxt = materialize(small(large(cur)))
        now = total(nxt)
        drop(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = cur.select("v").distinct()
    out = materialize(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component"))))
    drop(cur)
    return out
