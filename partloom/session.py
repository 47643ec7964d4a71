"""Session helper with the settings every plan of this package assumes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "partloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE; ``conf`` overrides any setting (dots written as ``__``)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_methods(spark: SparkSession) -> None:
    """For plans of many wide expressions: the JVM never compiles a method over 8,000 bytes, so beyond that operators run one by one, whose code is split into small methods."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python functions find it there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="partloom-")) / "partloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
