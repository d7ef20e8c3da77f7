"""Session helpers: a builder for stand-alone runs and the settings every query needs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wattloom", cpus: int | str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks. On a cluster use the session that is there."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.driver.memory", os.environ.get("WATTLOOM_DRIVER_MEMORY", "12g"))
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)


def pin(spark: SparkSession) -> SparkSession:
    """Readings carry local wall-clock time without a zone; one fixed zone keeps it so."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a folder that all executors see. Only where it is unset, as in
    local tests, a temporary folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wattloom-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table that several passes read, and read it back.

    Unlike a cache it survives the loss of executors, cuts the lineage, and each pass reads only
    the columns it needs.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
