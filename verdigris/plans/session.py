"""Session settings for local runs; a cluster's own settings are left alone."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "verdigris", cpus: int | None = None, **extra: str) -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    spark = SparkSession.builder.appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package; a cluster ships it with --py-files."""
    from pathlib import Path

    root, seen = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in seen.get("PYTHONPATH", "").split(os.pathsep):
        seen["PYTHONPATH"] = os.pathsep.join(x for x in (root, seen.get("PYTHONPATH", "")) if x)
    return spark


def tasks_for(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """Tasks that hold about `each` rows at the most, as many as the session shuffles to at the least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of this application that driver and executors share: in spark.checkpoint.dir; a session in one process takes a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="verdigris-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/verdigris_{spark.sparkContext.applicationId}/{name}"


def shared_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: in the folder that the session names.

    Only a session in one process takes a temporary folder of its own where it
    names none; on a cluster that would be each node's own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="verdigris-"))


def durable(df: DataFrame) -> DataFrame:
    """The rows in reliable storage, without their lineage."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
