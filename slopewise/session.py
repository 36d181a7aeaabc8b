"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "slopewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults. A cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to: the session's `spark.checkpoint.dir`.

    Only a session on one machine (a local master) takes a fresh local folder where none is set; elsewhere executors
    would not find each other's files, and that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not wanted and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="slopewise-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and go on from there.

    Survives executor loss, stops a plan from growing per round, and, unlike a checkpointed RDD, keeps
    later reads columnar and their size known, so small sides are broadcast by Spark's own size check.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of `cut_lineage` that no later result reads."""
    for df in tables:
        path = getattr(df, "_stage_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            df._stage_path = None


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that a driver program that lies elsewhere needs no installation on them."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_slopewise_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="slopewise-ship-")) / "slopewise.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._slopewise_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in the shared checkpoint folder."""
    return os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")
