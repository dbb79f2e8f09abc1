"""Session helpers: configuration, the shared folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Upper bound, in bytes, of any table this library broadcasts by hint.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE on)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode a temporary folder of this machine takes its place where
    the setting is absent; a cluster without it is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.environ.get("QUILLSTONE_LOCAL_SHARED")
        if where is None:
            where = os.environ["QUILLSTONE_LOCAL_SHARED"] = tempfile.mkdtemp(prefix="quillstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark).rstrip('/')}/quillstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting lineage.

    A written table survives the loss of any executor and gives Catalyst real
    sizes for the joins that follow. ``discard`` deletes it when nothing reads
    it any more, ``clean_up`` whatever an application has left.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillstone_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and no plan reads any more."""
    for df in written:
        _delete(df.sparkSession, df._quillstone_path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables this application has written to the shared folder."""
    _delete(spark, f"{shared_folder(spark).rstrip('/')}/quillstone-{spark.sparkContext.applicationId}")


def written_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that ``materialise`` wrote."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._quillstone_path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def broadcast_if_small(df: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint where its size on disk, five times over, is within ``bound``; else as it is."""
    return broadcast(df) if 5 * written_bytes(df) <= bound else df


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once for each context."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_quillstone_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillstone-code-")) / "quillstone.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._quillstone_shipped = True
