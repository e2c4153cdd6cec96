"""Sessions: settings that the engine expects, the package on Python workers, the folder shared by all machines."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC for epoch arithmetic; adaptive plans with skew splitting; a shuffle partition of about 128 MB.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_shipped: set[str] = set()


def build(master: str | None = None, name: str = "wakeline", **more: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    b = b.master(master) if master else b
    return b.config(map=SETTINGS | more).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they may not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir or the context. A temporary one is made only for a
    local master, where there is one machine; on a cluster a missing folder is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="wakeline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint(df):
    """df.checkpoint() in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
