"""Session helpers shared by the entry points."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str = "*", partitions: int = 8, app: str = "cadenza") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_cadenza_shipped", False):
        return
    import tempfile

    at = os.path.join(tempfile.mkdtemp(prefix="cadenza"), "cadenza.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(at)
    sc._cadenza_shipped = True


def with_checkpoints(spark: SparkSession) -> None:
    """Have the context a checkpoint folder: that of spark.checkpoint.dir; a temporary one in local sessions without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that they share")
        import tempfile

        at = tempfile.mkdtemp(prefix="cadenza-checkpoint")
    sc.setCheckpointDir(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the executors share, for files that go when the session's JVM ends."""
    import uuid

    with_checkpoints(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at
