"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(app: str = "lexigrain", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in this process, for tests and small inputs."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: once per context, unless their PYTHONPATH has it."""
    sc = spark.sparkContext
    if getattr(sc, "_lexigrain_shipped", False):
        return
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT.parent) not in paths:
        archive = Path(tempfile.mkdtemp(prefix="lexigrain-")) / "lexigrain.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(ROOT.rglob("*.py")):
                z.write(f, f.relative_to(ROOT.parent))
        sc.addPyFile(str(archive))
    sc._lexigrain_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexigrain-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")
