"""Sessions for tests and benches, and shipping this package to Python workers."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that results rely on (UTC, ANSI, adaptive plans)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver found it."""
    sources = sorted(PACKAGE.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:16]
    app = spark.sparkContext.applicationId
    if _shipped.get(app):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="visitloom-"), f"visitloom_{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sources:
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local default.

    The default serves tests in local mode only; a cluster must name its own folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints/visitloom"
