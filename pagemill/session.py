"""Session settings that the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(master: str = "local[8]", partitions: int = 8, memory: str = "8g", name: str = "pagemill") -> SparkSession:
    """A session with adaptive execution and UTC, for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once; they need not find it on a path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_pagemill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="pagemill-")) / f"{root.name}.zip"  # the driver's own; workers get it from Spark
    atexit.register(shutil.rmtree, path.parent, True)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._pagemill_shipped = True
