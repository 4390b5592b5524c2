"""Session defaults for running the engine on its own (tests, bench, scripts).

A cluster job passes its own session in; nothing in the library needs these
settings except ANSI-safe, UTC behaviour, which Spark 4 gives by default.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(app: str = "sievetext", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session sized for one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context.

    Not needed where it is installed on the executors; Spark sends the archive along
    with the tasks.
    """
    context = spark.sparkContext
    if getattr(context, "_sievetext_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="sievetext-code-"), "sievetext.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(archive)
    context._sievetext_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (tests, a laptop) and the master is local, a fresh local folder is used; on a
    cluster executors would not see such a folder, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    active = spark.sparkContext.getCheckpointDir()
    if active is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievetext-"))
        active = spark.sparkContext.getCheckpointDir()
    return active.rstrip("/")
