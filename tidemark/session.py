"""Session helpers: a local session for tests and benches, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine. On a cluster the session comes from outside, with its own sizes."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    settings = {
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: Python workers import it by name."""
    context = spark.sparkContext
    if not getattr(context, "_tidemark_shipped", False):
        package = Path(__file__).resolve().parent
        to = tempfile.mkdtemp(prefix="tidemark-code-")  # Spark's file server on the driver sends it to the executors
        atexit.register(shutil.rmtree, to, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{to}/{package.name}", "zip", package.parent, package.name))
        context._tidemark_shipped = True
