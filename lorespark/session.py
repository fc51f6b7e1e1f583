"""Session helpers: a local session for tests and benchmarks, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(name: str = "lorespark", cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC time, AQE and few shuffle partitions; for tests and benchmarks only."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_lorespark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lorespark-")) / "lorespark_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, os.path.join(PACKAGE.name, path.relative_to(PACKAGE)))
    context.addPyFile(str(archive))
    context._lorespark_shipped = True
