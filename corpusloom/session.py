"""Session settings and shipping of the package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Applications that have the package already.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application.

    Functions that run in Python workers are found by their module's name there, whatever
    the folder that the driver was started in.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
        Path(path).write_bytes(data.getvalue())
        spark.sparkContext.addPyFile(path)
    return spark


def local_session(cores: str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench: UTC, adaptive, ANSI."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusloom")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return ship(builder.config(map=settings).getOrCreate())
