"""Sends this package to the executors' Python, for clusters where it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each Spark application; the driver serves the archive to all executors."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="vecloom-")) / "vecloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(Path(folder, name), Path("vecloom", Path(folder, name).relative_to(package)))
    sc.addPyFile(str(archive))
    _sent.add(sc.applicationId)
