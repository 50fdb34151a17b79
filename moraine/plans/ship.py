"""Sends this package to the executors, for sessions that were not started with --py-files."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's sources, through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="moraine-ship-")) / "moraine.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(target))
    _sent.add(sc.applicationId)
