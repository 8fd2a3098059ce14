"""Bringing the package to the executors, for sessions whose workers can't import it."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

import partwise

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this application, once. Needed where they don't find it by themselves; harmless elsewhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(partwise.__file__).parent
    target = os.path.join(SparkFiles.getRootDirectory(), "partwise-package.zip")  # Spark's own folder; Spark serves the file
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
