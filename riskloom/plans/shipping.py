"""Makes this package importable in Python workers, wherever the executors run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's source to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="riskloom-src-")) / "riskloom_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    _done.add(sc.applicationId)
