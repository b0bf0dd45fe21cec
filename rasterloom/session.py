"""Session helpers shared by every part of the package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python path, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="rasterloom-code-")) / "rasterloom_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
