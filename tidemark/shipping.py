"""Puts this package on the workers' path, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure_shipped(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, Path(root.name) / file.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
