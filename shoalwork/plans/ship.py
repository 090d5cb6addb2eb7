"""Making the package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once for each Spark context, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_shoalwork_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="shoalwork-")) / "shoalwork.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"shoalwork/{file.relative_to(root)}")
    context.addPyFile(str(path))
    context._shoalwork_shipped = True
