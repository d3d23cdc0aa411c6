"""Hands the package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from quillmark.session import shared_folder

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    shared = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    # beside the checkpoints where that folder is a mounted one; on object stores Spark itself carries the driver's file
    archive = Path(tempfile.mkdtemp(prefix="quillmark-", dir=shared if os.path.isdir(shared) else None)) / "quillmark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
