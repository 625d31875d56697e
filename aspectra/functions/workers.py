"""Brings this package to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever they run: once for each application it is sent as a zip file."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    file = Path(tempfile.mkdtemp(prefix="aspectra-")) / "aspectra-core.zip"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "aspectra").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(file))
    _shipped.add(sc.applicationId)
