"""Make this package known to Python workers that were started without it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules as a zip file, once for each application, unless PYTHONPATH has them."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="flowlens-")) / "flowlens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "flowlens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
