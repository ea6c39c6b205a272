"""This package on the executors, by Spark's own file server."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: Python tasks import it wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    out = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)
