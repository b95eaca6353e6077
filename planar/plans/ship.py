"""Making this package importable on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for sessions
    whose executors do not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    with tempfile.NamedTemporaryFile(prefix=f"{package.name}-", suffix=".zip", delete=False) as target:
        with zipfile.ZipFile(target, "w") as code:
            for path in sorted(package.rglob("*.py")):
                code.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(target.name)
    _shipped.add(app)
