"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with this library's defaults; keyword arguments are settings with _ for the dots."""
    settings = DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that don't have the repository on their path."""
    on_path = {str(Path(p or ".").resolve()) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    app = spark.sparkContext.applicationId
    if str(ROOT) in on_path or app in _SHIPPED:
        return
    file = Path(tempfile.mkdtemp(prefix="loomgraph-ship-")) / "loomgraph-package.zip"
    with zipfile.ZipFile(file, "w") as z:
        for path in sorted((ROOT / "loomgraph").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(file))
    _SHIPPED.add(app)
