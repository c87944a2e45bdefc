"""Sends this package to the executors.

A cluster may not have the repository on its executors' import path.  The
package is zipped once per application and handed to Spark, which serves it
from the driver to every executor (also to those that join later).
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``import chronopix`` work in Python workers of this application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="chronopix-")) / f"chronopix-{app}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
