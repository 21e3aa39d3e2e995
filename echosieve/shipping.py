"""Makes the package importable by Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless they find it already.

    Workers look in PYTHONPATH and, on the driver's machine, in the working
    directory. Clusters that install the package, or get it by --py-files, list
    it there, too.
    """
    root = Path(__file__).resolve().parent.parent
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == root for p in paths):
        return
    target = Path(tempfile.mkdtemp(prefix="echosieve-")) / "echosieve.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "echosieve").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
