"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors as a zip, once per application.

    Functions that run in Python workers are pickled by reference, so each worker has to be able to import the
    package wherever the driver was started from.
    """
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="driftmark-ship-"))
    target = folder / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, os.path.join(root.name, path.relative_to(root)))
    sc.addPyFile(str(target))
    _sent.add(sc.applicationId)
