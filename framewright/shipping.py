"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark, once an application, unless their path already has it.

    Workers inherit PYTHONPATH and, in local mode, the driver's working folder.
    """
    root = Path(__file__).resolve().parent.parent
    known = {Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    app = spark.sparkContext.applicationId
    if root in known or app in _SENT:
        return
    package = Path(tempfile.mkdtemp()) / "framewright.zip"
    with zipfile.ZipFile(package, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((root / "framewright").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(package))
    _SENT.add(app)
