"""What a Spark session needs to run this package's Python functions on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that they need no path to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="formline-code-")) / "formline_code.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"formline/{p.relative_to(root)}")
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)
