"""The package for Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Send this package to every worker of the session, now and later; gives the archive's path on the
    driver. Needed where neither the working folder nor PYTHONPATH of the workers holds it."""
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="corpusframe-"), "corpusframe.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".npz"):
                z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    return at
