"""Send this package to the executors, so that functions pickled by name are found there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_sparktok_shipped"


def ship(spark: SparkSession) -> None:
    """Once for each Spark context: add the package's sources as a zip that workers import from."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sparktok-")) / "sparktok.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)
