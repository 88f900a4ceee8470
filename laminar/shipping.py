"""Makes this package importable in Python workers, wherever they run: it is zipped once a context and handed out by Spark's own file server."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the context's Python files, once. Sources only, well under a megabyte."""
    sc = spark.sparkContext
    if getattr(sc, "_laminar_shipped", False):
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="laminar-")) / "laminar.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(out))
    sc._laminar_shipped = True
