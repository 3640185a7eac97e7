"""Makes this package importable in Python workers that don't start in the repository."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the workers, once a session; needed before any grouped map, as functions are sent by name."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    if str(_ROOT) not in os.environ.get("PYTHONPATH", "").split(":"):
        out = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted((_ROOT / "strandline").rglob("*.py")):
                z.write(p, p.relative_to(_ROOT))
        sc.addPyFile(str(out))
    sc._strandline_shipped = True
