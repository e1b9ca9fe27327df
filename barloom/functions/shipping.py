"""Making the package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, for clusters on which it isn't installed. Repeating it is harmless.

    Spark copies the archive to every executor itself, so the driver's temporary folder is enough.
    """
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="barloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
