"""Make the package importable on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application, unless the
    Python path or the working folder of this process already leads workers to it."""
    app = spark.sparkContext.applicationId
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _shipped or str(ROOT) in paths or Path.cwd() == ROOT:
        return
    target = Path(tempfile.mkdtemp(prefix="ridgeline-src-")) / "ridgeline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "ridgeline").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which executors share; a temporary one only
    where the session has none and all of it runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
