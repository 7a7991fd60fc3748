"""What operators need of a Spark session: the package on its executors, and a folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors, once for each application, so that Python tasks can import it."""
    if (app := spark.sparkContext.applicationId) not in _shipped:
        root = Path(__file__).resolve().parent
        with tempfile.NamedTemporaryFile(prefix="logmill-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, os.path.join(root.name, p.relative_to(root)))
        spark.sparkContext.addPyFile(f.name)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop)
    a folder of this machine is taken and set as checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="logmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/logmill-{uuid.uuid4().hex}"
