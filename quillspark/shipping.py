"""Hand this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch: texts may be long, and a batch is held by the JVM and by the worker.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to all executors, once for each application, and bound Arrow batches.

    Workers import the functions of ``mapInArrow`` operators by name, so the
    package has to be on their path whatever folder they start in.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quillspark-src-"), "quillspark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
