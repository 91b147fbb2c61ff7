"""Shared scratch tables: how a query cuts its lineage without losing data with an executor.

Everything is written below ``spark.checkpoint.dir``, the one folder that the
driver and all executors of a cluster share.  Only in local mode, where the
driver is the only machine, a missing setting is replaced by a temporary folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; in local mode, set up on first use where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quillspark-")
        root = _own[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    Unlike a cached DataFrame it survives the loss of any executor, and later
    plans start from its files.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # Spark's analysis errors have no common Python type
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def semi_join(df: DataFrame, keys: DataFrame, on: list[str], max_rows: int = 400_000) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns occur in ``keys``; nulls match nulls.

    The keys are counted first.  Up to ``max_rows`` of them are broadcast, so
    that the wide side is not shuffled; beyond that both sides are shuffled.
    """
    right = keys.select(*[F.col(c).alias(f"__k_{c}") for c in on]).distinct()
    cond = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        cond = term if cond is None else cond & term
    small = right.count() <= max_rows
    return df.join(F.broadcast(right) if small else right, cond, "left_semi")


def purge(spark: SparkSession) -> None:
    """Delete all scratch tables of this package; results not yet written need them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/quillspark")
    path.getFileSystem(conf).delete(path, True)
