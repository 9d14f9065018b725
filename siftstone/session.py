"""Sessions: makes the package known to Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each application.

    Batches for Python are bounded by bytes as well as by rows, unless the
    session has a bound of its own: rows of texts and packed rows are long.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) in (None, "", str((1 << 31) - 1)):  # the default is no bound
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="siftstone-"), "siftstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("siftstone", os.path.relpath(full, root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
    return spark


def shipped(query):
    """A query that ships the package first."""

    def run(spark: SparkSession, sf_dir: str):
        return query(ship(spark), sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    run.__doc__ = query.__doc__
    return run


def shipped_stage(step):
    """A pipeline stage that ships the package first."""

    def run(spark: SparkSession, docs, sf_dir: str):
        return step(ship(spark), docs, sf_dir)

    run.__name__, run.__doc__ = step.__name__, step.__doc__
    return run
