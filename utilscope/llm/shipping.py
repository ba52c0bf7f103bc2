"""Sending this package to the Python workers of a session."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from utilscope.workspace import shared_root

#: Rows of an Arrow batch unless the session says otherwise: rows of texts are long, and executors hold some batches at once.
BATCH_ROWS = 2000
_BATCH_SETTING, _SPARK_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once per application, as `--py-files` would.

    The archive is written to the shared folder through Spark's file systems. A session that has
    Spark's own size of Arrow batches gets smaller ones.
    """
    if spark.conf.get(_BATCH_SETTING) == _SPARK_BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context = spark.sparkContext
    path = f"{shared_root(spark)}/{_PACKAGE.name}-{uuid.uuid4().hex}/{_PACKAGE.name}.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    context.addPyFile(path)
    _shipped.add(application)
