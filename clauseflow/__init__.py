"""clauseflow: structured document review on Spark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's Python files to the executors, once for each Spark application."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")  # whole texts are wide rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # a batch lies in the JVM and in Python
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp()) / "clauseflow_package.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(here.rglob("*.py")):
                out.write(file, file.relative_to(here.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
