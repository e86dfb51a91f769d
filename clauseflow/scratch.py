"""Tables written to the folder that the driver and all executors share, so that what they hold is made once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and all runs in this one process (master local) a folder is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="clauseflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(frame: DataFrame) -> DataFrame:
    """frame as a Parquet table: it cuts lineage, survives lost executors, and calls of a model in it are not repeated."""
    path = f"{shared_dir(frame.sparkSession)}/clauseflow/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
