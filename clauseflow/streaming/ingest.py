"""Contracts as a stream: files are parsed and reviewed as they arrive, each micro-batch by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, elements, structure
from ..sources.text import text_blocks


def arriving_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder as they come: contract_id (the file's name) and text, whole."""
    rows = spark.readStream.format("text").option("wholetext", True).load(path)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("contract_id"), F.col("value").alias("text"))


def review_stream(texts: DataFrame, out: str, checkpoint: str):
    """Write the findings of each arriving contract under `out`, a folder for each micro-batch, so that a repeated batch
    replaces its own."""

    def review(batch: DataFrame, number: int) -> None:
        _, _, tree = structure.analyze(text_blocks(batch).withColumn("source_block", F.col("block_id")))
        checks.findings(tree, elements.extract(tree)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(review).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
