"""Text files to blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text

SUFFIXES = (".txt", ".docx", ".pdf")
MAX_BYTES = 25 * 1024 * 1024


def files(spark: SparkSession, path: str) -> DataFrame:
    """Uploads under a path: filename (without folders), suffix, length, content. Spark's scan leaves out files of no bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
    return rows.select(name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), "length", "content")


def validated(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): known suffix, not empty, at most 25 MiB."""
    reason = F.when(~F.col("suffix").isin(*SUFFIXES), "unsupported suffix").when(F.col("length") == 0, "empty file").when(F.col("length") > MAX_BYTES, "too large")
    rows = uploads.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").drop("content")


def decoded(uploads: DataFrame) -> DataFrame:
    """content as text: UTF-8 without its mark, natively; other bytes as GB18030, the only rows that reach Python."""

    @F.pandas_udf("string")
    def from_gb18030(content: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else bytes(c).decode("gb18030", "replace") for c in content])

    good = F.is_valid_utf8(F.col("content").cast("string"))
    utf8 = uploads.filter(good).withColumn("text", F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")).withColumn("encoding", F.lit("utf-8"))
    other = uploads.filter(~good).withColumn("text", from_gb18030("content")).withColumn("encoding", F.lit("gb18030"))
    return utf8.unionByName(other)


def text_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of texts (contract_id, text): cut at blank lines and line ends, cleaned, empty ones dropped.

    source_line is the place of the piece among all pieces, which is not the line number where blank lines run together.
    """
    pieces = F.split(F.coalesce("text", F.lit("")), r"(?U)\n\s*\n|\r?\n", -1)
    rows = texts.select("contract_id", F.posexplode(pieces).alias("i", "raw_text"))
    rows = rows.withColumn("text", clean_text(F.col("raw_text"))).filter("text <> ''")
    seq = F.row_number().over(W.partitionBy("contract_id").orderBy("i"))
    return rows.select("contract_id", seq.alias("seq"), F.format_string("B%04d", seq).alias("block_id"), F.lit("paragraph").alias("kind"), "text", "raw_text", (F.col("i") + 1).alias("source_line"))
