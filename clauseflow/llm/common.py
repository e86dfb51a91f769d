"""Shared plumbing of the training-data operators: table access, shared scratch tables, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words everywhere in this subpackage.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset and all runs in this one process (master
    local, as in tests) one is made; on a cluster that would be a folder of the driver's machine alone, so it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="clauseflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/clauseflow/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: it cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by saved()."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@dataclass(frozen=True)
class Placed:
    """A frame and a column that tells its rows apart and says where they stand: struct<part, file, row>."""

    frame: DataFrame
    column: Column


def placed(df: DataFrame) -> Placed:
    """df with the place of each row in its files, ascending as they were written: the writer's part, the file, the row.

    A frame that isn't read straight from files is written first. The column must be used in the first select.
    """
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta["row_index"])
    except (AnalysisException, AttributeError):
        return placed(saved(df, "placed"))
    part = F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1)
    return Placed(df, F.struct(F.when(part != "", part.cast("long")).alias("part"), meta["file_path"].alias("file"), meta["row_index"].alias("row")))


def tucked(df: DataFrame, needed: list[str], place: Column | None = None) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with its needed columns and all others inside one struct, where their names can't clash, and the way back.

    The way back selects df's columns, in their order, from a frame that still has those columns. place: of placed(),
    becomes a column of that name.
    """
    others = [c for c in df.columns if c not in needed]
    inside = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    names = list(df.columns)

    def back(frame: DataFrame, *more: Column) -> DataFrame:
        return frame.select(*[F.col(f"tucked_columns.`{c}`").alias(c) if c in others else F.col(c) for c in names], *more)

    return df.select(*needed, inside.alias("tucked_columns"), *([] if place is None else [place.alias("place")])), back


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def dense_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number the rows of a narrow table from 0 in ascending order of its keys (column idx), without one big task.

    A range partitioning sorts the rows; the rows of each partition are counted, and each count's prefix sum
    (one small row for each partition) is where that partition's numbering begins.
    """
    spark = df.sparkSession
    n = shuffle_width(spark)
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = saved(ranged, "ordered")
    part = F.shiftright("_mid", 33)
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect())
    begins, total = [], 0
    for p, c in counts:
        begins.append((p, total))
        total += c
    offsets = spark.createDataFrame(begins or [(0, 0)], "_p long, _begin long")
    return (
        ranged.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")  # a row for each shuffle partition
        .withColumn("idx", F.col("_begin") + F.col("_mid").bitwiseAND((1 << 33) - 1))
        .drop("_p", "_begin", "_mid")
    )
