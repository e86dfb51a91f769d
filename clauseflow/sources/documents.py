"""All uploads to blocks, and the other files of a deployment: statutes, dataset manifests, settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contract_id
from . import docx, pdf, text

ARTICLES = "article_uid string, law_name string, article_no string, content string, authority_level string, jurisdiction string, effective_from string, effective_to string, status string, contract_types array<string>, risk_tags array<string>, source_url string, version_id string"
BLOCKS = ("filename", "seq", "block_id", "kind", "text", "raw_text", "page", "numbering_label", "list_level", "style_name", "outline_level")


def parse_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of uploads (filename, suffix, length, content) of any known kind; a file without a block is an error."""
    good, bad = text.validated(uploads)
    plain = text.text_blocks(text.decoded(good.filter("suffix = '.txt'")).withColumn("contract_id", F.col("filename"))).withColumnRenamed("contract_id", "filename")
    word, word_bad = docx.docx_blocks(good.filter("suffix = '.docx'"))
    pages, pages_bad = pdf.pdf_blocks(good.filter("suffix = '.pdf'"))
    parts = [p.select(*[c for c in BLOCKS if c in p.columns]) for p in (plain, word, pages)]
    blocks = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    empty = good.filter("suffix = '.txt'").select("filename").join(plain.select("filename").distinct(), "filename", "left_anti").withColumn("error", F.lit("no text"))
    errors = bad.select("filename", F.col("reason").alias("error")).unionByName(word_bad).unionByName(pages_bad).unionByName(empty)
    return blocks, errors


def with_contract_id(blocks: DataFrame) -> DataFrame:
    """blocks with the contract_id of their file: a hash of its name and its texts joined by blank lines."""
    whole = blocks.groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("full"))
    return blocks.join(whole.select("filename", contract_id(F.col("filename"), F.col("full")).alias("contract_id")), "filename")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLES).json(path).filter("article_uid is not null")


def read_manifest(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records of a dataset manifest; record: their DDL schema."""
    return spark.read.schema(f"records array<struct<{record}>>").option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")


def settings(path: str | Path, defaults: dict[str, str]) -> dict[str, str]:
    """Values from the environment, else a .env file, else the defaults; lines that are no assignment are skipped."""
    found: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and name.strip() and not name.startswith("#"):
                value = value.strip()
                found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return defaults | found | {k: os.environ[k] for k in {*defaults, *found} if k in os.environ}
