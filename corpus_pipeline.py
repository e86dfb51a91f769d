"""From raw documents to packed training sequences: five stages, each one operator of clauseflow.llm over whole tables.

1. Language ID drops documents without a letter and those whose best language is not surely ahead.
2. The n-gram Jaccard join leaves one document of each group of near copies, the one with the least id.
3. PII spans are replaced by their kind.
4. The curriculum mix takes documents of each source up to its target, repeats and all, in training order.
5. Best-fit packing lays the token pieces into sequences of 2048, range by range of that order.

Every stage gets what the one before left, as written Parquet. Stages 1 to 4 return the columns of documents; extra
columns of the input pass through. A copy that the mix repeats keeps its doc_id, and the packing places each copy.
n_chars follows the text where a stage changes it. An empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseflow import ship
from clauseflow.llm import jaccard, language, mixing, packing, pii
from clauseflow.llm.common import saved, tucked

#: The least score of a language that is kept; with equal priors, one language is then likelier than all others together.
LEAST_SCORE = 0.5
#: Near copies share so many hundredths of their shingles of so many words.
COPY_PERCENT, COPY_SHINGLE = 80, 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no language: no text, no letter, or no language likelier than the others together."""
    ship(spark)
    model = language.fit(language.training_rows(docs))
    if not model.languages:  # nothing to learn from, nothing to reject by
        return docs
    rows, back = tucked(docs, ["text"])
    found = language.predict(rows, model, "_lang", "_score")
    return back(found.filter((F.col("_lang") != language.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the least id; of repeated rows, one.

    Documents without words are no copies of each other and all stay. A group without any id keeps one of its rows.
    """
    ship(spark)
    groups = saved(jaccard.similar_components(docs, COPY_PERCENT, COPY_SHINGLE), "groups")
    # The join names a component by its least id; its first text of that id (by hash) is the one that stays.
    firsts = groups.filter("n_shingles > 0").groupBy("component_id").agg(F.min("h").alias("h_any"), F.min(F.when(F.col("doc_id") == F.col("component_id"), F.col("h"))).alias("h_own"))
    firsts = firsts.select(F.col("component_id").alias("_id"), F.coalesce("h_own", "h_any").alias("_h"))
    blank = groups.filter("n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows, back = tucked(docs, ["doc_id", "text"])
    keyed = rows.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_h"))
    empty = keyed.join(blank, key, "left_semi")
    own = W.partitionBy("doc_id", "_text_hash").orderBy(F.lit(1))
    kept = keyed.join(firsts, key, "left_semi").withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
    return back(kept.unionByName(empty))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars is that of the new text."""
    ship(spark)
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    ship(spark)
    return mixing.training_order(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences, which follow the order the mix wrote them in."""
    ship(spark)
    return packing.packed_in_order(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_copies),
    ("pii", personal_data),
    ("curriculum_mix", mix),
    ("best_fit_packing", packed),
]

#: No stage but the second can be told in SQL; tests/llm holds the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(ship(spark), docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
