"""Integrity checks of a clause tree, as one table of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

THRESHOLD = 0.90
ISSUE = ("contract_id", "code", "severity", "refixable", "block_ids", "clause_ids")


def _issue(rows: DataFrame, code: str, severity: str, refixable: bool, blocks: Column | None = None, found: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.select("contract_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(refixable).alias("refixable"), (none if blocks is None else blocks).alias("block_ids"), (none if found is None else found).alias("clause_ids"))


def references(tree: DataFrame) -> DataFrame:
    return tree.select("contract_id", "clause_id", F.explode("block_ids").alias("block_id"))


def duplicate_block_ids(blocks: DataFrame) -> DataFrame:
    rows = blocks.groupBy("contract_id", "block_id").count().filter("count > 1")
    return _issue(rows, "duplicate_block_id", "error", False, F.array("block_id"))


def orphan_references(blocks: DataFrame, tree: DataFrame) -> DataFrame:
    rows = references(tree).join(blocks.select("contract_id", "block_id").distinct(), ["contract_id", "block_id"], "left_anti")
    return _issue(rows, "orphan_block_reference", "error", False, F.array("block_id"), F.array("clause_id"))


def uncovered_blocks(blocks: DataFrame, tree: DataFrame) -> DataFrame:
    rows = blocks.select("contract_id", "block_id").distinct().join(references(tree), ["contract_id", "block_id"], "left_anti")
    return _issue(rows, "uncovered_block", "error", True, F.array("block_id"))


def duplicated_blocks(tree: DataFrame) -> DataFrame:
    rows = references(tree).groupBy("contract_id", "block_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("clause_id")).alias("held")).filter("n > 1")
    return _issue(rows, "duplicated_block", "error", True, F.array("block_id"), F.col("held"))


def boundary_mismatch(blocks: DataFrame, decided: DataFrame) -> DataFrame:
    want = blocks.groupBy("contract_id").agg((F.count("*") - 1).alias("want"))
    have = decided.groupBy("contract_id").agg(F.count("*").alias("have"))
    rows = want.join(have, "contract_id", "full").filter(F.coalesce("want", F.lit(0)) != F.coalesce("have", F.lit(0)))
    return _issue(rows, "boundary_mismatch", "error", False)


def boundary_order(blocks: DataFrame, decided: DataFrame) -> DataFrame:
    """The first boundary of a contract that doesn't join the blocks at its place, where their counts agree."""
    places = blocks.select("contract_id", F.col("seq"), F.col("block_id").alias("want_right"))
    left = blocks.select("contract_id", (F.col("seq") + 1).alias("seq"), F.col("block_id").alias("want_left"))
    off = decided.join(places, ["contract_id", "seq"]).join(left, ["contract_id", "seq"]).filter("left_id <> want_left or right_id <> want_right")
    rows = off.groupBy("contract_id").agg(F.min_by(F.array("left_id", "right_id"), "seq").alias("pair"))
    return _issue(rows.join(boundary_mismatch(blocks, decided).select("contract_id"), "contract_id", "left_anti"), "boundary_order_mismatch", "error", False, F.col("pair"))


def missing_parents(tree: DataFrame) -> DataFrame:
    ids = tree.select("contract_id", F.col("clause_id").alias("parent_id")).distinct()
    rows = tree.filter("parent_id is not null").join(ids, ["contract_id", "parent_id"], "left_anti")
    return _issue(rows, "missing_parent", "error", True, None, F.array("clause_id"))


def parent_levels(tree: DataFrame) -> DataFrame:
    parents = tree.select("contract_id", F.col("clause_id").alias("parent_id"), F.col("level").alias("parent_level"))
    rows = tree.join(parents, ["contract_id", "parent_id"]).filter("parent_level >= level")
    return _issue(rows, "parent_level_invalid", "error", True, None, F.array("clause_id", "parent_id"))


def decimal_parents(tree: DataFrame) -> DataFrame:
    """a.b.c before any a.b, and no parent: labels are compared without a final dot or mark; whole numbers count as parents."""
    plain = F.regexp_replace("label", "[.、]+$", "")
    rows = tree.withColumn("plain", plain)
    wanted = rows.filter(F.regexp_like("plain", F.lit(r"(?U)^\d+(?:\.\d+)+$")) & F.col("parent_id").isNull()).withColumn("want", F.regexp_replace("plain", r"\.[^.]*$", ""))
    first = rows.filter(F.regexp_like("plain", F.lit(r"(?U)^\d+(?:\.\d+)*$"))).groupBy("contract_id", F.col("plain").alias("want")).agg(F.min("clause_seq").alias("first"))
    rows = wanted.join(first, ["contract_id", "want"], "left").filter("first is null or first >= clause_seq")
    return _issue(rows, "decimal_parent_missing", "warning", True, None, F.array("clause_id"))


def duplicate_labels(tree: DataFrame) -> DataFrame:
    plain = F.regexp_replace("label", "[.、]+$", "")
    rows = tree.withColumn("plain", plain).filter(~F.col("label").isin(*P.NO_LABEL) & ~F.col("plain").isin(*P.NO_LABEL))
    rows = rows.groupBy("contract_id", "plain").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("clause_id")).alias("held")).filter("n > 1")
    return _issue(rows, "duplicate_label", "warning", True, None, F.col("held"))


def low_confidence(decided: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = decided.filter(F.col("confidence") < threshold).select("contract_id", F.explode(F.array("left_id", "right_id")).alias("block_id"))
    return _issue(rows.groupBy("contract_id").agg(F.sort_array(F.collect_set("block_id")).alias("held")), "low_confidence_boundary", "warning", True, F.col("held"))


def issues(blocks: DataFrame, tree: DataFrame, decided: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All checks: contract_id, code, severity, refixable, block_ids, clause_ids."""
    found = [
        duplicate_block_ids(blocks), orphan_references(blocks, tree), uncovered_blocks(blocks, tree), duplicated_blocks(tree), boundary_mismatch(blocks, decided),
        boundary_order(blocks, decided), missing_parents(tree), parent_levels(tree), decimal_parents(tree), duplicate_labels(tree), low_confidence(decided, threshold),
    ]
    return reduce(DataFrame.unionByName, found)
