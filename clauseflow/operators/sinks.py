"""Nested JSON of parsed contracts, the only place where ids and structs replace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import structure


def _ordered(frame: DataFrame, order: str, name: str) -> DataFrame:
    columns = [c for c in frame.columns if c not in ("contract_id", order)]
    return frame.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))


def parse_json(blocks: DataFrame, tree: DataFrame, decided: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One JSON for each contract: blocks, clauses, boundaries, warnings (contract_id, warnings) and stats."""
    found = structure.stats(blocks, tree, decided)
    rows = found.select("contract_id", F.struct(*[c for c in found.columns if c != "contract_id"]).alias("stats"))
    for frame, order, name in ((blocks.drop("heading"), "seq", "blocks"), (tree, "clause_seq", "clauses"), (decided, "seq", "boundaries")):
        rows = rows.join(_ordered(frame, order, name), "contract_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("warnings", none) if warnings is None else rows.join(warnings, "contract_id", "left").withColumn("warnings", F.coalesce("warnings", none))
    return rows.select("contract_id", F.to_json(F.struct("blocks", "clauses", "boundaries", "warnings", "stats")).alias("json"))


def contract_json(tree: DataFrame, elements: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """The contract with its elements by kind, and its review's findings JSON (contract_id, json) where there is one."""
    item = F.struct("seq", "element_id", "kind", "value", "normalized", "role", "clause_id", "confidence", "source")
    kinds = {"parties": "party", "amounts": "amount", "dates": "date", "subjects": "subject"}
    grouped = elements.groupBy("contract_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, item))).alias(n) for n, k in kinds.items()])
    rows = _ordered(tree, "clause_seq", "clauses").join(grouped, "contract_id", "left")
    fields = [F.lit("m2").alias("schema_version"), "contract_id", "clauses", F.struct(*kinds).alias("elements")]
    if review is not None:
        rows = rows.join(review.select("contract_id", F.parse_json("json").alias("review")), "contract_id", "left")
        fields.append("review")
    return rows.select("contract_id", F.to_json(F.struct(*fields)).alias("json"))


def findings_json(found: DataFrame, tree: DataFrame) -> DataFrame:
    """The findings of each contract that has any, with the blocks of the clauses they name."""
    blocks = found.select("contract_id", "finding_id", F.explode("clause_ids").alias("clause_id")).join(tree.select("contract_id", "clause_id", F.explode("block_ids").alias("block_id")), ["contract_id", "clause_id"])
    blocks = blocks.groupBy("contract_id", "finding_id").agg(F.sort_array(F.collect_set("block_id")).alias("block_ids"))
    rows = found.join(blocks, ["contract_id", "finding_id"], "left").withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))
    columns = ("finding_id", "code", "severity", "message", "evidence", "clause_ids", "block_ids", "source", "confidence")
    rows = rows.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("findings"))
    return rows.select("contract_id", F.to_json(F.struct(F.lit("m4").alias("schema_version"), "contract_id", "findings")).alias("json"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, of all columns: statutes after their tags were merged, or any of the JSON tables here."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
