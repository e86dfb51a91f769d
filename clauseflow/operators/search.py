"""Small queries of a reviewer's desk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clause_filter(clauses: DataFrame, query: str) -> DataFrame:
    """Clauses whose label, title or text holds the trimmed query, whatever the case; an empty query keeps all."""
    wanted = query.strip().lower()
    hit = F.lit(False)
    for column in ("label", "title", "text"):
        hit = hit | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(wanted))
    return clauses.filter(hit) if wanted else clauses


def boundary_filter(decided: DataFrame, only_review: bool) -> DataFrame:
    return decided.filter("review_required") if only_review else decided


def overview(clauses: DataFrame) -> DataFrame:
    pages = F.when(F.col("page_start").isNull(), "").when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", "page_start", "page_end"))
    return clauses.select("contract_id", "clause_id", "label", "title", "level", pages.alias("pages"), F.length("text").alias("characters"))


def risk_clauses(risks: DataFrame, clauses: DataFrame) -> DataFrame:
    """A row for each clause that a risk names, with its text; null for unknown clauses."""
    rows = risks.select("contract_id", "risk_id", "code", "evidence", F.explode("clause_ids").alias("clause_id"))
    return rows.join(clauses.select("contract_id", "clause_id", "label", "text"), ["contract_id", "clause_id"], "left")


def highlighted(text: Column, needles: Column, before: str = "【", after: str = "】") -> Column:
    """The text with every place of the first needle that it holds marked."""
    found = F.get(F.filter(needles, lambda n: (n != "") & F.contains(text, n)), F.lit(0))
    return F.when(found.isNull(), text).otherwise(F.replace(text, found, F.concat(F.lit(before), found, F.lit(after))))
