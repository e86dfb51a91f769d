"""Parties, amounts, dates and subjects of clauses by patterns; merging of several sources of elements.

Clauses: contract_id, clause_seq, clause_id, text, block_ids. Elements: contract_id, seq, element_id, kind, value,
normalized, role, clause_seq, clause_id, block_ids, confidence, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import contained, date_key, let, matches, money_number, nearest_role, party_name, strip
from ..scratch import written
from .fold import by_group, packed_by_budget
from .schemas import DDL

KINDS = ("party", "amount", "date", "subject")
_ITEM = "array<struct<at:int,kind:string,value:string,normalized:string,role:string,confidence:double>>"


def _item(at, kind: str, value: Column, normalized: Column, role: Column, confidence: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), value.alias("value"), normalized.alias("normalized"), role.alias("role"), confidence.cast("double").alias("confidence"))


def is_party(name: Column) -> Column:
    return (F.length(name) >= 2) & ~name.isin(*P.PARTY_BLOCKED)


def party_items(text: Column) -> Column:
    def of(m: Column) -> Column:
        role = F.when((m["g1"] != "") & (m["g2"] != ""), F.concat(m["g1"], F.lit("（"), m["g2"], F.lit("）"))).when(m["g1"] != "", m["g1"]).otherwise(m["g3"])
        return let(party_name(m["g4"]), lambda name: _item(m["start"], "party", name, name, role, F.lit(0.92)))

    return F.filter(F.transform(matches(text, P.PARTY, 4, ("：", ":")), of), lambda x: is_party(x["value"])).cast(_ITEM)


def amount_items(text: Column) -> Column:
    def of(m: Column) -> Column:
        role = nearest_role(text, m["start"], P.MONEY_ROLES)
        marked = ~m["g1"].isin("", "-") | m["g0"].contains("小写")
        return _item(m["start"], "amount", m["g2"], money_number(m["g2"]), F.coalesce(F.nullif(role, F.lit("")), F.lit("金额")), F.when(marked, 0.9).otherwise(0.82))

    return F.transform(matches(text, P.MONEY, 2, "元"), of).cast(_ITEM)


def date_items(text: Column) -> Column:
    def of(m: Column) -> Column:
        role = nearest_role(text, m["start"], P.DATE_ROLES)
        return _item(m["start"], "date", m["g0"], date_key(m["g1"], m["g2"], m["g3"]), F.coalesce(F.nullif(role, F.lit("")), F.lit("日期")), F.lit(0.9))

    return F.transform(matches(text, P.DATE, 3, "年"), of).cast(_ITEM)


def subject_items(text: Column) -> Column:
    """At most one address (none of land or land use) and one floor area."""
    place, area = F.regexp_extract(text, P.ADDRESS, 1), F.regexp_extract(text, P.AREA, 1)
    address = F.when((place != "") & ~F.regexp_like(place, F.lit("土地|使用权")), _item(F.lit(0), "subject", place, place, F.lit("坐落地址"), F.lit(0.85)))
    floor = F.when(area != "", _item(F.lit(1), "subject", F.concat(area, F.lit("平方米")), area, F.lit("建筑面积"), F.lit(0.85)))
    return F.filter(F.array(address, floor), lambda x: x.isNotNull()).cast(_ITEM)


ITEMS = {"party": party_items, "amount": amount_items, "date": date_items, "subject": subject_items}


def extract(clauses: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """All elements of the kinds in document order: by clause, then kind, then place. seq counts those of the kinds asked for."""
    text = F.coalesce("text", F.lit(""))
    found = {f"_{k}": ITEMS[k](text) for k in KINDS if k in kinds}
    rows = clauses.select("contract_id", "clause_seq", "clause_id", "block_ids", *[c.alias(n) for n, c in found.items()])
    rows = rows.select("contract_id", "clause_seq", "clause_id", "block_ids", F.posexplode(F.concat(*found)).alias("_i", "_x"))
    order = W.partitionBy("contract_id").orderBy("clause_seq", "_i")
    rows = rows.select("contract_id", F.row_number().over(order).alias("seq"), "clause_seq", "clause_id", "block_ids", "_x.kind", "_x.value", "_x.normalized", "_x.role", "_x.confidence")
    return rows.withColumn("element_id", F.format_string("E%04d", "seq")).withColumn("source", F.lit("rule"))


def merge_key(kind: Column, normalized: Column, value: Column) -> Column:
    raw = F.coalesce(F.nullif(normalized, F.lit("")), value)
    amount = money_number(strip(F.replace(F.replace(raw, F.lit("人民币"), F.lit("")), F.lit("元"), F.lit(""))))
    return F.when(kind == "amount", amount).otherwise(F.lower(F.regexp_replace(raw, r"(?U)[\s,，。；;:：()（）]", "")))


def merge_amounts(elements: DataFrame) -> DataFrame:
    """Amounts of equal value become one: the surest, the first of equals, at the place of the first."""
    rows = elements.filter("kind = 'amount'").withColumn("_key", merge_key(F.col("kind"), F.col("normalized"), F.col("value"))).filter("_key <> ''")
    best = W.partitionBy("contract_id", "_key").orderBy(F.desc("confidence"), "seq")
    first = F.min("seq").over(W.partitionBy("contract_id", "_key"))
    return rows.withColumn("_first", first).withColumn("_n", F.row_number().over(best)).filter("_n = 1").withColumn("seq", F.col("_first")).drop("_key", "_first", "_n")


def merge(elements: DataFrame) -> DataFrame:
    """Elements of all sources, in order of seq, without repeats, numbered anew.

    Equal keys are one element; a party, date or subject also joins the first earlier one that contains it or that it
    contains. The surest copy stays, at the place and under the key of the first.
    """
    names = elements.columns
    rows = elements.withColumn("_key", merge_key(F.col("kind"), F.col("normalized"), F.col("value"))).filter("_key <> ''")
    row = F.struct(F.col("confidence").alias("sure"), (-F.col("seq")).alias("late"), F.struct(*names).alias("row"))
    # Copies of a key join the same element, so that only different keys are compared, and keys of one length never join.
    keys = rows.groupBy("contract_id", "kind", "_key").agg(F.min("seq").alias("place"), F.max_by(row, F.struct("confidence", -F.col("seq"))).alias("best"))
    groups = keys.groupBy("contract_id", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "_key", "best"))).alias("held"), (F.min(F.length("_key")) < F.max(F.length("_key"))).alias("uneven"))
    close = F.exists("held", lambda x: F.exists("held", lambda y: (x["place"] != y["place"]) & contained(x["_key"], y["_key"])))
    merged = F.when((F.col("kind") != "amount") & F.col("uneven") & close, _joined(F.col("held"))).otherwise(F.col("held"))
    out = groups.select("contract_id", F.explode(merged).alias("x")).select("contract_id", *[F.col(f"x.best.row.{c}").alias(c) for c in names if c not in ("contract_id", "seq", "element_id")], F.col("x.place").alias("_place"))
    out = out.withColumn("seq", F.row_number().over(W.partitionBy("contract_id").orderBy("_place")))
    return out.withColumn("element_id", F.format_string("E%04d", "seq")).select(*names)


def _joined(held: Column) -> Column:
    """The keys of one group in order, each joined to the first before it that contains it or that it contains."""

    def step(out: Column, x: Column) -> Column:
        fits = F.transform(out, lambda h: contained(h["_key"], x["_key"]))
        at = F.array_position(fits, True)
        better = lambda h: F.struct(x["best"]["sure"], x["best"]["late"]) > F.struct(h["best"]["sure"], h["best"]["late"])
        changed = F.transform(out, lambda h, i: F.when((i + 1 == at) & better(h), F.struct(h["place"], h["_key"], x["best"].alias("best"))).otherwise(h))
        return F.when(at > 0, changed).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(held, F.slice(held, 1, 0), step)


def batches(clauses: DataFrame, budget: int = 8_000, cut: int = 2_000) -> DataFrame:
    """clauses with the batch each goes to a model in: at most `cut` signs of a clause count, batches hold `budget`."""
    sized = clauses.select("contract_id", "clause_seq", F.length(F.substring("text", 1, cut)).alias("size"), F.lit(0).alias("batch"))

    def number(rows: list[dict]) -> list[dict]:
        return [row | {"batch": b} for row, b in zip(rows, packed_by_budget([r["size"] for r in rows], budget), strict=True)]

    placed = by_group(sized, ["contract_id"], ["clause_seq"], number)
    return clauses.join(placed.drop("size"), ["contract_id", "clause_seq"])


MODEL_ITEMS = DDL["contract_element_extraction"]


def from_model(responses: DataFrame, clauses: DataFrame) -> DataFrame:
    """Elements of model answers (contract_id, response): empty values go, unknown clauses are null, numbers are clamped."""
    if "batch" not in responses.columns:
        responses = responses.withColumn("batch", F.lit(0))
    parsed = responses.select("contract_id", "batch", F.from_json("response", MODEL_ITEMS).alias("r"))
    kinds = {"parties": "party", "amounts": "amount", "dates": "date", "subjects": "subject"}
    rows = parsed.select("contract_id", "batch", F.explode(F.concat(*[F.transform(F.coalesce(f"r.{k}", F.array().cast("array<struct<value:string,normalized:string,role:string,clause_id:string,source_text:string,confidence:double>>")), _tagged(v)) for k, v in kinds.items()])).alias("x"))
    rows = rows.select("contract_id", "batch", "x.*").withColumn("value", F.substring(strip(F.coalesce("value", F.lit(""))), 1, 200)).filter("value <> ''")
    known = clauses.select("contract_id", "clause_id", "clause_seq", "block_ids")
    rows = rows.join(known, ["contract_id", "clause_id"], "left").withColumn("clause_id", F.when(F.col("clause_seq").isNotNull(), F.col("clause_id")))
    return rows.select(
        "contract_id", "clause_seq", "clause_id", F.coalesce("block_ids", F.array().cast("array<string>")).alias("block_ids"), "kind", "value",
        F.substring(F.coalesce("normalized", F.lit("")), 1, 80).alias("normalized"), F.substring(F.coalesce("role", F.lit("")), 1, 40).alias("role"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))), 2).alias("confidence"), F.lit("llm").alias("source"), "batch",
    )


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"), x["normalized"].alias("normalized"), x["role"].alias("role"), x["clause_id"].alias("clause_id"), x["confidence"].alias("confidence"))


def with_model(tree: DataFrame, responses: DataFrame, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(elements, summary) by patterns and by a model's answers (contract_id, batch, response), merged; patterns come first.

    An answer that failed costs its own batch alone. summary: a row for each contract with clauses, rule_elements,
    batches, succeeded, llm_elements, merged_elements.
    """
    responses, rules = written(responses), written(extract(tree, kinds))  # each is read several times, and plans stay small
    good = responses.filter(F.from_json("response", MODEL_ITEMS).isNotNull())
    said = from_model(good, tree)
    order = W.partitionBy("contract_id").orderBy("batch", "clause_seq", "kind", "value")
    last = rules.groupBy("contract_id").agg(F.max("seq").alias("_n"))
    said = said.join(last, "contract_id", "left").withColumn("seq", F.coalesce("_n", F.lit(0)) + F.row_number().over(order)).drop("_n", "batch")
    said = said.withColumn("element_id", F.format_string("E%04d", "seq"))
    said = written(said.select(*rules.columns))
    merged = written(merge(rules.unionByName(said)))
    count = lambda frame, name: frame.groupBy("contract_id").agg(F.count("*").alias(name))
    summary = count(tree, "clauses")
    for frame, name in ((rules, "rule_elements"), (responses, "batches"), (good, "succeeded"), (said, "llm_elements"), (merged, "merged_elements")):
        summary = summary.join(count(frame, name), "contract_id", "left")
    return merged, summary.na.fill(0)
