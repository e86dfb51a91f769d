"""What elements say by themselves: amounts out of range, impossible terms, kinds that are missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import date_key_of, digits, let, matches
from .elements import ITEMS, KINDS

_NOTED = "array<struct<kind:string,note:string,clause_id:string,value:string>>"


def _amount_note(normalized: Column, value: Column, role: Column) -> Column:
    name = F.coalesce(F.nullif(role, F.lit("")), F.lit("金额"))
    low, high = F.concat(name, F.lit("为 "), value, F.lit(" 元（非正数）")), F.concat(name, F.lit("高达 "), value, F.lit(" 元"))
    number = F.coalesce(F.nullif(normalized, F.lit("")), value).try_cast("double")
    return let(number, lambda v: F.when(v <= 0, low).when(v >= P.EXTREME_AMOUNT, high))


def _terms(text: Column) -> Column:
    """The matches of terms whose real start date is after the real end, with the two days; a date that no calendar has gives none."""
    day = lambda c: F.try_to_date(date_key_of(digits(c)), "yyyy-MM-dd")
    found = F.transform(matches(text, P.TERM_RANGE, 2, "止"), lambda m: F.struct(day(m["g1"]).alias("a"), day(m["g2"]).alias("b"), m["g0"].alias("g0")))
    return F.filter(found, lambda m: F.coalesce(m["a"] > m["b"], F.lit(False)))


def _term_note(a: Column, b: Column) -> Column:
    return F.concat(F.lit("期限倒置：起始 "), a.cast("string"), F.lit(" 晚于结束 "), b.cast("string"))


def amount_signals(elements: DataFrame) -> DataFrame:
    rows = elements.filter("kind = 'amount'").withColumn("note", _amount_note(F.col("normalized"), F.col("value"), F.col("role")))
    return rows.filter("note is not null").select("contract_id", F.lit("amount").alias("kind"), "note", F.coalesce("clause_id", F.lit("")).alias("clause_id"), "value")


def date_signals(clauses: DataFrame) -> DataFrame:
    """Terms whose real start date is after the real end; a date that no calendar has gives no signal."""
    rows = clauses.select("contract_id", "clause_id", F.explode(_terms(F.coalesce("text", F.lit("")))).alias("m"))
    return rows.select("contract_id", F.lit("date").alias("kind"), _term_note(F.col("m.a"), F.col("m.b")).alias("note"), "clause_id", F.col("m.g0").alias("value"))


def missing_signals(contracts: DataFrame, elements: DataFrame) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("note")) for k, n in P.MISSING_NOTES.items()]))
    slots = contracts.select("contract_id").distinct().select("contract_id", kinds.alias("s")).select("contract_id", "s.kind", "s.note")
    rows = slots.join(elements.select("contract_id", "kind").distinct(), ["contract_id", "kind"], "left_anti")
    return rows.select("contract_id", F.lit("completeness").alias("kind"), "note", F.lit("").alias("clause_id"), F.lit("").alias("value"))


def signals(clauses: DataFrame, elements: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [amount_signals(elements), date_signals(clauses), missing_signals(clauses, elements)])


def pattern_signals(clauses: DataFrame) -> DataFrame:
    """signals(clauses, elements.extract(clauses)) in one pass: clauses are read once, and their texts don't travel.

    What a clause says becomes a few structs, gathered by contract; clauses dealt by contract are not dealt again.
    """
    text = F.coalesce("text", F.lit(""))
    found = clauses.select("contract_id", "clause_id", _terms(text).alias("_terms"), *[ITEMS[k](text).alias(f"_{k}") for k in KINDS])
    id_ = F.coalesce("clause_id", F.lit(""))
    noted = F.transform("_amount", lambda x: F.struct(F.lit("amount").alias("kind"), _amount_note(x["normalized"], x["value"], x["role"]).alias("note"), id_.alias("clause_id"), x["value"].alias("value")))
    dated = F.transform("_terms", lambda m: F.struct(F.lit("date").alias("kind"), _term_note(m["a"], m["b"]).alias("note"), F.col("clause_id").alias("clause_id"), m["g0"].alias("value")))
    said = F.concat(F.filter(noted, lambda x: x["note"].isNotNull()).cast(_NOTED), dated.cast(_NOTED))
    rows = found.select("contract_id", said.alias("_said"), *[(F.size(f"_{k}") > 0).alias(f"_{k}") for k in KINDS])
    held = rows.groupBy("contract_id").agg(F.flatten(F.collect_list(F.when(F.size("_said") > 0, F.col("_said")))).alias("_said"), *[F.max(f"_{k}").alias(f"_{k}") for k in KINDS])
    lacking = [F.when(~F.col(f"_{k}") if k in KINDS else F.lit(True), F.struct(F.lit("completeness").alias("kind"), F.lit(n).alias("note"), F.lit("").alias("clause_id"), F.lit("").alias("value"))) for k, n in P.MISSING_NOTES.items()]
    missing = F.filter(F.array(*lacking), lambda x: x.isNotNull()).cast(_NOTED)
    return held.select("contract_id", F.explode(F.concat("_said", missing)).alias("s")).select("contract_id", "s.kind", "s.note", "s.clause_id", "s.value")
