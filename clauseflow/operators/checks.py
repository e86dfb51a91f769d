"""Consistency of a contract's amounts, dates, parties and attachments, as one table of findings.

Findings: contract_id, seq, finding_id, code, severity, message, evidence, clause_ids, confidence, source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import chinese_number, date_key, date_key_of, groups_of, let, lookup, matches, nearest_role, party_name, party_side, plain_number, strip, window_before
from .elements import is_party
from .schemas import DDL, FINDING_CODES

CODES = ("amount_conflict", "date_conflict", "party_conflict", "reference_conflict")
MESSAGE_KEY = 80  # signs of a message, without blanks, by which findings of a code are told apart
DEPOSITS, BALANCES, TOTAL = ("首付款", "定金", "预付款"), ("余款",), "合同总价"


def _finding(rows: DataFrame, code: str, message: Column, evidence: Column, clause_ids: Column, confidence: Column, order: Column, severity: Column | None = None) -> DataFrame:
    grade = F.lit("high" if code in ("amount_conflict", "party_conflict") else "medium") if severity is None else severity
    return rows.select(
        "contract_id", F.lit(code).alias("code"), grade.alias("severity"), message.alias("message"), evidence.alias("evidence"),
        clause_ids.alias("clause_ids"), confidence.cast("double").alias("confidence"), order.cast("string").alias("_order"),
    )


def check_amounts(elements: DataFrame) -> DataFrame:
    """Distinct part payments against the first total; all of total, deposit and balance must be there."""
    value = F.coalesce(F.nullif(F.col("normalized"), F.lit("")), F.col("value")).try_cast("double")
    rows = elements.filter("kind = 'amount'").withColumn("v", value)
    paid = F.col("role").isin(*DEPOSITS, *BALANCES)
    label = lambda: F.concat(F.col("role"), F.lit(" "), F.coalesce(F.nullif(F.col("normalized"), F.lit("")), F.col("value")), F.lit("（"), F.coalesce("clause_id", F.lit("")), F.lit("）"))
    rows = rows.filter(paid | (F.col("role") == TOTAL)).groupBy("contract_id").agg(
        F.min_by(F.when(F.col("role") == TOTAL, F.col("v")), F.when(F.col("role") == TOTAL, F.col("seq"))).alias("total"),
        F.min_by(label(), F.when(F.col("role") == TOTAL, F.col("seq"))).alias("total_label"),
        F.min_by("clause_id", F.when(F.col("role") == TOTAL, F.col("seq"))).alias("total_clause"),
        F.sum_distinct(F.when(paid, F.col("v"))).alias("paid"),
        F.count_if(F.col("role").isin(*DEPOSITS)).alias("deposits"),
        F.count_if(F.col("role").isin(*BALANCES)).alias("balances"),
        F.transform(F.sort_array(F.collect_list(F.when(paid, F.struct(F.col("role").isin(*BALANCES).alias("late"), "seq", label().alias("t"))))), lambda x: x["t"]).alias("labels"),
        F.collect_set(F.when(paid, F.col("clause_id"))).alias("clauses"),
    )
    rows = rows.filter((F.col("deposits") > 0) & (F.col("balances") > 0) & F.col("total").isNotNull() & (F.abs(F.col("paid") - F.col("total")) > 0.01))
    message = F.format_string("分项付款去重合计 %,.2f 元与合同总价 %,.2f 元不一致（差额 %+,.2f 元）。", "paid", "total", F.round(F.col("paid") - F.col("total"), 2))
    involved = F.sort_array(F.array_distinct(F.filter(F.concat("clauses", F.array("total_clause")), lambda x: x.isNotNull())))
    return _finding(rows, "amount_conflict", message, F.concat(F.array("total_label"), F.col("labels")), involved, F.lit(0.95), F.lit(""))


def _date_side(near: Column) -> Column:
    return F.when(F.regexp_like(near, F.lit("|".join(P.SUMMARY_DATE_CUES))), "summary").when(F.regexp_like(near, F.lit("|".join(P.CLAUSE_DATE_CUES))), "clause")


def labelled_dates(clauses: DataFrame) -> DataFrame:
    """Every date with its side: of a summary sheet, or of a clause, by the 20 signs before it; others go."""
    rows = clauses.select("contract_id", "clause_seq", "clause_id", "text", F.explode(matches(F.coalesce("text", F.lit("")), P.DATE, 3, "年")).alias("m"))
    side = _date_side(window_before(F.col("text"), F.col("m.start"), 20))
    key = date_key(F.col("m.g1"), F.col("m.g2"), F.col("m.g3"))
    rows = rows.select("contract_id", "clause_seq", "clause_id", F.col("m.start").alias("at"), side.alias("side"), key.alias("day")).filter("side is not null")
    return rows.groupBy("contract_id", "side", "day").agg(F.min(F.struct("clause_seq", "at", "clause_id")).alias("first"))


def check_summary_dates(clauses: DataFrame) -> DataFrame:
    """Dates of the summary sheet that no clause names, where both kinds are there."""
    dates = labelled_dates(clauses)
    there = dates.filter("side = 'clause'").groupBy("contract_id").agg(F.sort_array(F.collect_list("day")).alias("days"), F.transform(F.array_sort(F.collect_list("first")), lambda x: x["clause_id"]).alias("held"))
    rows = dates.filter("side = 'summary'").join(there, "contract_id").filter(~F.array_contains("days", F.col("day")))
    other = F.array_join("days", "、")
    message = F.concat(F.lit("摘要中约定的交付日期 "), "day", F.lit(" 与条款中的交付日期（"), other, F.lit("）不一致。"))
    evidence = F.array(F.concat(F.lit("摘要日期 "), "day", F.lit("（"), "first.clause_id", F.lit("）")), F.concat(F.lit("条款日期 "), other))
    return _finding(rows, "date_conflict", message, evidence, F.concat(F.array("first.clause_id"), F.col("held")), F.lit(0.9), F.concat(F.lit("0"), F.col("day")))


def reversed_terms(clauses: DataFrame) -> DataFrame:
    """Terms whose start lies after their end, once for each pair of dates of a contract: the first."""
    text = F.coalesce("text", F.lit(""))
    both = F.concat(
        F.transform(matches(text, P.TERM_RANGE, 2, "止"), lambda m: F.struct(F.lit(0).alias("p"), m["start"].alias("at"), m["g0"].alias("g0"), m["g1"].alias("a"), m["g2"].alias("b"))),
        F.transform(matches(text, P.TERM_SPAN, 2, "期限"), lambda m: F.struct(F.lit(1).alias("p"), m["start"].alias("at"), m["g0"].alias("g0"), m["g1"].alias("a"), m["g2"].alias("b"))),
    )
    rows = clauses.select("contract_id", "clause_seq", "clause_id", F.explode(both).alias("m"))
    rows = rows.withColumn("begin", date_key_of(F.col("m.a"))).withColumn("end", date_key_of(F.col("m.b"))).filter("begin > end")
    first = W.partitionBy("contract_id", "begin", "end").orderBy("clause_seq", "m.p", "m.at")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def check_terms(clauses: DataFrame) -> DataFrame:
    rows = reversed_terms(clauses)
    message = F.concat(F.lit("期限倒置：起始日期 "), "begin", F.lit(" 晚于结束日期 "), "end", F.lit("。"))
    order = F.format_string("1%09d%d%09d", "clause_seq", "m.p", "m.at")
    return _finding(rows, "date_conflict", message, F.array(strip(F.col("m.g0"))), F.array("clause_id"), F.lit(0.9), order)


def check_parties(elements: DataFrame) -> DataFrame:
    """Sides of the contract that are given more than one name."""
    rows = elements.filter("kind = 'party'").withColumn("side", party_side(F.col("role"))).filter("side is not null").withColumn("name", strip(F.col("value")))
    names = rows.groupBy("contract_id", "side", "name").agg(F.coalesce(F.min_by("clause_id", "seq"), F.lit("")).alias("clause_id"))
    rows = names.groupBy("contract_id", "side").agg(F.sort_array(F.collect_list(F.struct("name", "clause_id"))).alias("held")).filter(F.size("held") > 1)
    message = F.concat(F.lit("同一角色「"), "side", F.lit("」对应多个不同主体："), F.array_join(F.transform("held", lambda x: x["name"]), "、"), F.lit("。"))
    evidence = F.transform("held", lambda x: F.concat(F.col("side"), F.lit("："), x["name"], F.lit("（"), x["clause_id"], F.lit("）")))
    clauses = F.sort_array(F.array_distinct(F.filter(F.transform("held", lambda x: x["clause_id"]), lambda x: x != "")))
    return _finding(rows, "party_conflict", message, evidence, clauses, F.lit(0.92), F.col("side"))


def _own_attachment(label: Column) -> Column:
    return F.regexp_extract(label, P.ATTACHMENT.replace("(?U)", "(?U)^"), 1)


def check_references(clauses: DataFrame) -> DataFrame:
    """Attachments that a clause names and no label defines; without any definition the finding is of low weight."""
    own = _own_attachment(F.col("label"))
    rows = clauses.select("contract_id", "clause_seq", "clause_id", "text", own.alias("_own"))
    number = F.when(F.col("_own") != "", chinese_number(F.col("_own")))
    rows = rows.withColumn("known", F.sort_array(F.collect_set(number).over(W.partitionBy("contract_id"))))
    refs = rows.filter("_own = ''").select("contract_id", "clause_seq", "clause_id", "text", "known", F.explode(matches(F.coalesce("text", F.lit("")), P.ATTACHMENT, 1, "附件")).alias("m"))
    refs = refs.withColumn("number", chinese_number(F.col("m.g1"))).filter("number is not null and not array_contains(known, number)")
    once = W.partitionBy("contract_id", "clause_seq", "number").orderBy("m.start")
    refs = refs.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    shown = F.concat(F.lit("["), F.array_join(F.transform("known", lambda x: x.cast("string")), ", "), F.lit("]"))
    any_known = F.size("known") > 0
    where = F.when(any_known, F.concat(F.lit("（已定义编号："), shown, F.lit("）"))).otherwise("（合同未定义任何附件）")
    begin = F.greatest(F.col("m.start") - 12, F.lit(0))
    quote = F.substring("text", begin + 1, F.col("m.stop") + 6 - begin)
    return _finding(
        refs,
        "reference_conflict",
        F.concat(F.lit("条款引用了附件"), "m.g1", F.lit("，但合同中未定义该附件"), where, F.lit("。")),
        F.array(F.concat(F.lit("引用「…"), quote, F.lit("…」（"), "clause_id", F.lit("）")), F.concat(F.lit("已定义附件："), shown)),
        F.array("clause_id"),
        F.when(any_known, 0.9).otherwise(0.6),
        F.format_string("%09d%09d", "clause_seq", "m.start"),
        F.when(any_known, "medium").otherwise("low"),
    )


#: The checks in order, as functions of (clauses, elements); a deployment may add its own.
CHECKS = (
    lambda clauses, elements: check_amounts(elements),
    lambda clauses, elements: check_summary_dates(clauses).unionByName(check_terms(clauses)),
    lambda clauses, elements: check_parties(elements),
    lambda clauses, elements: check_references(clauses),
)


def model_findings(responses: DataFrame, clauses: DataFrame) -> DataFrame:
    """Contradictions that a model names (contract_id, batch, response), in the form of the checks' findings.

    Codes outside the list and empty messages go, unknown clauses are left out. If one batch of a contract failed, none of
    its model findings count: a contract looked at in part would pass for one that was looked at.
    """
    parsed = responses.select("contract_id", "batch", F.from_json("response", DDL["contract_consistency_review"]).alias("r"))
    whole = parsed.groupBy("contract_id").agg(F.count_if(F.col("r").isNull()).alias("failed")).filter("failed = 0").select("contract_id")
    items = parsed.join(whole, "contract_id", "left_semi").select("contract_id", "batch", F.posexplode("r.findings").alias("i", "x"))
    items = items.withColumn("code", F.coalesce(F.nullif(F.col("x.code"), F.lit("")), F.lit("semantic_conflict"))).withColumn("message", F.substring(strip(F.coalesce("x.message", F.lit(""))), 1, 300))
    items = items.filter((F.col("message") != "") & F.col("code").isin(*FINDING_CODES))
    known = clauses.groupBy("contract_id").agg(F.collect_set("clause_id").alias("known"))
    items = items.join(known, "contract_id").withColumn("named", F.filter(F.coalesce("x.clause_ids", F.array().cast("array<string>")), lambda c: F.array_contains("known", c)))
    sure = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("x.confidence", F.lit(0.7)))), 2)
    return items.select(
        "contract_id", "code", F.coalesce(F.nullif(F.col("x.severity"), F.lit("")), F.lit("medium")).alias("severity"), "message",
        F.array(F.substring(strip(F.coalesce("x.evidence", F.lit(""))), 1, 400)).alias("evidence"), F.col("named").alias("clause_ids"), sure.alias("confidence"), F.format_string("%09d%09d", "batch", "i").alias("_order"),
    )


def without_repeats(found: DataFrame) -> DataFrame:
    """One finding for each code and message (its first 80 signs without blanks), the first, numbered anew."""
    key = F.substring(F.regexp_replace("message", r"(?U)\s", ""), 1, MESSAGE_KEY)
    first = W.partitionBy("contract_id", "code", key).orderBy("_rank", "_order")
    found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    found = found.withColumn("seq", F.row_number().over(W.partitionBy("contract_id").orderBy("_rank", "_order"))).drop("_n", "_rank", "_order")
    return found.withColumn("finding_id", F.format_string("F%04d", "seq"))


def findings(clauses: DataFrame, elements: DataFrame, checks=CHECKS, responses: DataFrame | None = None) -> DataFrame:
    """All checks of all contracts. elements are those of patterns, before merging; they are read once by each check.

    responses: a model's answers, whose findings come after those of the checks.
    """
    each = [check(clauses, elements).withColumn("_rank", F.lit(i)).withColumn("source", F.lit("m4_rule")) for i, check in enumerate(checks)]
    if responses is not None:
        each.append(model_findings(responses, clauses).withColumn("_rank", F.lit(len(checks))).withColumn("source", F.lit("m4_llm")))
    return without_repeats(reduce(DataFrame.unionByName, each))


def rollup(found: DataFrame) -> DataFrame:
    return found.groupBy("code").count().withColumnRenamed("count", "n")


def _groups(texts: Column, marked: Column, pattern: str, groups: int, apart: str | None = None) -> Column:
    """The groups of all matches in a contract's texts; apart: the pattern that doesn't reach past the last mark."""
    one_by_one = F.flatten(F.transform(texts, lambda t: F.transform(matches(t, pattern, groups), lambda m: F.array(*[m[f"g{i}"] for i in range(groups + 1)]))))
    return F.when(marked, one_by_one).otherwise(groups_of(texts, apart or pattern, groups))


def _amounts_differ(texts: Column) -> Column:
    """How many findings check_amounts() has (0 or 1), of the amounts in one contract's texts in order."""

    def of(items: Column) -> Column:
        total = F.get(F.filter(items, lambda x: x["role"] == TOTAL), 0)["v"]
        paid = F.filter(F.array_distinct(F.transform(F.filter(items, lambda x: x["role"].isin(*DEPOSITS, *BALANCES)), lambda x: x["v"])), lambda v: v.isNotNull())
        both = F.exists(items, lambda x: x["role"].isin(*DEPOSITS)) & F.exists(items, lambda x: x["role"].isin(*BALANCES))
        off = let(paid, lambda vs: (F.size(vs) > 0) & (F.abs(F.aggregate(vs, F.lit(0.0), lambda a, v: a + v) - total) > 0.01))
        return F.when(both & off, 1).otherwise(0)

    item = lambda t, m: F.struct(nearest_role(t, m["start"], P.MONEY_ROLES).alias("role"), plain_number(m["g2"]).try_cast("double").alias("v"))
    return let(F.flatten(F.transform(F.filter(texts, lambda t: F.contains(t, F.lit("元"))), lambda t: F.transform(matches(t, P.MONEY, 2), lambda m: item(t, m)))), of)


def _sides_of_two_names(texts: Column, marked: Column) -> Column:
    """How many findings check_parties() has, of the parties in one contract's texts."""
    # Of two signs each, or null: side and name together are no other ones'. The role is g1 with g2 in brackets, or g3.
    side = lambda g: lookup(P.PARTY_SIDES, F.when(g[2].isin(*P.PARTY_PRIMARY), g[2]).otherwise(F.concat(g[1], g[3])))
    sides = dict.fromkeys(P.PARTY_SIDES.values())
    several = lambda named: reduce(Column.__add__, [F.when(F.size(F.filter(named, lambda n: n.startswith(s))) > 1, 1).otherwise(0) for s in sides])  # noqa: B023, E731
    there = F.filter(texts, lambda t: F.contains(t, F.lit("：")) | F.contains(t, F.lit(":")))
    raw = F.array_distinct(F.filter(F.transform(_groups(there, marked, P.PARTY, 4, P.PARTY_APART), lambda g: F.concat(side(g), g[4])), lambda n: n.isNotNull()))
    names = lambda raw: F.filter(F.transform(raw, lambda n: F.struct(F.left(n, F.lit(2)).alias("side"), strip(party_name(F.substring(n, 3, 1 << 30))).alias("name"))), lambda x: is_party(x["name"]))
    sure = lambda raw: several(F.array_distinct(F.transform(names(raw), lambda x: F.concat(x["side"], x["name"]))))
    return let(raw, lambda raw: F.when(several(raw) > 0, sure(raw)).otherwise(0))  # one text for a side is one name


def _reversed_days(texts: Column, marked: Column) -> Column:
    """The pairs of days of reversed_terms() of one contract's texts, repeats included, as one string each."""
    day = lambda g, i: g[i].try_cast("int") * 10_000 + g[i + 1].try_cast("int") * 100 + g[i + 2].try_cast("int")
    key = lambda g, i: date_key(g[i], g[i + 1], g[i + 2])

    def of(pattern: str, apart: str, needs: str) -> Column:
        found = _groups(F.filter(texts, lambda t: F.contains(t, F.lit(needs))), marked, pattern, 6, apart)
        doubtful = F.filter(found, lambda g: F.coalesce(day(g, 1) > day(g, 4), F.lit(True)))  # also digits that a cast does not know
        keys = F.transform(doubtful, lambda g: F.struct(key(g, 1).alias("a"), key(g, 4).alias("b")))
        return F.transform(F.filter(keys, lambda k: k["a"] > k["b"]), lambda k: F.concat(k["a"], k["b"]))

    return F.concat(*[of(*term) for term in P.TERM_NUMBERS])


def _unnamed_summary_days(texts: Column, whole: Column) -> Column:
    """How many findings check_summary_dates() has. Dates are looked for only in contracts with a cue of a summary."""
    said = lambda t: F.transform(matches(t, P.DATE, 3, "年"), lambda m: F.struct(_date_side(window_before(t, m["start"], 20)).alias("side"), date_key(m["g1"], m["g2"], m["g3"]).alias("day")))
    days = lambda dates, side: F.transform(F.filter(dates, lambda d: d["side"] == side), lambda d: d["day"])
    left = let(F.flatten(F.transform(texts, said)), lambda dates: F.when(F.size(days(dates, "clause")) > 0, F.size(F.array_except(days(dates, "summary"), days(dates, "clause")))).otherwise(0))
    return F.when(reduce(Column.__or__, [F.contains(whole, F.lit(w)) for w in P.SUMMARY_DATE_CUES]), left).otherwise(0)


def _undefined_attachments(clauses: Column, marked: Column) -> Column:
    """How many findings check_references() has, of which those with alike messages are one."""
    own = lambda c: F.when(c["label"].startswith("附件"), _own_attachment(c["label"])).otherwise("")
    defined = F.transform(F.filter(clauses, lambda c: own(c) != ""), lambda c: chinese_number(own(c)))
    others = F.transform(F.filter(clauses, lambda c: F.contains(c["text"], F.lit("附件")) & (own(c) == "")), lambda c: c["text"])
    number = lambda x: x["n"]
    shown = lambda x: F.substring(x["g"], 1, MESSAGE_KEY - 7)  # noqa: E731  what the message says of it, as far as it counts

    def lost(names: Column, known: Column) -> Column:
        return F.filter(F.transform(names, lambda g: F.struct(chinese_number(g).alias("n"), g.alias("g"))), lambda x: x["n"].isNotNull() & ~F.array_contains(known, x["n"]))

    def by_clause(known: Column) -> Column:
        """Of each clause, a number only as it is written first."""
        first = lambda xs: F.transform(F.array_distinct(F.transform(xs, number)), lambda n: shown(F.get(F.filter(xs, lambda x: x["n"] == n), 0)))
        return F.flatten(F.transform(others, lambda t: let(lost(F.transform(matches(t, P.ATTACHMENT, 1), lambda m: m["g1"]), known), first)))

    def count(known: Column) -> Column:
        names = F.array_distinct(F.transform(groups_of(others, P.ATTACHMENT, 1), lambda g: g[1]))
        alike = lambda xs: F.size(F.array_distinct(F.transform(xs, number))) < F.size(xs)  # noqa: E731  numbers written in two ways
        apart = F.size(F.array_distinct(by_clause(known)))
        return F.when(marked, apart).otherwise(let(lost(names, known), lambda xs: F.when(alike(xs), apart).otherwise(F.size(F.array_distinct(F.transform(xs, shown))))))

    return F.when(F.size(others) == 0, 0).otherwise(let(F.filter(F.array_distinct(defined), lambda n: n.isNotNull()), count))


def counts(contracts: DataFrame) -> DataFrame:
    """contract_id, code, n: how many findings() whole contracts have; contract_id, clauses (array<struct<label, text>>, in order).

    Clauses are read once and nothing but counts leaves a contract's row: findings are told apart by what makes their
    messages differ, and neither written out nor numbered. What needs no places is searched for in all clauses at once.
    """
    texts, marked = F.col("_texts"), F.col("_marked")
    found = {
        "amount_conflict": _amounts_differ(texts),
        "date_conflict": _unnamed_summary_days(texts, F.col("_whole")) + F.size(F.array_distinct(_reversed_days(texts, marked))),
        "party_conflict": _sides_of_two_names(texts, marked),
        "reference_conflict": _undefined_attachments(F.col("clauses"), marked),
    }
    each = F.array(*[F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in found.items()])
    rows = contracts.select("contract_id", "clauses", F.transform("clauses", lambda c: c["text"]).alias("_texts"))
    rows = rows.withColumn("_whole", F.array_join("_texts", "")).withColumn("_marked", F.regexp_like("_whole", F.lit(f"[{P.MARKS}]")))
    return rows.select("contract_id", F.explode(each).alias("x")).select("contract_id", "x.code", "x.n").filter("n > 0")


def tally(contracts: DataFrame) -> DataFrame:
    """rollup(findings()) of whole contracts, as counts() has them."""
    return counts(contracts).groupBy("code").agg(F.sum("n").alias("n"))
