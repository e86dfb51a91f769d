"""The deterministic parts of contract review: candidates, law, judgement, fusion, reports.

Candidates: contract_id, candidate_id, seq, code, severity, message, clause_ids, block_ids, evidence, confidence, source.
Risks add risk_id, citations (of law_name, article_no, quote, source_url), review_required, rationale, agent_sources,
category and cross_validated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import citation, lookup
from .fold import add_new, folded
from .schemas import DDL

CITATION = "struct<law_name:string,article_no:string,quote:string,source_url:string>"
_NONE = "array<string>"
RANK = {"high": 0, "medium": 1, "low": 2}
CLAUSE_RISKS, CONFLICTS, VERDICTS, DECISIONS = (DDL[n] for n in ("clause_risk_review", "cross_clause_conflict_review", "legal_application_verdict", "final_adjudication"))
UNDERSTOOD, ARBITRATED = DDL["contract_understanding"], DDL["cross_module_arbitration"]
OTHER_ROLE = "其他"


def severity_rank(severity: Column) -> Column:
    return lookup(RANK, severity, F.lit(1))


def understood(responses: DataFrame, tree: DataFrame, reason: str = "") -> DataFrame:
    """What a model (responses: contract_id, response) takes each contract for: contract_type, summaries, key_obligations,
    clause_roles, source and unavailable_reason.

    Roles of unknown clauses go, clauses without one are of another kind. A contract without an answer is marked as
    unavailable, with nothing in it that could pass for an analysis.
    """
    parsed = responses.select("contract_id", F.from_json("response", UNDERSTOOD).alias("r")).filter("r is not null and r.clause_roles is not null")
    ids = tree.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("clause_seq", "clause_id"))).alias("_ids"))
    rows = ids.join(parsed, "contract_id", "left").withColumn("_ids", F.transform("_ids", lambda x: x["clause_id"]))
    roles = F.filter("r.clause_roles", lambda x: F.array_contains("_ids", x["clause_id"]))
    named = F.transform(roles, lambda x: x["clause_id"])
    rest = F.transform(F.filter("_ids", lambda i: ~F.array_contains(named, i)), lambda i: F.struct(i.alias("clause_id"), F.lit(OTHER_ROLE).alias("role")))
    heard, none = F.col("r").isNotNull(), F.array().cast("array<struct<clause_id:string,role:string>>")
    text = lambda c: F.coalesce(f"r.{c}", F.lit("")).alias(c)
    return rows.select(
        "contract_id", text("contract_type"), text("subject_summary"), text("payment_summary"), F.coalesce("r.key_obligations", F.array().cast(_NONE)).alias("key_obligations"),
        F.when(heard, F.concat(roles, rest)).otherwise(none).alias("clause_roles"), F.when(heard, "llm").otherwise("unavailable").alias("source"),
        F.when(~heard, F.lit(reason or "没有可用的模型回答。")).alias("unavailable_reason"),
    )


def arbitrated(responses: DataFrame, risks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conflicts, material): conflicts (contract_id, type, description, involved_ids, resolution) of contracts with risks, and
    contract_id, material for those with an answer. Without an answer there is no conflict, and nothing is held up."""
    parsed = responses.select("contract_id", F.from_json("response", ARBITRATED).alias("r")).filter("r is not null").join(risks.select("contract_id").distinct(), "contract_id", "left_semi")
    items = parsed.select("contract_id", F.posexplode("r.conflicts").alias("i", "x"))
    conflicts = items.select(
        "contract_id", "i", F.coalesce(F.nullif(F.col("x.type"), F.lit("")), F.lit("unknown")).alias("type"), F.coalesce("x.description", F.lit("")).alias("description"),
        F.coalesce("x.involved_ids", F.array().cast(_NONE)).alias("involved_ids"), F.coalesce("x.resolution", F.lit("")).alias("resolution"),
    )
    return conflicts, parsed.select("contract_id", F.coalesce("r.has_material_conflict", F.lit(False)).alias("material"))


def _numbered(rows: DataFrame, prefix: str, order: list) -> DataFrame:
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("contract_id").orderBy(*order)))
    return rows.withColumn("candidate_id", F.format_string(f"{prefix}%04d", "seq"))


def _candidates(items: DataFrame, prefix: str, default: str, source: str) -> DataFrame:
    rows = items.select(
        "contract_id", "batch", "i", F.coalesce(F.nullif(F.trim("x.code"), F.lit("")), F.lit(default)).alias("code"),
        F.coalesce(F.nullif(F.col("x.severity"), F.lit("")), F.lit("medium")).alias("severity"),
        F.coalesce("x.reason", F.lit("")).alias("message"), "clause_ids", F.array().cast(_NONE).alias("block_ids"),
        F.array(F.coalesce("x.evidence", F.lit(""))).alias("evidence"), F.lit(0.8).alias("confidence"), F.lit(source).alias("source"),
    )
    return _numbered(rows, prefix, ["batch", "i"]).drop("batch", "i")


def clause_candidates(responses: DataFrame, clauses: DataFrame) -> DataFrame:
    """Risks that a model names (contract_id, batch, response); those of unknown clauses go."""
    rows = responses.select("contract_id", "batch", F.posexplode(F.from_json("response", CLAUSE_RISKS)["risks"]).alias("i", "x"))
    known = clauses.select("contract_id", F.col("clause_id").alias("_clause"))
    rows = rows.join(known, (rows["contract_id"] == known["contract_id"]) & (F.col("x.clause_id") == F.col("_clause")), "left_semi")
    return _candidates(rows.withColumn("clause_ids", F.array("x.clause_id")), "KC", "risk", "clause_llm")


def cross_candidates(responses: DataFrame, clauses: DataFrame) -> DataFrame:
    """Conflicts between at least two known clauses."""
    rows = responses.select("contract_id", "batch", F.posexplode(F.from_json("response", CONFLICTS)["conflicts"]).alias("i", "x"))
    known = clauses.groupBy("contract_id").agg(F.collect_set("clause_id").alias("_known"))
    rows = rows.join(known, "contract_id").withColumn("clause_ids", F.filter("x.clause_ids", lambda c: F.array_contains("_known", c)))
    return _candidates(rows.filter(F.size("clause_ids") >= 2).drop("_known"), "XC", "cross_conflict", "cross_llm")


def _meets(a: dict, b: dict) -> bool:
    return not a["clause_ids"] or not b["clause_ids"] or bool(set(a["clause_ids"]) & set(b["clause_ids"]))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of one code that share a clause (or name none) become the first of them, in order of seq.

    The surest copy gives severity and message; sources, evidence, clauses and blocks are joined in order. What an
    earlier one has gathered counts for later ones, but earlier ones are not joined again. Sorted by severity, code, id.
    """

    def absorb(target: dict, row: dict) -> None:
        if row["confidence"] > target["confidence"]:
            target.update(confidence=row["confidence"], severity=row["severity"], message=row["message"] or target["message"])
        if row["source"] not in target["source"]:
            target["source"] = f"{target['source']}+{row['source']}"
        add_new(target["evidence"], [e for e in row["evidence"] if e])
        add_new(target["clause_ids"], row["clause_ids"])
        add_new(target["block_ids"], row["block_ids"])

    out = folded(candidates, ["contract_id", "code"], ["seq"], _meets, absorb)
    order = W.partitionBy("contract_id").orderBy(severity_rank(F.col("severity")), "code", "candidate_id")
    return out.withColumn("seq", F.row_number().over(order))


def law_queries(candidates: DataFrame, clauses: DataFrame, retry: bool = False) -> DataFrame:
    """The search text of each candidate: label, evidence and its first clause; on a retry label and message."""
    label = lookup(P.RISK_LABELS, F.col("code"), F.col("code"))
    if retry:
        return candidates.select("contract_id", "candidate_id", F.concat_ws(" ", label, F.substring("message", 1, 150)).alias("text"))
    named = candidates.select("contract_id", "candidate_id", F.explode("clause_ids").alias("clause_id")).join(clauses, ["contract_id", "clause_id"])
    first = named.groupBy("contract_id", "candidate_id").agg(F.min_by(F.substring("text", 1, 300), "clause_seq").alias("clause_text"))
    rows = candidates.join(first, ["contract_id", "candidate_id"], "left")
    evidence = F.substring(F.array_join("evidence", " "), 1, 200)
    return rows.select("contract_id", "candidate_id", F.concat_ws(" ", label, F.nullif(evidence, F.lit("")), "clause_text").alias("text"))


def applications(candidates: DataFrame, verdicts: DataFrame, pool: DataFrame) -> DataFrame:
    """A verdict for each candidate (null without), with a citation if its article is among those found in the round.

    verdicts: contract_id, candidate_id, assessment, severity, reason, article_uid, quote. pool: contract_id, article_uid,
    law_name, article_no, source_url of all articles found for any candidate of the contract.
    """
    held = pool.dropDuplicates(["contract_id", "article_uid"])
    rows = verdicts.join(held, ["contract_id", "article_uid"], "left")
    cited = F.when(F.col("law_name").isNotNull(), F.struct("law_name", "article_no", "quote", F.coalesce("source_url", F.lit("")).alias("source_url")).cast(CITATION))
    rows = rows.select("contract_id", "candidate_id", "assessment", F.col("severity").alias("verdict_severity"), "reason", cited.alias("citation"), F.when(cited.isNotNull(), citation(F.col("law_name"), F.col("article_no"))).alias("cited"))
    return candidates.select("contract_id", "candidate_id").join(rows, ["contract_id", "candidate_id"], "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and old's whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def unresolved(applied: DataFrame) -> DataFrame:
    return applied.filter("assessment is null")


def adjudicate(candidates: DataFrame, decisions: DataFrame, applied: DataFrame) -> DataFrame:
    """Risks by the judge's decisions, within guardrails.

    A candidate without a decision stays for review at .5. One may go only if its assessment is no_substantive_risk;
    else it stays for review with a note. Unclear facts always go to review. decisions: contract_id, candidate_id, keep,
    severity, review_required, rationale.
    """
    d = decisions.select("contract_id", "candidate_id", F.coalesce("keep", F.lit(True)).alias("keep"), F.nullif(F.col("severity"), F.lit("")).alias("d_severity"), F.coalesce("review_required", F.lit(False)).alias("d_review"), F.coalesce("rationale", F.lit("")).alias("d_why"), F.lit(True).alias("decided"))
    a = applied.select("contract_id", "candidate_id", F.coalesce("assessment", F.lit("")).alias("assessment"), "reason", "citation")
    rows = candidates.join(d, ["contract_id", "candidate_id"], "left").join(a, ["contract_id", "candidate_id"], "left").withColumn("assessment", F.coalesce("assessment", F.lit("")))
    decided, keep = F.col("decided").isNotNull(), F.coalesce("keep", F.lit(True))
    forced = decided & ~keep & (F.col("assessment") != "no_substantive_risk")
    unclear = F.col("assessment").isin("insufficient_facts", "need_more_material")
    note = F.concat(F.lit("（护栏：评估为"), lookup(P.ASSESSMENTS, F.col("assessment"), F.col("assessment")), F.lit("，不因未违法而删除。）"))
    rows = rows.filter(keep | forced)
    rows = rows.select(
        "contract_id", "candidate_id", "seq", "code", F.coalesce("d_severity", "severity").alias("severity"),
        F.substring(F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.col("message")), 1, 200).alias("message"),
        F.filter(F.array("citation"), lambda c: c.isNotNull()).alias("citations"), "clause_ids", "block_ids",
        F.when(decided, 0.9).otherwise(0.5).alias("confidence"),
        (~decided | forced | unclear | F.coalesce("d_review", F.lit(False))).alias("review_required"),
        F.when(~decided, "裁判未返回该项裁决，保守保留，转人工复核。").when(forced, F.concat("d_why", note)).otherwise(F.col("d_why")).alias("rationale"),
        F.sort_array(F.array_distinct(F.split("source", r"\+"))).alias("agent_sources"),
        F.coalesce(F.nullif(F.col("assessment"), F.lit("")), F.lit("unassessed")).alias("category"),
        F.filter("evidence", lambda e: e != "").alias("evidence"), F.lit(False).alias("cross_validated"),
    )
    return with_risk_ids(rows, ["seq"])


def fallback(candidates: DataFrame) -> DataFrame:
    """Risks without a judge: all stay, at .5, for review, without a category."""
    none = candidates.select("contract_id", "candidate_id").limit(0)
    empty = none.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("keep", "boolean"), ("severity", "string"), ("review_required", "boolean"), ("rationale", "string"))])
    applied = none.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("assessment", "string"), ("reason", "string"), ("citation", CITATION))])
    return adjudicate(candidates, empty, applied).withColumn("category", F.lit(""))


def overall(contracts: DataFrame, candidates: DataFrame, answers: DataFrame, model_on: bool) -> DataFrame:
    """The overall assessment: the judge's answer, low_risk at 90 without candidates, unknown without a model or an answer."""
    some = candidates.select("contract_id").distinct().withColumn("_some", F.lit(True))
    rows = contracts.select("contract_id").distinct().join(some, "contract_id", "left").join(answers.select("contract_id", "overall_assessment", "overall_score"), "contract_id", "left")
    quiet = F.col("_some").isNull() & F.lit(model_on)
    return rows.select("contract_id", F.when(quiet, "low_risk").otherwise(F.coalesce("overall_assessment", F.lit("unknown"))).alias("overall_assessment"), F.when(quiet, 90).otherwise(F.col("overall_score")).alias("overall_score"))


def feedback(candidates: DataFrame, applied: DataFrame) -> DataFrame:
    """A row for each clause whose facts were unclear, for a further evidence round."""
    rows = candidates.join(applied.filter(F.col("assessment").isin("insufficient_facts", "need_more_material")), ["contract_id", "candidate_id"])
    why = F.concat(lookup(P.ASSESSMENTS, F.col("assessment")), F.lit("："), F.substring(F.coalesce("reason", F.lit("")), 1, 120))
    return rows.select("contract_id", F.explode(F.when(F.size("clause_ids") > 0, F.col("clause_ids")).otherwise(F.array(F.lit("")))).alias("clause_id"), why.alias("reason"))


def with_risk_ids(risks: DataFrame, order: list) -> DataFrame:
    rows = risks.withColumn("seq", F.row_number().over(W.partitionBy("contract_id").orderBy(*order)))
    return rows.withColumn("risk_id", F.format_string("R%04d", "seq"))


def cross_validate(risks: DataFrame, signals: DataFrame) -> DataFrame:
    """Risks of the codes that a signal can confirm, with a signal on one of their clauses, gain .1 of confidence."""
    held = signals.filter("clause_id <> ''").groupBy("contract_id").agg(F.collect_set("clause_id").alias("_signals"))
    rows = risks.join(held, "contract_id", "left")
    hit = F.col("code").isin(*P.CONFIRMED_CODES) & F.coalesce(F.arrays_overlap("clause_ids", "_signals"), F.lit(False))
    return rows.withColumn("cross_validated", F.col("cross_validated") | hit).withColumn("confidence", F.when(hit, F.least(F.lit(1.0), F.round(F.col("confidence") + 0.1, 2))).otherwise(F.col("confidence"))).drop("_signals")


def merge_risks(risks: DataFrame) -> DataFrame:
    """Risks of one code that share a clause become the first: worst severity, greatest confidence, all that either has."""

    def absorb(target: dict, row: dict) -> None:
        if RANK.get(row["severity"], 1) < RANK.get(target["severity"], 1):
            target["severity"] = row["severity"]
        target["confidence"] = max(target["confidence"], row["confidence"])
        for flag in ("cross_validated", "review_required"):
            target[flag] = bool(target[flag] or row[flag])
        numbers = {c["article_no"] for c in target["citations"]}
        for c in row["citations"]:
            if c["article_no"] not in numbers:
                numbers.add(c["article_no"])
                target["citations"].append(c)
        for column in ("clause_ids", "block_ids", "agent_sources", "evidence"):
            add_new(target[column], row[column])
        for column in ("message", "rationale"):
            target[column] = target[column] or row[column]

    return folded(risks, ["contract_id", "code"], ["seq"], _meets, absorb)


def fuse(risks: DataFrame, signals: DataFrame) -> DataFrame:
    """Confirmed, merged and sorted: by severity, confidence, number of sources, code, and the order they came in."""
    merged = merge_risks(cross_validate(risks, signals))
    return with_risk_ids(merged, [severity_rank(F.col("severity")), F.desc("confidence"), F.desc(F.size("agent_sources")), "code", "seq"])


def review_queue(risks: DataFrame, signals: DataFrame) -> DataFrame:
    """Risks to review, and signals on clauses that no risk names."""
    flagged = risks.filter("review_required").select("contract_id", "risk_id", "code", F.lit(None).cast("string").alias("clause_id"), F.coalesce(F.nullif(F.col("rationale"), F.lit("")), F.lit("需人工确认。")).alias("reason"))
    named = risks.select("contract_id", F.explode("clause_ids").alias("clause_id")).distinct()
    rest = signals.join(named, ["contract_id", "clause_id"], "left_anti")
    where = F.when(F.col("clause_id") != "", F.concat(F.lit("（条款 "), "clause_id", F.lit("）"))).otherwise("")
    return flagged.unionByName(rest.select("contract_id", F.lit("—").alias("risk_id"), F.concat(F.lit("element_signal:"), "kind").alias("code"), "clause_id", F.concat("note", where).alias("reason")))


def report_counts(risks: DataFrame) -> DataFrame:
    """Counts by code, by category and by severity in one pass: dimension, value, n, cross_validated."""
    rows = risks.select("code", "category", "severity", F.col("cross_validated").cast("int").alias("x"))
    sides = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("code", "category", "severity")])).alias("s"), "x")
    return sides.groupBy("s.dimension", "s.value").agg(F.count("*").alias("n"), F.sum("x").alias("cross_validated"))


def report_json(risks: DataFrame, queue: DataFrame, overall_rows: DataFrame, loops: DataFrame | None = None, conflicts: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """One JSON report for each contract, with counts of its risks by code, category and severity, and of the loop's turns.

    loops: contract_id and the counters; conflicts: of arbitrated(); candidates: contract_id and candidate counts.
    """
    label = lookup(P.ASSESSMENTS, F.col("category"), F.col("category"))
    shown = F.struct("risk_id", "code", "severity", "message", "citations", "clause_ids", "block_ids", "confidence", "review_required", "rationale", "agent_sources", "category", "category_label", "cross_validated", "evidence")
    r = risks.withColumn("category_label", label).groupBy("contract_id").agg(F.array_sort(F.collect_list(shown)).alias("risks"), F.count("*").alias("final_risks"), F.count_if("cross_validated").alias("cross_validated"))
    sides = risks.select("contract_id", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("v")) for d in ("code", "category", "severity")])).alias("s"))
    sides = sides.groupBy("contract_id", "s.d", "s.v").agg(F.count("*").alias("n")).groupBy("contract_id")
    by = sides.agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("d") == d, F.struct("v", "n"))))).alias(f"by_{d}") for d in ("code", "category", "severity")])
    q = queue.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("risk_id", "code", "clause_id", "reason"))).alias("review_queue"))
    rows = overall_rows.join(r, "contract_id", "left").join(by, "contract_id", "left").join(q, "contract_id", "left")
    stats = ["final_risks", "cross_validated", "by_code", "by_category", "by_severity", F.greatest(F.size("review_queue"), F.lit(0)).alias("review_required")]
    body = ["overall_assessment", "overall_score", "risks", "review_queue"]
    rows = rows.na.fill(0, ["final_risks", "cross_validated"])
    if conflicts is not None:
        held = conflicts.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("i", "type", "description", "involved_ids", "resolution"))).alias("conflicts"))
        rows = rows.join(held, "contract_id", "left")
        body.append(F.transform(F.coalesce("conflicts", F.array().cast(held.schema["conflicts"].dataType)), lambda x: x.dropFields("i")).alias("conflicts"))
        stats.append(F.greatest(F.size("conflicts"), F.lit(0)).alias("conflicts"))
    if loops is not None:
        names = [c for c in loops.columns if c != "contract_id"]
        rows = rows.join(loops.select("contract_id", F.struct(*names).alias("loops")), "contract_id", "left")
        stats.append("loops")
    if candidates is not None:
        names = [c for c in candidates.columns if c != "contract_id"]
        rows = rows.join(candidates, "contract_id", "left").na.fill(0, names)
        stats += names
    return rows.select("contract_id", F.to_json(F.struct(F.lit("m6").alias("schema_version"), "contract_id", *body, F.struct(*stats).alias("stats"))).alias("report"))
