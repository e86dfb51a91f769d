"""Model-assisted segmentation: batches of blocks, answers repaired into segments, damaged windows asked about again.

Segments of a contract are an ordered partition of its blocks: every block is in exactly one, whatever a model answers.
A block belongs to the first item that claims it; one that nobody claims follows the block before it. Both are windows
over (contract_id, batch); only the cutting of batches, whose sizes depend on each other, folds over ids and lengths,
contract by contract.

ask: (schema name, requests of contract_id, batch, prompt) to contract_id, batch, response; a null response has failed.
Its answers are written before they are read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from ..scratch import written
from . import prompts, structure, validate
from .fold import by_group, packed_by_budget
from .schemas import DDL, RELATIONS, ROLES

Asker = Callable[[str, DataFrame], DataFrame]
MAX_BLOCKS, MAX_SIGNS, CONTEXT, ROUNDS = 50, 8_000, 3, 1
NEAR, MAX_TARGETS, MAX_SHOWN = 2, 8, 20
SAFE, INSIDE = 0.9, 0.92
UNSURE, SURE, MOST = 0.60, 0.78, 0.95
LEVEL, CONFIDENCE = 2, 0.8
SPLIT = DDL["contract_clause_split"].replace("level:int", "level:string").replace("confidence:double", "confidence:string")
BOUNDARY = DDL["contract_boundary_review"]


def cut_batches(sizes: list[int], safe: list[bool], max_blocks: int = MAX_BLOCKS, max_signs: int = MAX_SIGNS) -> list[int]:
    """The batch of each block: as many as both limits allow, cut back to the last place where a clause surely begins."""
    out: list[int] = []
    batch = 0
    while len(out) < len(sizes):
        begin, end, signs = len(out), len(out), 0
        while end < len(sizes) and end - begin < max_blocks and (end == begin or signs + sizes[end] <= max_signs):
            signs += sizes[end]
            end += 1
        if end < len(sizes):
            end = max((i for i in range(begin + 1, end + 1) if safe[i]), default=end)
        out += [batch] * (end - begin)
        batch += 1
    return out


def batches(blocks: DataFrame, decided: DataFrame, max_blocks: int = MAX_BLOCKS, max_signs: int = MAX_SIGNS) -> DataFrame:
    """blocks with the batch (from 0) each is sent in."""
    sure = decided.select("contract_id", "seq", ((F.col("relation") == "NEW_CLAUSE") & (F.col("confidence") >= SAFE)).alias("safe"))
    rows = blocks.select("contract_id", "seq", F.length("text").alias("size")).join(sure, ["contract_id", "seq"], "left")
    rows = rows.select("contract_id", "seq", "size", F.coalesce("safe", F.lit(False)).alias("safe"), F.lit(0).alias("batch"))

    def number(group: list[dict]) -> list[dict]:
        return [r | {"batch": b} for r, b in zip(group, cut_batches([r["size"] for r in group], [r["safe"] for r in group], max_blocks, max_signs), strict=True)]

    return blocks.join(by_group(rows, ["contract_id"], ["seq"], number).select("contract_id", "seq", "batch"), ["contract_id", "seq"])


def answered(responses: DataFrame) -> DataFrame:
    """responses that parse: contract_id, batch, clauses."""
    return responses.select("contract_id", "batch", F.from_json("response", SPLIT)["clauses"].alias("clauses")).filter("clauses is not null")


def _items(parsed: DataFrame) -> DataFrame:
    """A row for each item: its heading as the model gave it, within bounds, and the ids it claims."""
    rows = parsed.select("contract_id", "batch", F.posexplode("clauses").alias("item", "x"))
    level, sure = F.col("x.level").try_cast("double").cast("int"), F.col("x.confidence").try_cast("double")
    return rows.select(
        "contract_id", "batch", "item", F.substring(strip(F.coalesce("x.label", F.lit(""))), 1, 40).alias("label"), F.substring(strip(F.coalesce("x.title", F.lit(""))), 1, 200).alias("title"),
        F.least(F.lit(6), F.greatest(F.lit(0), F.coalesce(level, F.lit(LEVEL)))).alias("level"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(sure, F.lit(CONFIDENCE)))), 2).alias("confidence"), F.coalesce("x.block_ids", F.array().cast("array<string>")).alias("ids"),
    )


def _claimed(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """blocks with item: the first of their batch that claims them, null without."""
    claims = items.select("contract_id", "batch", "item", F.explode("ids").alias("block_id"))
    return blocks.join(claims.groupBy("contract_id", "batch", "block_id").agg(F.min("item").alias("item")), ["contract_id", "batch", "block_id"], "left")


def _headed(rows: DataFrame, items: DataFrame, owner: Column) -> DataFrame:
    """rows with the heading of the item that owns them; a segment that no item opened has an empty one."""
    given = items.select("contract_id", F.struct("batch", "item").alias("_owner"), "label", "title", "level", "confidence")
    rows = rows.withColumn("_owner", owner).join(given, ["contract_id", "_owner"], "left")
    return rows.withColumns({
        "label": F.coalesce("label", F.lit("")), "title": F.coalesce("title", F.lit("")), "level": F.coalesce("level", F.lit(LEVEL)), "confidence": F.coalesce("confidence", F.lit(CONFIDENCE)),
    })


def segments(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    """Repaired segments: blocks (with batch) of contracts with an answer, and segment (from 1), place in it, label, title,
    level, confidence.

    A block that no item of its batch claims joins the one before it in its batch, else the last segment of the batches
    before, else it opens a segment at the very top. Blocks that were claimed stand before those that were not.
    """
    parsed = answered(responses)
    items = _items(parsed)
    rows = _claimed(blocks.join(parsed.select("contract_id").distinct(), "contract_id", "left_semi"), items)
    own = F.when(F.col("item").isNotNull(), F.struct("batch", "item"))
    in_batch = W.partitionBy("contract_id", "batch").orderBy("seq")
    earlier = W.partitionBy("contract_id").orderBy("batch").rangeBetween(W.unboundedPreceding, -1)
    owner = F.coalesce(F.last(own, ignorenulls=True).over(in_batch), F.max(own).over(earlier), F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("item")))
    rows = _headed(rows.withColumn("_by", owner), items, F.col("_by"))
    rows = rows.withColumn("segment", F.dense_rank().over(W.partitionBy("contract_id").orderBy("_by")))
    place = W.partitionBy("contract_id", "segment").orderBy(F.col("item").isNull(), "seq")
    return rows.withColumn("place", F.row_number().over(place)).drop("_by", "_owner", "item")


def clauses_of(found: DataFrame) -> DataFrame:
    """The clause tree of segments, one clause each, with the model's label, title and level.

    A label or title that the first line begins with becomes the heading; what follows it there is the body's.
    """
    line = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("int" if c in ("page", "line_start", "line_end") else "string")
    spans = F.struct("place", F.col("text").alias("text"), "block_id", line("page").alias("page"), line("source_block").alias("source_block"), line("line_start").alias("line_start"), line("line_end").alias("line_end"))
    rows = found.groupBy("contract_id", F.col("segment").alias("clause_seq")).agg(F.array_sort(F.collect_list(spans)).alias("b"), *[F.first(c).alias(c) for c in ("label", "title", "level", "confidence")])
    texts = F.transform("b", lambda b: b["text"])
    lines = F.split(F.element_at(texts, 1), r"\R", -1)
    rows = rows.withColumn("_first", strip(F.element_at(lines, 1))).withColumn("_rest", F.concat(F.slice(lines, 2, 1 << 30), F.slice(texts, 2, 1 << 30)))
    begins = (F.col("label") != "") & F.startswith(F.col("_first"), F.col("label"))
    tail = F.regexp_replace(F.substr("_first", F.length("label") + 1), r"^[ \t：:、.\-]+|[ \t：:、.\-]+$", "")
    whole = (F.col("_first") != "") & F.when(begins, (tail == "") | ((F.col("title") != "") & (tail == F.col("title")))).otherwise((F.col("title") != "") & (F.col("_first") == F.col("title")))
    heading = F.when(whole, F.col("_first")).when(begins, F.col("label")).otherwise("")
    body = F.when(whole, F.col("_rest")).when(begins, F.concat(F.array(tail), F.col("_rest"))).otherwise(texts)
    unnamed, top = F.col("label") == "", F.col("clause_seq") == 1
    shown = rows.withColumn("heading", heading)
    return structure.with_parents(shown.select(
        "contract_id", "clause_seq", F.format_string("C%04d", "clause_seq").alias("clause_id"),
        F.when(~unnamed, F.col("label")).when(top, "前言").when(F.col("heading") != "", "标题").otherwise("未编号").alias("label"),
        F.when(~unnamed | (F.col("title") != ""), F.col("title")).when(top, "合同首部").otherwise(F.col("heading")).alias("title"),
        "level", "heading", strip(F.array_join(F.filter(body, lambda x: x != ""), "\n")).alias("body"), F.array_join(texts, "\n").alias("text"),
        F.transform("b", lambda b: b["block_id"]).alias("block_ids"), F.array_min(F.transform("b", lambda b: b["page"])).alias("page_start"), F.array_max(F.transform("b", lambda b: b["page"])).alias("page_end"),
        F.transform("b", lambda b: F.struct(b["block_id"].alias("block_id"), b["source_block"].alias("source_block_id"), b["page"].alias("page"), b["line_start"].alias("line_start"), b["line_end"].alias("line_end"))).alias("source_spans"),
        "confidence",
    ))


def boundaries_of(found: DataFrame) -> DataFrame:
    """Boundaries that the segments imply, in the form of structure.boundaries."""
    w = W.partitionBy("contract_id").orderBy("seq")
    rows = found.withColumn("left_id", F.lag("block_id").over(w)).filter("left_id is not null")
    opens = F.col("place") == 1
    sure = F.when(opens, F.col("confidence")).otherwise(INSIDE)
    named = F.when(F.col("label") == "", "未编号").otherwise(F.col("label"))
    return rows.select(
        "contract_id", "seq", "left_id", F.col("block_id").alias("right_id"),
        F.when(opens & (F.col("level") <= 2), "NEW_CLAUSE").when(opens, "NEW_SUBCLAUSE").otherwise("SAME_CLAUSE").alias("relation"), sure.alias("confidence"), F.lit("llm_split").alias("decision_source"),
        F.array(F.when(opens, F.concat(named, F.lit("，层级"), F.col("level").cast("string"), F.lit("，由模型开始"))).otherwise("由模型归入同一条款")).alias("evidence"),
        F.array().cast("array<string>").alias("warnings"), (sure < structure.AUTO_ACCEPT).alias("review_required"),
    )


def issues_of(found: DataFrame, threshold: float = validate.THRESHOLD) -> DataFrame:
    """What is wrong with segments and could be asked about again."""
    blocks = found.select("contract_id", "seq", "block_id")
    return validate.issues(blocks, clauses_of(found), boundaries_of(found), threshold).filter("refixable")


def touched(found: DataFrame, issues: DataFrame) -> DataFrame:
    """(contract_id, segment, code) of the segments that issues name, by their blocks or clauses."""
    by_block = issues.select("contract_id", "code", F.explode("block_ids").alias("block_id")).join(found.select("contract_id", "block_id", "segment"), ["contract_id", "block_id"])
    by_clause = issues.select("contract_id", "code", F.explode(F.transform("clause_ids", lambda c: F.substring(c, 2, 20).try_cast("int"))).alias("segment"))
    by_clause = by_clause.join(found.select("contract_id", "segment").distinct(), ["contract_id", "segment"])
    return by_block.select("contract_id", "segment", "code").unionByName(by_clause.select("contract_id", "segment", "code")).distinct()


def windows(named: DataFrame) -> DataFrame:
    """Ranges of neighbouring segments among (contract_id, segment): contract_id, first, last."""
    w = W.partitionBy("contract_id").orderBy("segment")
    rows = named.select("contract_id", "segment").distinct().withColumn("island", F.col("segment") - F.row_number().over(w))
    return rows.groupBy("contract_id", "island").agg(F.min("segment").alias("first"), F.max("segment").alias("last")).drop("island")


def pieces(found: DataFrame, ranges: DataFrame, max_signs: int = MAX_SIGNS) -> DataFrame:
    """The segments of each window (contract_id, first, segment) with batch: windows of more than max_signs are cut between
    segments; a piece is numbered by its first segment."""
    sizes = found.groupBy("contract_id", "segment").agg(F.sum(F.length("text")).cast("int").alias("size"))
    rows = sizes.join(ranges, "contract_id").filter(F.col("segment").between(F.col("first"), F.col("last"))).select("contract_id", "first", "segment", "size", F.lit(0).alias("batch"))

    def number(group: list[dict]) -> list[dict]:
        cut = packed_by_budget([r["size"] for r in group], max_signs)
        heads = {b: r["segment"] for r, b in reversed(list(zip(group, cut, strict=True)))}
        return [r | {"batch": heads[b]} for r, b in zip(group, cut, strict=True)]

    return by_group(rows, ["contract_id", "first"], ["segment"], number).drop("size")


def window_segments(shown: DataFrame, responses: DataFrame) -> DataFrame:
    """Segments that answers make of window pieces (found's rows with batch): with the key (batch, item) they are ordered by.

    A block that nobody claims joins the one before it in its piece, else the piece's first segment; a piece without any
    claim is one segment. A segment's blocks keep their order.
    """
    parsed = answered(responses)
    items = _items(parsed)
    rows = _claimed(shown.drop("label", "title", "level", "confidence").join(parsed.select("contract_id", "batch"), ["contract_id", "batch"], "left_semi"), items)
    before = W.partitionBy("contract_id", "batch").orderBy("segment", "place")
    whole = W.partitionBy("contract_id", "batch")
    item = F.coalesce(F.last("item", ignorenulls=True).over(before), F.min("item").over(whole), F.lit(-1))
    return _headed(rows.withColumn("item", item), items, F.struct("batch", "item")).drop("_owner")


def _renumbered(rows: DataFrame) -> DataFrame:
    """Segments anew from 1 by _key, places by their old order."""
    out = rows.withColumn("_new", F.dense_rank().over(W.partitionBy("contract_id").orderBy("_key")))
    out = out.withColumn("place", F.row_number().over(W.partitionBy("contract_id", "_new").orderBy("segment", "place")))
    return out.withColumn("segment", F.col("_new")).drop("_new", "_key")


@dataclass(frozen=True)
class Split:
    segments: DataFrame
    clauses: DataFrame
    boundaries: DataFrame
    summary: DataFrame  # a row for each contract: batches, succeeded, issues_before, issues_after, rounds, reflowed, adopted


def reflow_round(found: DataFrame, issues: DataFrame, ask: Asker, max_signs: int = MAX_SIGNS) -> tuple[DataFrame, DataFrame]:
    """(candidate segments, contracts with reflowed) of one round over the windows that issues touch.

    A contract of which any piece fails has no candidate.
    """
    named = written(touched(found, issues))
    parts = written(pieces(found, windows(named), max_signs))
    shown = found.drop("batch").join(parts.select("contract_id", "segment", "batch", "first"), ["contract_id", "segment"])
    codes = named.join(parts, ["contract_id", "segment"]).groupBy("contract_id", "first").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    problems = parts.select("contract_id", "first", "batch").distinct().join(codes, ["contract_id", "first"])
    replies = written(ask("contract_clause_split", prompts.reflow(shown, problems)).select("contract_id", "batch", "response"))
    failed = parts.select("contract_id", "batch").distinct().join(answered(replies).select("contract_id", "batch"), ["contract_id", "batch"], "left_anti").select("contract_id").distinct()
    good = parts.select("contract_id").distinct().join(failed, "contract_id", "left_anti")
    fresh = window_segments(shown, replies).withColumn("_key", F.struct(F.col("batch").alias("a"), F.col("item").alias("b")))
    rest = found.join(parts.select("contract_id", "segment"), ["contract_id", "segment"], "left_anti").withColumn("_key", F.struct(F.col("segment").alias("a"), F.lit(0).alias("b")))
    names = [*found.columns, "_key"]
    candidate = _renumbered(rest.select(names).unionByName(fresh.select(names)).join(good, "contract_id", "left_semi"))
    return candidate, shown.join(good, "contract_id", "left_semi").groupBy("contract_id").agg(F.count("*").alias("reflowed"))


def split_contracts(blocks: DataFrame, decided: DataFrame, ask: Asker, rounds: int = ROUNDS, threshold: float = validate.THRESHOLD, max_blocks: int = MAX_BLOCKS, max_signs: int = MAX_SIGNS) -> Split:
    """The model's segmentation of all contracts, repaired, and better where asking again about damaged windows helps.

    blocks: prepared; decided: boundaries by rules, which say where batches may be cut. A contract of which all batches
    fail is in no table but the summary: its rule result stays. A round's result is taken, contract by contract, only if
    it has strictly fewer issues; only such contracts go to the next round.
    """
    sent = written(batches(blocks, decided, max_blocks, max_signs))
    replies = written(ask("contract_clause_split", prompts.split(sent, CONTEXT)).select("contract_id", "batch", "response"))
    found = written(segments(sent, replies).drop("batch"))
    issues = written(issues_of(found, threshold))
    count = lambda frame, name: frame.groupBy("contract_id").agg(F.count("*").alias(name))
    summary = sent.groupBy("contract_id").agg(F.count_distinct("batch").alias("batches"))
    summary = summary.join(count(answered(replies), "succeeded"), "contract_id", "left").join(count(issues, "issues_before"), "contract_id", "left")
    summary = summary.na.fill(0).withColumns({"issues_after": F.col("issues_before"), "rounds": F.lit(0), "reflowed": F.lit(0).cast("long"), "adopted": F.lit(0)})
    open_issues = issues
    for number in range(1, rounds + 1):
        if open_issues.isEmpty():
            break
        part = found.join(open_issues.select("contract_id").distinct(), "contract_id", "left_semi")
        candidate, reflowed = reflow_round(part, open_issues, ask, max_signs)
        candidate = written(candidate)
        fresh = written(issues_of(candidate, threshold))
        counts = reflowed.join(count(open_issues, "_old"), "contract_id").join(count(fresh, "_new"), "contract_id", "left").na.fill(0)
        counts = written(counts.withColumn("_taken", F.col("_new") < F.col("_old")).withColumnRenamed("reflowed", "_more"))
        summary = written(summary.join(counts, "contract_id", "left").select(
            "contract_id", "batches", "succeeded", "issues_before", F.when(F.col("_taken"), F.col("_new")).otherwise(F.col("issues_after")).alias("issues_after"),
            F.when(F.col("_more").isNotNull(), number).otherwise(F.col("rounds")).alias("rounds"), (F.col("reflowed") + F.coalesce("_more", F.lit(0))).alias("reflowed"),
            (F.col("adopted") + F.coalesce(F.col("_taken").cast("int"), F.lit(0))).alias("adopted"),
        ))
        taken = counts.filter("_taken").select("contract_id")
        found = written(found.join(taken, "contract_id", "left_anti").unionByName(candidate.join(taken, "contract_id", "left_semi")))
        open_issues = fresh.join(taken, "contract_id", "left_semi")
    return Split(found, clauses_of(found), boundaries_of(found), summary)


def refreshed_warnings(warnings: DataFrame, tree: DataFrame, issues: DataFrame) -> DataFrame:
    """warnings (contract_id, warnings) without those that a new segmentation outdates, and with the issues it has now."""
    now = issues.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.concat(F.lit("[结构校验] "), "code"))).alias("_now"))
    many = tree.groupBy("contract_id").agg((F.count("*") > 1).alias("_many"))
    rows = warnings.join(now, "contract_id", "left").join(many, "contract_id", "left")
    old = lambda w: w.startswith("[结构校验]") | w.contains("等待语义模型或人工复核") | (F.coalesce("_many", F.lit(False)) & w.startswith("未识别到明确的条款编号"))
    return rows.select("contract_id", F.concat(F.filter("warnings", lambda w: ~old(w)), F.coalesce("_now", F.array().cast("array<string>"))).alias("warnings"))


def target_batches(decided: DataFrame, blocks: DataFrame, near: int = NEAR, max_targets: int = MAX_TARGETS, max_shown: int = MAX_SHOWN) -> DataFrame:
    """Boundaries to review (contract_id, seq) with the batch each is asked in and the blocks shown for it, begin to end:
    those within `near` of its targets, at most max_shown unless one target alone needs more."""
    sizes = blocks.groupBy("contract_id").agg(F.max("seq").alias("n"))
    zero = F.lit(0)
    rows = decided.filter("review_required").select("contract_id", "seq").join(sizes, "contract_id").select("contract_id", "seq", "n", zero.alias("batch"), zero.alias("begin"), zero.alias("end"))

    def number(group: list[dict]) -> list[dict]:
        held: list[list] = []  # begin, end, targets
        for row in group:
            begin, end = max(1, row["seq"] - near), min(row["n"], row["seq"] + near)
            last = held[-1] if held else None
            if last and len(last[2]) < max_targets and max(last[1], end) - min(last[0], begin) < max_shown:
                last[:2] = min(last[0], begin), max(last[1], end)
                last[2].append(row)
            else:
                held.append([begin, end, [row]])
        return [row | {"batch": b, "begin": begin, "end": end} for b, (begin, end, rows) in enumerate(held) for row in rows]

    return by_group(rows, ["contract_id"], ["seq"], number).drop("n")


def apply_boundary_answers(decided: DataFrame, asked: DataFrame, responses: DataFrame, model: str = "model") -> DataFrame:
    """Boundaries changed by a model's answers, the first for each boundary that was asked about in that batch.

    An answer with an unknown relation or role changes nothing. Below .60 the rule's relation stays and the boundary is
    marked unresolved; below .78 the model's relation holds but stays for review; .95 is the most that counts. Adds
    boundary_id, rule_relation, rule_confidence, llm_reason, right_block_role, inferred_title, heard and accepted.
    """
    items = responses.select("contract_id", "batch", F.posexplode(F.from_json("response", BOUNDARY)["boundaries"]).alias("i", "x"))
    items = items.select("contract_id", "batch", "i", "x.*").join(asked.select("contract_id", "batch", F.format_string("D%04d", F.col("seq") - 1).alias("boundary_id")), ["contract_id", "batch", "boundary_id"])
    first = W.partitionBy("contract_id", "boundary_id").orderBy("i")
    items = items.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    role = F.coalesce("right_block_role", F.lit("UNKNOWN"))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
    said = items.select(
        "contract_id", "boundary_id", (F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)) & role.isin(*ROLES)).alias("_valid"), F.col("relation").alias("_relation"), sure.alias("_sure"),
        role.alias("_role"), F.substring(strip(F.coalesce("inferred_title", F.lit(""))), 1, 200).alias("_title"), F.substring(strip(F.coalesce("reason", F.lit(""))), 1, 500).alias("_reason"),
    )
    rows = decided.withColumn("boundary_id", F.format_string("D%04d", F.col("seq") - 1)).join(said, ["contract_id", "boundary_id"], "left")
    valid = F.coalesce("_valid", F.lit(False))
    taken, weak = valid & (F.col("_sure") >= UNSURE), valid & (F.col("_sure") < UNSURE)
    accepted = taken & (F.col("_sure") >= SURE)
    reason = F.when(F.col("_reason") == "", "未提供理由").otherwise(F.col("_reason"))
    kept = F.filter("warnings", lambda w: ~w.contains("需要语义模型") & ~w.contains("等待"))
    return rows.withColumns({
        "rule_relation": F.col("relation"), "rule_confidence": F.col("confidence"),
        "relation": F.when(taken, F.col("_relation")).otherwise(F.col("relation")),
        "confidence": F.when(taken, F.round(F.least("_sure", F.lit(MOST)), 2)).otherwise(F.col("confidence")),
        "decision_source": F.when(taken, f"llm:{model}").when(weak, f"llm_unresolved:{model}").otherwise(F.col("decision_source")),
        "evidence": F.when(valid, F.concat("evidence", F.array(F.concat(F.lit("LLM复核："), reason)))).otherwise(F.col("evidence")),
        "warnings": F.when(accepted, kept).when(weak, F.concat("warnings", F.array(F.lit("LLM置信度过低，保留规则结果")))).otherwise(F.col("warnings")),
        "review_required": F.when(taken, ~accepted).otherwise(F.col("review_required")),
        "right_block_role": F.when(valid, F.col("_role")), "inferred_title": F.when(valid, F.col("_title")), "llm_reason": F.when(valid, F.col("_reason")),
        "heard": F.col("_valid").isNotNull(), "accepted": accepted,
    }).drop("_valid", "_relation", "_sure", "_role", "_title", "_reason")


def review_boundaries(blocks: DataFrame, decided: DataFrame, ask: Asker, model: str = "model") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boundaries, clause tree, summary) after a model has looked at the boundaries to review.

    blocks come with headings. summary, for contracts with any such boundary: requested, batches, failed (batches),
    responded, accepted, unresolved.
    """
    asked = written(target_batches(decided, blocks))
    ranges = asked.select("contract_id", "batch", "begin", "end").distinct()
    shown = blocks.select("contract_id", "seq", "block_id", "kind", "text").join(ranges, "contract_id").filter(F.col("seq").between(F.col("begin"), F.col("end")))
    targets = decided.withColumn("boundary_id", F.format_string("D%04d", F.col("seq") - 1)).join(asked.select("contract_id", "seq", "batch"), ["contract_id", "seq"])
    replies = written(ask("contract_boundary_review", prompts.boundary(shown, targets)).select("contract_id", "batch", "response"))
    changed = written(apply_boundary_answers(decided, asked, replies, model))
    failed = replies.withColumn("bad", F.from_json("response", BOUNDARY)["boundaries"].isNull()).groupBy("contract_id").agg(F.count_if("bad").alias("failed"))
    counts = asked.groupBy("contract_id").agg(F.count("*").alias("requested"), F.count_distinct("batch").alias("batches"))
    after = changed.groupBy("contract_id").agg(F.count_if("heard").alias("responded"), F.count_if("accepted").alias("accepted"), F.count_if("review_required").alias("unresolved"))
    return changed, structure.clauses(blocks, changed), counts.join(failed, "contract_id", "left").join(after, "contract_id")
