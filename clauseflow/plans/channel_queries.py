"""Registered queries over small made-up contracts, one for each customer, with their SQL.

They reach what the contracts of synth.py don't: decimal outlines, list numbers and styles, odd amounts, summary dates,
Word files, statutes, sinks, and all steps that ask a model. A model is an expression here: what it answers depends on
the contract's number alone, so that SQL can say what must come out.
"""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, elements, retrieval, review, search, segment, sinks, structure, transport, validate
from ..scratch import shared_dir, written
from ..sources import documents
from . import loop
from .synth import table

_IDS = "array<string>"


def _k() -> Column:
    """The contract's number."""
    return F.col("contract_id")


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contract_id"))


def _say(*parts) -> Column:
    """A text of literals and of columns' values."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _clauses(rows: DataFrame, *texts: Column | str) -> DataFrame:
    """A flat clause tree: contract_id, clause_seq, clause_id, label, title, text, level, parent_id, block_ids."""
    all_texts = F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])
    out = rows.select("contract_id", F.posexplode(all_texts).alias("i", "text")).withColumn("clause_seq", F.col("i") + 1)
    return out.select(
        "contract_id", "clause_seq", F.format_string("C%04d", "clause_seq").alias("clause_id"), _say("第", F.col("clause_seq"), "条").alias("label"), F.lit("").alias("title"), F.lit("").alias("heading"),
        "text", F.lit(2).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.array(F.format_string("B%04d", "clause_seq")).alias("block_ids"),
    )


def _blocks(rows: DataFrame, *texts: str) -> DataFrame:
    out = rows.select("contract_id", F.posexplode(F.array(*map(F.lit, texts))).alias("i", "text"))
    return out.select("contract_id", (F.col("i") + 1).alias("seq"), F.lit("paragraph").alias("kind"), "text")


# Structure: decimals, list numbers, styles, tables, lines of one block.


def _outline(spark: SparkSession, sf_dir: str):
    def block(text: str, kind: str = "paragraph", label: str | None = None, depth: int | None = None, style: str | None = None, outline: int | None = None, turn: int = 0) -> Column:
        fields = {"text": F.lit(text), "kind": F.lit(kind), "numbering_label": F.lit(label).cast("string"), "list_level": F.lit(depth).cast("int"), "style_name": F.lit(style).cast("string"), "outline_level": F.lit(outline).cast("int"), "page": (_k() % 3 + 1 + turn).cast("int")}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    rest = [
        block("1. 总则\n1.1 范围\n1.1.1 细目"), block("编号段", label="（一）", depth=1), block("a | b", kind="table", turn=1), block("附则", style="Heading 2", outline=1),
    ]
    rows = _contracts(spark, sf_dir).withColumn("b", F.when(_k() % 3 == 0, F.array(block("2.1 孤项"), *rest)).otherwise(F.array(*rest)))
    rows = rows.select("contract_id", F.posexplode("b").alias("i", "x")).select("contract_id", (F.col("i") + 1).alias("seq"), "x.*")
    return structure.analyze(rows)


def outline_tree(spark, sf_dir):
    tree = _outline(spark, sf_dir)[2]
    return tree.select("contract_id", "clause_seq", "label", "title", "level", "parent_seq", F.size("block_ids").alias("n_blocks"), F.element_at("source_spans", 1)["line_start"].alias("line"))


def outline_issues(spark, sf_dir):
    blocks, decided, tree = _outline(spark, sf_dir)
    # Six checks read these three, so they are made once and the plans of the checks stay small.
    blocks = written(blocks.select("contract_id", "seq", "block_id"))
    decided = written(decided.select("contract_id", "seq", "left_id", "right_id"))
    tree = written(tree.select("contract_id", "clause_seq", "clause_id", "label", "parent_id"))
    wrong = decided.withColumn("left_id", F.when((_k() % 4 == 0) & F.col("seq").isin(3, 4), "BX").otherwise(F.col("left_id")))
    found = validate.decimal_parents(tree).select("contract_id", "code", F.element_at("clause_ids", 1).alias("detail"))
    found = found.unionByName(validate.boundary_order(blocks, wrong).select("contract_id", "code", F.array_join("block_ids", ",").alias("detail")))
    plain = _contracts(spark, sf_dir)
    single = _blocks(plain.filter(_k() % 5 == 0), "没有编号的一段。").unionByName(_blocks(plain.filter(_k() % 5 != 0), "第一条 甲", "没有编号的一段。"))
    return found.unionByName(structure.unnumbered(structure.analyze(single)[2]).select("contract_id", F.lit("unnumbered").alias("code"), F.lit("").alias("detail")))


def desk_views(spark, sf_dir):
    _, decided, tree = _outline(spark, sf_dir)
    open_ones = search.boundary_filter(decided, True).groupBy("contract_id").agg(F.count("*").alias("n_review"))
    shown = tree.select("contract_id", "clause_id", search.highlighted(F.col("text"), F.array(F.lit("范"), F.lit("总"))).alias("shown"))
    return search.overview(tree).join(shown, ["contract_id", "clause_id"]).join(open_ones, "contract_id").select("contract_id", "clause_id", "pages", "characters", "shown", "n_review")


def json_sinks(spark, sf_dir):
    blocks, decided, tree = _outline(spark, sf_dir)
    at = lambda path: F.get_json_object("json", path)
    whole = sinks.parse_json(blocks, tree, decided).select("contract_id", at("$.stats.clauses").alias("clauses"), at("$.stats.raw_characters").alias("raw_characters"), at("$.clauses[0].label").alias("label"), at("$.boundaries[0].right_id").alias("right_id"))
    odd = _odd(spark, sf_dir)
    with_elements = sinks.contract_json(odd, elements.extract(odd)).select("contract_id", at("$.elements.amounts[2].normalized").alias("amount"), at("$.elements.parties").alias("parties"))
    dated = _dated(spark, sf_dir)
    found = checks.findings(dated, elements.extract(dated))
    found = sinks.findings_json(found, dated).select("contract_id", at("$.findings[0].block_ids").alias("blocks"))
    return whole.join(with_elements, "contract_id").join(found, "contract_id", "left")


# Elements and checks.


def _odd(spark, sf_dir):
    return _clauses(_contracts(spark, sf_dir), _say("租金0元；报酬-", _k(), "元；押金RMB1,200.50元；坐落于幸福路", _k(), "号的房屋，建筑面积为", _k(), ".5平方米。"))


def odd_elements(spark, sf_dir):
    return elements.extract(_odd(spark, sf_dir)).select("contract_id", "seq", "kind", "role", "value", "normalized", "confidence")


def _dated(spark, sf_dir):
    day = _k() % 28 + 1
    return _clauses(_contracts(spark, sf_dir), _say("约定交付日期：2024年1月", day, "日。"), _say("乙方应于2024年1月", day + F.when(_k() % 3 == 0, 1).otherwise(0), "日交货。"))


def summary_dates(spark, sf_dir):
    return checks.check_summary_dates(_dated(spark, sf_dir)).select("contract_id", "code", "message", F.array_join("clause_ids", ",").alias("clauses"), "confidence")


def contained_elements(spark, sf_dir):
    """Party names of which one contains another, and a date given twice."""
    item = lambda seq, kind, value, sure: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(sure).alias("confidence"))
    names = [("北京", "公司"), ("北京", "公司分部"), ("上海", "有限责任公司总部")]
    items = [item(i, "party", _say(a, _k(), b), sure) for i, ((a, b), sure) in enumerate(zip(names, (0.8, 0.9, 0.7), strict=True), 1)] + [item(4, "date", F.lit("2024-01-01"), 0.9), item(5, "date", F.lit("2024-01-01"), 0.9)]
    rows = _contracts(spark, sf_dir).select("contract_id", F.explode(F.array(*items)).alias("x")).select("contract_id", "x.*")
    rows = rows.withColumns({"element_id": F.format_string("E%04d", "seq"), "normalized": F.col("value"), "role": F.lit(""), "clause_seq": F.lit(1), "clause_id": F.lit("C0001"), "block_ids": F.array().cast(_IDS), "source": F.lit("rule")})
    return elements.merge(rows).select("contract_id", "seq", "kind", "value", "confidence")


# Steps that ask a model.


def _answers(requests: DataFrame, *cases: tuple[Column | None, dict | None]) -> DataFrame:
    """The answer of the first case that holds (None: of all), as JSON; null fails."""
    out = None
    for when, answer in cases:
        text = F.lit(None if answer is None else json.dumps(answer, ensure_ascii=False)).cast("string")
        out = F.when(F.lit(True) if when is None else when, text) if out is None else out.when(F.lit(True) if when is None else when, text)
    return requests.select("contract_id", "batch", out.alias("response"))


def model_elements(spark, sf_dir):
    """Five long clauses make two batches; of every second contract the second one fails."""
    tree = _clauses(_contracts(spark, sf_dir), *[F.repeat(F.lit("款"), 2500)] * 5)
    value = lambda v, clause, sure: {"value": v, "normalized": "", "role": "r", "clause_id": clause, "source_text": "", "confidence": sure}
    from ..operators import prompts

    said = _answers(
        prompts.extraction(tree),
        (F.col("batch") == 0, {"amounts": [value("77元", "C0002", 1.5), value(" ", "C0001", 1)], "parties": [], "dates": [], "subjects": []}),
        (_k() % 2 == 0, None),
        (None, {"amounts": [], "parties": [value("某某公司", "C9", 0.5)], "dates": [], "subjects": []}),
    )
    merged, summary = elements.with_model(tree, said)
    last = merged.groupBy("contract_id").agg(F.max_by(F.concat_ws(":", "value", F.coalesce("clause_id", F.lit("-")), "confidence"), "seq").alias("last"))
    return summary.join(last, "contract_id").select("contract_id", "clauses", "rule_elements", "batches", "succeeded", "llm_elements", "merged_elements", "last")


def model_findings(spark, sf_dir):
    """A finding with an unknown clause; contracts of which one batch fails have none."""
    tree = _clauses(_contracts(spark, sf_dir), "甲", "乙")
    finding = {"code": "semantic_conflict", "severity": "low", "message": " 互斥 ", "evidence": "e", "clause_ids": ["C0002", "C0009"], "confidence": 0.666}
    said = tree.filter("clause_seq = 1").select("contract_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("batch"))
    said = _answers(said, (F.col("batch") == 0, {"findings": [finding, finding | {"code": "other"}, finding | {"message": ""}]}), (_k() % 3 == 0, None), (None, {"findings": []}))
    found = checks.findings(tree, elements.extract(tree), responses=said)
    return found.select("contract_id", "finding_id", "code", "severity", "message", F.array_join("clause_ids", ",").alias("clauses"), "confidence", "source")


def split_adoption(spark, sf_dir):
    """Model segmentation: good at once, better when asked again, not better, and failing."""
    blocks, decided, _ = structure.analyze(_blocks(_contracts(spark, sf_dir), "第一条 甲", "一二三", "第二条 乙", "四五六", "第三条 丙", "七八九"))
    item = lambda label, ids, sure=0.95: {"label": label, "title": "", "level": 2, "block_ids": [f"B{i:04d}" for i in ids], "confidence": sure}

    def ask(schema: str, requests: DataFrame) -> DataFrame:
        whole = lambda sure: {"clauses": [item("第一条", (1, 2)), item("第二条", (3, 4), sure), item("第三条", (5,))]}
        part = lambda sure: {"clauses": [item("第一条", (1,)), item("第二条", (3, 4, 3), sure)]}
        again = F.contains("prompt", F.lit("problems="))
        return _answers(requests, (again & (_k() % 4 == 1), part(0.95)), (again, part(0.2)), (_k() % 4 == 0, whole(0.95)), (_k() % 4 == 3, None), (None, whole(0.3)))

    done = segment.split_contracts(blocks, decided, ask)
    tree = done.clauses.groupBy("contract_id").agg(F.count("*").alias("clauses"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_seq", F.concat_ws(":", "label", "heading", "body").alias("t")))), lambda x: x["t"]), "|").alias("tree"))
    sure = done.boundaries.groupBy("contract_id").agg(F.count_if("review_required").alias("n_review"))
    return done.summary.join(tree, "contract_id", "left").join(sure, "contract_id", "left")


def boundary_review(spark, sf_dir):
    """A model's answer about the first boundary: taken, taken for review, too unsure, and with an unknown role."""
    blocks, decided, _ = structure.analyze(_blocks(_contracts(spark, sf_dir), "甲", "乙", "丙", "丁"))
    said = lambda sure, role: {"boundaries": [{"boundary_id": "D0001", "relation": "NEW_CLAUSE", "confidence": sure, "right_block_role": role, "inferred_title": "", "reason": "r"}]}
    ask = lambda schema, requests: _answers(requests, (_k() % 4 == 0, said(0.99, "TITLE")), (_k() % 4 == 1, said(0.7, "BODY")), (_k() % 4 == 2, said(0.5, "BODY")), (None, said(0.9, "HEADLINE")))
    changed, tree, summary = segment.review_boundaries(blocks, decided, ask, "m")
    first = changed.filter("seq = 2").select("contract_id", "relation", "confidence", "decision_source", F.size("warnings").alias("n_warnings"))
    old = _contracts(spark, sf_dir).select("contract_id", F.array(F.lit("未识别到明确的条款编号"), F.lit("[结构校验] x")).alias("warnings"))
    fresh = segment.refreshed_warnings(old, tree, validate.issues(blocks, tree, changed)).select("contract_id", F.array_join("warnings", "|").alias("warnings"))
    n = tree.groupBy("contract_id").agg(F.count("*").alias("clauses"))
    return summary.join(first, "contract_id").join(n, "contract_id").join(fresh, "contract_id")


def review_loops(spark, sf_dir):
    """The whole review with a model that fails, is unsure or objects by contract number, and what came of it."""
    kind = _k() % 6  # 0: plain, 1: law at the second look, 2: unclear facts, 3: a conflict, 4: no judge, 5: no risks
    tree = _clauses(_contracts(spark, sf_dir), "付款", "交付")
    turns: dict[str, int] = {}
    risk = {"code": "unfair_term", "severity": "high", "clause_id": "C0001", "reason": "r", "evidence": "e"}
    verdict = lambda kind: {"verdicts": [{"candidate_id": "KC0001", "assessment": kind, "severity": "high", "reason": "违反。", "article_uid": "a1", "quote": "q"}]}
    ruling = {"verdicts": [{"candidate_id": "KC0001", "keep": True, "severity": "", "review_required": False, "rationale": "why"}], "overall_assessment": "medium_risk", "overall_score": 60, "summary": "s"}
    clash = {"conflicts": [{"type": "severity_mismatch", "description": "d", "involved_ids": ["R0001"], "resolution": "x"}], "has_material_conflict": True}

    def ask(schema: str, requests: DataFrame) -> DataFrame:
        turns[schema] = turns.get(schema, 0) + 1
        first = turns[schema] == 1
        cases: dict[str, list] = {
            "contract_understanding": [(kind == 4, None), (None, {"contract_type": "买卖", "subject_summary": "", "payment_summary": "", "key_obligations": [], "clause_roles": [{"clause_id": "C0002", "role": "交付"}]})],
            "clause_risk_review": [(kind == 5, {"risks": []}), (None, {"risks": [risk]})],
            "legal_application_verdict": [(kind == 2, verdict("insufficient_facts")), (kind == 1, {"verdicts": []}), (None, verdict("legal_risk"))][: 3 if first else 1] + [(None, verdict("legal_risk"))],
            "final_adjudication": [(kind == 4, None), (None, ruling)],
            "cross_module_arbitration": [(kind == 3, clash)][: int(first)] + [(None, {"conflicts": [], "has_material_conflict": False})],
        }
        return _answers(requests, *cases.get(schema, [(None, None)]))

    search_one = lambda queries: queries.select("contract_id", "candidate_id", F.lit("a1").alias("article_uid"), F.lit("民法典").alias("law_name"), F.lit("第一条").alias("article_no"), F.lit("").alias("source_url"))
    done = loop.run_review(tree, ask, search_one)
    at = lambda path: F.get_json_object("report", path)
    report = done.report().select(
        "contract_id", at("$.stats.final_risks").alias("risks"), at("$.stats.review_required").alias("queue"), at("$.overall_assessment").alias("overall"), at("$.overall_score").alias("score"),
        at("$.risks[0].citations[0].article_no").alias("cited"), at("$.risks[0].category").alias("category"), at("$.stats.by_severity.high").alias("high"), at("$.stats.merged_candidates").alias("candidates"),
    )
    roles = done.understanding.select("contract_id", "source", F.array_join(F.transform("clause_roles", lambda x: F.concat_ws(":", x["clause_id"], x["role"])), ",").alias("roles"))
    return done.loops.join(report, "contract_id").join(roles, "contract_id")


def candidates_from_model(spark, sf_dir):
    tree = _clauses(_contracts(spark, sf_dir), "甲", "乙")
    one = tree.filter("clause_seq = 1").select("contract_id", F.lit(0).alias("batch"))
    risk = lambda code, clause: {"code": code, "severity": "", "clause_id": clause, "reason": "r", "evidence": None}
    conflict = lambda *ids: {"code": " ", "severity": "high", "clause_ids": list(ids), "reason": "r", "evidence": "e"}
    found = review.clause_candidates(_answers(one, (_k() % 2 == 0, {"risks": [risk("", "C0001"), risk("zero_rent", "C0009"), risk("zero_rent", "C0002")]}), (None, None)), tree)
    found = found.unionByName(review.cross_candidates(_answers(one, (None, {"conflicts": [conflict("C0001", "C0009"), conflict("C0002", "C0009", "C0001")]})), tree))
    return found.select("contract_id", "candidate_id", "code", "severity", F.array_join("clause_ids", ",").alias("clauses"), "confidence", "source")


def law_and_citations(spark, sf_dir):
    """Search texts, verdicts with and without an article of the round's pool, and an open candidate answered later."""
    rows = _contracts(spark, sf_dir)
    tree = _clauses(rows, _say("首条", _k()), "次条")
    candidate = lambda i, code, ids: F.struct(F.lit(f"KC{i:04d}").alias("candidate_id"), F.lit(i).alias("seq"), F.lit(code).alias("code"), F.array(*map(F.lit, ids)).cast(_IDS).alias("clause_ids"))
    found = rows.select("contract_id", F.explode(F.array(candidate(1, "zero_rent", ["C0002", "C0001"]), candidate(2, "own_code", []), candidate(3, "zero_rent", ["C0002"]))).alias("x")).select("contract_id", "x.*")
    found = found.withColumn("evidence", F.array(_say("e", _k()))).withColumn("message", F.lit("m"))
    verdict = lambda i, uid: F.struct(F.lit(f"KC{i:04d}").alias("candidate_id"), F.lit("legal_risk").alias("assessment"), F.lit("high").alias("severity"), F.lit("r").alias("reason"), F.lit(uid).alias("article_uid"), F.lit("q").alias("quote"))
    said = lambda *vs: rows.select("contract_id", F.explode(F.array(*vs)).alias("v")).select("contract_id", "v.*")
    pool = rows.select("contract_id", F.lit("a1").alias("article_uid"), F.lit("民法典").alias("law_name"), _say("第", _k(), "条").alias("article_no"), F.lit(None).cast("string").alias("source_url"))
    applied = review.applications(found, said(verdict(1, "a1"), verdict(2, "zz")), pool)
    again = review.applications(found.join(review.unresolved(applied).select("contract_id", "candidate_id"), ["contract_id", "candidate_id"], "left_semi"), said(verdict(3, "a1")), pool)
    applied = review.upsert(applied, again, ["contract_id", "candidate_id"])
    asked = review.law_queries(found, tree).join(review.law_queries(found, tree, retry=True).withColumnRenamed("text", "wider"), ["contract_id", "candidate_id"])
    return asked.join(applied, ["contract_id", "candidate_id"]).select("contract_id", "candidate_id", "text", "wider", "assessment", "cited")


# Files.

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_STYLES = f'<w:styles {_W}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'
_LEVEL = '<w:lvl w:ilvl="{0}"><w:start w:val="{1}"/><w:numFmt w:val="{2}"/><w:lvlText w:val="{3}"/></w:lvl>'
_NUMBERING = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="7">{_LEVEL.format(0, 1, "chineseCounting", "第%1条")}{_LEVEL.format(1, 3, "decimal", "(%2)")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'


def _docx(number: int, name: str) -> bytes:
    """A Word file with a styled title, list numbers on two levels, a tab, an empty paragraph and a table."""
    run = lambda text: f"<w:r><w:rPr><w:b/><w:sz w:val=\"24\"/></w:rPr><w:t>{text}</w:t></w:r>"
    listed = lambda level, inner: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr>{inner}</w:p>'
    cells = "".join(f"<w:tr>{''.join(f'<w:tc><w:p>{run(c)}</w:p></w:tc>' for c in row)}</w:tr>" for row in ((str(number), name), ("", ""), ("x", "y")))
    title = f'<w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="center"/></w:pPr>{run("合同 " + name)}</w:p>'
    body = title + listed(0, run("目的")) + listed(1, run("一") + "<w:r><w:tab/><w:t>二</w:t></w:r>") + listed(1, run("三")) + "<w:p/>" + listed(0, run("价款")) + listed(1, run("四")) + f"<w:tbl>{cells}</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", _STYLES)
        z.writestr("word/numbering.xml", _NUMBERING)
    return out.getvalue()


def upload_blocks(spark, sf_dir):
    """Word and text uploads of each nation, good and bad ones, as blocks and errors."""

    @F.pandas_udf("binary")
    def content(kind: pd.Series, number: pd.Series, name: pd.Series) -> pd.Series:
        make = {"word": _docx, "broken": lambda n, s: b"no zip", "text": lambda n, s: f"第一条 {s}\r\n\r\n正　文{n}".encode("gb18030"), "odd": lambda n, s: b"x", "none": lambda n, s: b""}
        return pd.Series([make[k](int(n), s) for k, n, s in zip(kind, number, name, strict=True)])

    nation = table(spark, sf_dir, "nation")
    kinds = (("word", ".DOCX"), ("broken", ".docx"), ("text", ".txt"), ("odd", ".exe"), ("none", ".txt"))
    rows = nation.select("n_nationkey", "n_name", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in kinds])).alias("x"))
    rows = rows.select(_say(F.col("x.k"), F.col("n_nationkey"), F.col("x.s")).alias("filename"), F.lower("x.s").alias("suffix"), content("x.k", "n_nationkey", "n_name").alias("content")).withColumn("length", F.length("content").cast("long"))
    blocks, errors = documents.parse_uploads(rows)
    blocks = blocks.select("filename", "seq", "kind", "text", F.coalesce("numbering_label", F.lit("")).alias("label"), F.coalesce("list_level", F.lit(-1)).alias("depth"), F.coalesce("style_name", F.lit("")).alias("style"), F.coalesce("outline_level", F.lit(-1)).alias("outline"))
    short = F.regexp_extract("error", "^[A-Za-z ]+", 0)
    return blocks.unionByName(errors.select("filename", F.lit(0).alias("seq"), F.lit("error").alias("kind"), short.alias("text"), F.lit("").alias("label"), F.lit(-1).alias("depth"), F.lit("").alias("style"), F.lit(-1).alias("outline")))


def _statutes(spark, sf_dir) -> DataFrame:
    """An article for each part, written as JSON lines and read again."""
    import uuid

    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        _say("a", p).alias("article_uid"), F.lit("民法典").alias("law_name"), F.when(p % 4 == 0, _say(p, "条")).when(p % 4 == 1, _say("第", p, "条")).otherwise("").alias("article_no"), _say(F.col("p_name"), " ", F.col("p_type")).alias("content"),
        F.when(p % 5 == 0, "repealed").otherwise("effective").alias("status"), F.array(_say("t", p % 4), F.lit("x"), F.lit("x")).alias("risk_tags"),
    )
    path = f"{shared_dir(spark)}/clauseflow/statutes-{uuid.uuid4().hex}"
    sinks.write_json_lines(rows, path)
    return documents.read_articles(spark, path)


def statute_merge(spark, sf_dir):
    articles = _statutes(spark, sf_dir)
    curated = articles.filter("status = 'effective'").select("article_uid", F.array(F.lit("x"), F.lit("new")).alias("risk_tags"), F.lit(None).cast(_IDS).alias("contract_types"))
    merged = retrieval.merge_articles(articles, curated)
    out = merged.select("article_uid", "article_no", F.array_join("risk_tags", ",").alias("tags"))
    return out.unionByName(retrieval.change_counts(merged).select(F.lit("all").alias("article_uid"), F.concat_ws(",", "articles", "prefix_fixed").alias("article_no"), F.concat_ws(",", "merged_risk_tags", "merged_contract_types").alias("tags")))


def statute_index(spark, sf_dir):
    """The index of effective articles: built, written, read, and what a search of it shows."""
    import uuid

    path = f"{shared_dir(spark)}/clauseflow/index-{uuid.uuid4().hex}"
    retrieval.build_index(_statutes(spark, sf_dir), lambda texts: transport.embedded(texts, transport.hash_embedding), path)
    posts, vectors, articles = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "vectors", "articles"))
    sizes = posts.groupBy("id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))
    rows = sizes.join(vectors.select("id", F.size("embedding").alias("n_dims")), "id")
    hits = rows.select(F.lit("q").alias("query_id"), "id", F.lit(1).alias("rank"), F.lit(None).cast("double").alias("score"))
    shown = retrieval.retrieved(hits, articles.withColumnsRenamed({"id": "article_uid", "text": "content"}))
    return rows.join(shown.select(F.col("article_uid").alias("id"), "content", "authority_level", "score", F.size("contract_types").alias("n_types")), "id")


def manifest_gold(spark, sf_dir):
    """Records out of a manifest file, the articles they should find by strong or weak tags, and how a search did."""
    import uuid

    path = f"{shared_dir(spark)}/clauseflow/manifest-{uuid.uuid4().hex}"
    nation, n = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    record = F.struct(n.cast("string").alias("record_id"), F.array(_say("i", n % 4), F.lit("none")).alias("issue_codes"))
    nation.coalesce(1).agg(F.to_json(F.struct(F.array_sort(F.collect_list(record)).alias("records"))).alias("value")).write.text(path)
    records = documents.read_manifest(spark, path, "record_id string, issue_codes array<string>")
    specs = spark.createDataFrame([("i0", ["t0"], [], "a"), ("i1", [], ["t1", "t9"], "b"), ("i2", [], [], "c"), ("i3", ["t3"], ["t1"], "d")], f"code string, strong {_IDS}, weak {_IDS}, text string")
    wanted = retrieval.gold(records, specs, _statutes(spark, sf_dir))
    first = table(spark, sf_dir, "part").orderBy("p_partkey").limit(7).select(_say("a", F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("p"))  # a search's top 7
    queries = wanted.select("query_id").distinct()
    results = retrieval.ranked(queries.join(first, F.lit(True)).withColumn("score", -F.col("p").cast("double")), 7).select("query_id", "id", "rank")
    rows = retrieval.evaluate_tiers(results, wanted, 5)
    return rows.select("tier", "code", "queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr_hits", "mrr_all")])


QUERIES = {
    f.__name__: f
    for f in (
        outline_tree, outline_issues, desk_views, json_sinks, odd_elements, summary_dates, contained_elements, model_elements, model_findings, split_adoption, boundary_review, review_loops,
        candidates_from_model, law_and_citations, upload_blocks, statute_merge, statute_index, manifest_gold,
    )
}

_C = "SELECT c_custkey AS k, c_custkey % 3 = 0 AS odd FROM customer"
_TREE = "v(i, label, title, lv, parent, nb, line, txt, pages) AS (VALUES (1, '1.', '总则', 2, NULL, 1, 1, '1. 总则', 0), (2, '1.1', '范围', 3, 1, 1, 2, '1.1 范围', 0), (3, '1.1.1', '细目', 4, 2, 1, 3, '1.1.1 细目', 0), (4, '（一）', '编号段', 3, 1, 2, 1, '编号段' || chr(10) || 'a | b', 1), (5, '标题', '附则', 2, NULL, 1, 1, '附则', 0)), o AS (SELECT k, odd::INT AS s, v.* FROM c, v UNION ALL SELECT k, 0, 1, '2.1', '孤项', 3, NULL, 1, 1, '2.1 孤项', 0 FROM c WHERE odd)"
_FIRST = "CASE WHEN label = '2.1' THEN 1 ELSE i + s END"
_STATUTE = "st AS (SELECT p_partkey AS p, 'a' || p_partkey AS uid, p_partkey % 5 <> 0 AS good, p_name || ' ' || p_type AS content FROM part)"

ORACLES = {
    "outline_tree": f"WITH c AS ({_C}), {_TREE} SELECT k AS contract_id, CAST({_FIRST} AS INTEGER) AS clause_seq, label, title, CAST(lv AS INTEGER) AS level, CAST(parent + s AS INTEGER) AS parent_seq, CAST(nb AS INTEGER) AS n_blocks, CAST(line AS INTEGER) AS line FROM o",
    "outline_issues": f"""WITH c AS ({_C}) SELECT k AS contract_id, 'decimal_parent_missing' AS code, 'C0001' AS detail FROM c WHERE odd
UNION ALL SELECT k, 'boundary_order_mismatch', 'BX,' || CASE WHEN odd THEN 'B0002-L002' ELSE 'B0001-L003' END FROM c WHERE k % 4 = 0 UNION ALL SELECT k, 'unnumbered', '' FROM c WHERE k % 5 = 0""",
    "desk_views": f"""WITH c AS ({_C}), {_TREE} SELECT k AS contract_id, 'C' || lpad(CAST({_FIRST} AS VARCHAR), 4, '0') AS clause_id, CASE WHEN pages = 1 THEN (k % 3 + 1) || '-' || (k % 3 + 2) ELSE CAST(k % 3 + 1 AS VARCHAR) END AS pages,
CAST(length(txt) AS INTEGER) AS characters, CASE WHEN txt LIKE '%范%' THEN replace(txt, '范', '【范】') ELSE replace(txt, '总', '【总】') END AS shown, CAST(1 AS BIGINT) AS n_review FROM o""",
    "json_sinks": f"""WITH c AS ({_C}) SELECT k AS contract_id, CASE WHEN odd THEN '6' ELSE '5' END AS clauses, CASE WHEN odd THEN '35' ELSE '29' END AS raw_characters, CASE WHEN odd THEN '2.1' ELSE '1.' END AS label,
CASE WHEN odd THEN 'B0002-L001' ELSE 'B0001-L002' END AS right_id, '1200.50' AS amount, '[]' AS parties, CASE WHEN odd THEN '["B0001","B0002"]' END AS blocks FROM c""",
    "odd_elements": f"""WITH c AS ({_C}) SELECT k AS contract_id, CAST(i AS INTEGER) AS seq, kind, role, replace(value, '#', CAST(k AS VARCHAR)) AS value, replace(normalized, '#', CAST(k AS VARCHAR)) AS normalized, CAST(sure AS DOUBLE) AS confidence
FROM c, (VALUES (1, 'amount', '租金', '0', '0', 0.82), (2, 'amount', '报酬', '#', '#', 0.82), (3, 'amount', '押金', '1,200.50', '1200.50', 0.9), (4, 'subject', '坐落地址', '幸福路#号', '幸福路#号', 0.85), (5, 'subject', '建筑面积', '#.5平方米', '#.5', 0.85)) v(i, kind, role, value, normalized, sure)""",
    "summary_dates": f"""WITH c AS ({_C}) SELECT k AS contract_id, 'date_conflict' AS code, '摘要中约定的交付日期 2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || ' 与条款中的交付日期（2024-01-' || lpad(CAST(k % 28 + 2 AS VARCHAR), 2, '0') || '）不一致。' AS message,
'C0001,C0002' AS clauses, CAST(0.9 AS DOUBLE) AS confidence FROM c WHERE odd""",
    "contained_elements": f"""WITH c AS ({_C}) SELECT k AS contract_id, CAST(i AS INTEGER) AS seq, kind, replace(value, '#', CAST(k AS VARCHAR)) AS value, CAST(sure AS DOUBLE) AS confidence
FROM c, (VALUES (1, 'party', '北京#公司分部', 0.9), (2, 'party', '上海#有限责任公司总部', 0.7), (3, 'date', '2024-01-01', 0.9)) v(i, kind, value, sure)""",
    "model_elements": f"""WITH c AS ({_C}) SELECT k AS contract_id, CAST(5 AS BIGINT) AS clauses, CAST(0 AS BIGINT) AS rule_elements, CAST(2 AS BIGINT) AS batches, CAST(1 + k % 2 AS BIGINT) AS succeeded, CAST(1 + k % 2 AS BIGINT) AS llm_elements, CAST(1 + k % 2 AS BIGINT) AS merged_elements,
CASE WHEN k % 2 = 1 THEN '某某公司:-:0.5' ELSE '77元:C0002:1.0' END AS last FROM c""",
    "model_findings": f"WITH c AS ({_C}) SELECT k AS contract_id, 'F0001' AS finding_id, 'semantic_conflict' AS code, 'low' AS severity, '互斥' AS message, 'C0002' AS clauses, CAST(0.67 AS DOUBLE) AS confidence, 'm4_llm' AS source FROM c WHERE NOT odd",
    "split_adoption": f"""WITH c AS ({_C}), t AS (SELECT '第一条:第一条:甲' || chr(10) || '一二三|第二条:第二条:乙' || chr(10) || '四五六|第三条:第三条:丙' || chr(10) || '七八九' AS tree)
SELECT k AS contract_id, CAST(1 AS BIGINT) AS batches, CAST(k % 4 <> 3 AS BIGINT) AS succeeded, CAST(k % 4 IN (1, 2) AS BIGINT) AS issues_before, CAST(k % 4 = 2 AS BIGINT) AS issues_after, CAST(k % 4 IN (1, 2) AS INTEGER) AS rounds,
CASE WHEN k % 4 IN (1, 2) THEN CAST(4 AS BIGINT) ELSE 0 END AS reflowed, CAST(k % 4 = 1 AS INTEGER) AS adopted, CASE WHEN k % 4 <> 3 THEN CAST(3 AS BIGINT) END AS clauses, CASE WHEN k % 4 <> 3 THEN tree END AS tree, CASE WHEN k % 4 <> 3 THEN CAST(k % 4 = 2 AS BIGINT) END AS n_review FROM c, t""",
    "boundary_review": f"""WITH c AS ({_C}) SELECT k AS contract_id, CAST(3 AS BIGINT) AS requested, CAST(1 AS BIGINT) AS batches, CAST(0 AS BIGINT) AS failed, CAST(1 AS BIGINT) AS responded, CAST(k % 4 = 0 AS BIGINT) AS accepted, CAST(3 - (k % 4 = 0)::INT AS BIGINT) AS unresolved,
CASE WHEN k % 4 < 2 THEN 'NEW_CLAUSE' ELSE 'SAME_CLAUSE' END AS relation, CAST(CASE k % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.7 ELSE 0.42 END AS DOUBLE) AS confidence, CASE k % 4 WHEN 0 THEN 'llm:m' WHEN 1 THEN 'llm:m' WHEN 2 THEN 'llm_unresolved:m' ELSE 'default_rule' END AS decision_source,
CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS n_warnings, CAST(CASE WHEN k % 4 < 2 THEN 2 ELSE 1 END AS BIGINT) AS clauses,
CASE WHEN k % 4 < 2 THEN '' ELSE '未识别到明确的条款编号|' END || '[结构校验] low_confidence_boundary' AS warnings FROM c""",
    "review_loops": f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 6 AS x FROM customer) SELECT k AS contract_id, CAST(x = 1 AS INTEGER) AS legal_retries, CASE WHEN x = 4 THEN 2 ELSE 0 END AS judge_retries, CAST(x = 2 AS INTEGER) AS evidence_rounds, CAST(x = 3 AS INTEGER) AS arbitration_rounds,
CASE WHEN x = 5 THEN '0' ELSE '1' END AS risks, CASE WHEN x IN (2, 4) THEN '5' ELSE '4' END AS queue, CASE x WHEN 5 THEN 'low_risk' WHEN 4 THEN 'unknown' ELSE 'medium_risk' END AS overall, CASE x WHEN 5 THEN '90' WHEN 4 THEN NULL ELSE '60' END AS score,
CASE WHEN x NOT IN (4, 5) THEN '第一条' END AS cited, CASE x WHEN 5 THEN NULL WHEN 4 THEN '' WHEN 2 THEN 'insufficient_facts' ELSE 'legal_risk' END AS category, CASE WHEN x <> 5 THEN '1' END AS high, CASE WHEN x = 5 THEN '0' ELSE '1' END AS candidates,
CASE WHEN x = 4 THEN 'unavailable' ELSE 'llm' END AS source, CASE WHEN x = 4 THEN '' ELSE 'C0002:交付,C0001:其他' END AS roles FROM c""",
    "candidates_from_model": f"""WITH c AS ({_C}) SELECT k AS contract_id, id AS candidate_id, code, severity, clauses, CAST(0.8 AS DOUBLE) AS confidence, source FROM c, (VALUES ('KC0001', 'risk', 'medium', 'C0001', 'clause_llm'), ('KC0002', 'zero_rent', 'medium', 'C0002', 'clause_llm'), ('XC0001', 'cross_conflict', 'high', 'C0002,C0001', 'cross_llm')) v(id, code, severity, clauses, source)
WHERE k % 2 = 0 OR id = 'XC0001'""",
    "law_and_citations": f"""WITH c AS ({_C}) SELECT k AS contract_id, id AS candidate_id, label || ' e' || k || CASE i WHEN 1 THEN ' 首条' || k WHEN 3 THEN ' 次条' ELSE '' END AS text, label || ' m' AS wider, 'legal_risk' AS assessment, CASE WHEN i <> 2 THEN '《民法典》第' || k || '条' END AS cited
FROM c, (VALUES (1, 'KC0001', '租金为零'), (2, 'KC0002', 'own_code'), (3, 'KC0003', '租金为零')) v(i, id, label)""",
    "upload_blocks": """WITH w(seq, kind, text, label, depth, style, outline) AS (VALUES (1, 'paragraph', '合同 @', '', -1, 'heading 1', 0), (2, 'paragraph', '目的', '第一条', 0, '', -1), (3, 'paragraph', '一 二', '(3)', 1, '', -1), (4, 'paragraph', '三', '(4)', 1, '', -1),
  (5, 'paragraph', '价款', '第二条', 0, '', -1), (6, 'paragraph', '四', '(3)', 1, '', -1), (7, 'table', '# | @' || chr(10) || 'x | y', '', -1, '', -1)),
x AS (SELECT 'word' || n_nationkey || '.DOCX' AS filename, w.*, n_nationkey, n_name FROM nation, w
  UNION ALL SELECT 'text' || n_nationkey || '.txt', seq, 'paragraph', text, '', -1, '', -1, n_nationkey, n_name FROM nation, (VALUES (1, '第一条 @'), (2, '正 文#')) t(seq, text)
  UNION ALL SELECT f || n_nationkey || s, 0, 'error', e, '', -1, '', -1, n_nationkey, n_name FROM nation, (VALUES ('broken', '.docx', 'BadZipFile'), ('odd', '.exe', 'unsupported suffix'), ('none', '.txt', 'empty file')) t(f, s, e))
SELECT filename, CAST(seq AS INTEGER) AS seq, kind, replace(replace(text, '@', n_name), '#', CAST(n_nationkey AS VARCHAR)) AS text, label, CAST(depth AS INTEGER) AS depth, style, CAST(outline AS INTEGER) AS outline FROM x""",
    "statute_merge": f"""WITH {_STATUTE}, x AS (SELECT uid, CASE p % 4 WHEN 0 THEN '第' || p || '条' WHEN 1 THEN '第' || p || '条' ELSE '' END AS no, 't' || (p % 4) || ',x,x' || CASE WHEN good THEN ',new' ELSE '' END AS tags, p % 4 = 0 AS fixed, good FROM st)
SELECT uid AS article_uid, no AS article_no, tags FROM x UNION ALL SELECT 'all', count(*) || ',' || count_if(fixed), count_if(good) || ',0' FROM x""",
    "statute_index": f"""WITH {_STATUTE}, u AS (SELECT uid, content, regexp_extract_all(lower(content), '[0-9a-z]+') AS t FROM st WHERE good),
tok AS (SELECT uid, content, list_concat(t, list_filter(list_transform(generate_series(1, len(t) - 1), lambda i: CASE WHEN length(t[i]) = 1 AND length(t[i + 1]) = 1 THEN t[i] || t[i + 1] END), lambda x: x IS NOT NULL)) AS t FROM u)
SELECT uid AS id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms, 64 AS n_dims, content, '' AS authority_level, CAST(0 AS DOUBLE) AS score, 0 AS n_types FROM tok""",
    "manifest_gold": """WITH r AS (SELECT n_nationkey AS n, n_nationkey % 4 AS i FROM nation WHERE n_nationkey % 4 <> 2), a AS (SELECT p_partkey AS p, p_partkey % 4 AS t, row_number() OVER (ORDER BY p_partkey) AS rank FROM part),
q AS (SELECT n, i, CASE WHEN i = 1 THEN 'weak' ELSE 'strong' END AS tier, count(*) AS wanted, count_if(rank <= 5) AS hits, min(rank) FILTER (rank <= 5) AS f FROM r JOIN a ON a.t = r.i GROUP BY n, i)
SELECT tier, 'i' || i AS code, count(*) AS queries, round(avg(hits / wanted), 6) AS recall, round(avg(1.0 / f), 6) AS mrr_hits, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr_all FROM q GROUP BY GROUPING SETS ((tier, i), (tier))""",
}
