"""Blocks to headings, boundaries and the clause tree, by windows within a contract.

Blocks: contract_id, seq (int order), kind, text, and, where a source has them, page, source_block, numbering_label,
list_level, style_name, outline_level; columns that are absent count as null. A null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import let, strip

AUTO_ACCEPT = 0.90
OPTIONAL = {"page": "int", "source_block": "string", "numbering_label": "string", "list_level": "int", "style_name": "string", "outline_level": "int"}
HEADING = "struct<label:string,title:string,level:int,heading:string,inline_body:string,kind:string,confidence:double>"


def with_optional(blocks: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in blocks.columns}
    return blocks.withColumns(missing | {"text": F.coalesce("text", F.lit(""))})


def remainder_parts(remainder: Column) -> Column:
    """struct(title, body, ambiguous) of what follows a label: a sentence is the clause's body, else it is its title."""

    def of(r: Column) -> Column:
        marks = F.regexp_count(r, F.lit("[，,；;。]"))
        cue = (F.length(r) >= 12) & F.regexp_like(r, F.lit(P.BODY_CUES))
        body = F.regexp_like(r, F.lit(f"[{P.SENTENCE_ENDINGS}]$")) | (F.length(r) > 36) | (marks >= 2) | cue
        unsure = F.when(body, F.length(r).between(8, 40)).otherwise(F.length(r).between(12, 36))
        return F.struct(F.when(body, F.lit("")).otherwise(r).alias("title"), F.when(body, r).otherwise(F.lit("")).alias("body"), unsure.alias("ambiguous"))

    return let(strip(remainder), of)


def _heading(label: Column, level: Column, parts: Column, heading: Column, kind: str, sure: float, unsure: float) -> Column:
    return F.struct(
        label.alias("label"),
        parts["title"].alias("title"),
        level.cast("int").alias("level"),
        heading.alias("heading"),
        parts["body"].alias("inline_body"),
        F.lit(kind).alias("kind"),
        F.when(parts["ambiguous"], F.lit(unsure)).otherwise(F.lit(sure)).alias("confidence"),
    )


def line_heading(text: Column) -> Column:
    """The heading of a text's first line, by the first of the fixed patterns that matches; null without, or past 180 signs."""

    def of(line: Column) -> Column:
        out = None
        for pattern, kind, level in P.HEADINGS:
            label = strip(F.regexp_extract(line, pattern, 1))
            depth = F.least(F.lit(6), F.size(F.split(label, r"\.")) + 1) if kind == "decimal" else F.lit(level)
            parts = remainder_parts(F.regexp_extract(line, pattern, 2))
            found = _of_parts(parts, label, depth, line, kind)
            test = F.regexp_like(line, F.lit(pattern))
            out = F.when(test, found) if out is None else out.when(test, found)
        begins = F.regexp_like(line, F.lit(P.HEADING_BEGINS))  # one test for all the lines that are no heading
        return F.when((F.length(line) <= 180) & begins, out)

    return let(strip(F.element_at(F.split(text, r"\R", 2), 1)), of)


def is_heading(line: Column) -> Column:
    """Whether line_heading() of a line without blanks at its ends is there: one test, without a lambda of its own."""
    return (F.length(line) <= 180) & F.regexp_like(line, F.lit("|".join(f"(?:{pattern})" for pattern, _, _ in P.HEADINGS)))


def _of_parts(parts: Column, label: Column, depth: Column, line: Column, kind: str) -> Column:
    return let(parts, lambda p: _heading(label, depth, p, F.when(p["body"] != "", label).otherwise(line), kind, 0.98, 0.86))


def block_heading() -> Column:
    """The heading of a block: of its text, else of its list numbering, else of its style. Tables have none."""
    text = F.col("text")
    numbered = let(
        remainder_parts(text),
        lambda p: _heading(
            strip(F.col("numbering_label")),
            F.least(F.lit(6), F.coalesce("list_level", F.lit(0)) + 2),
            p,
            F.concat(strip(F.col("numbering_label")), F.when(p["title"] != "", F.concat(F.lit(" "), p["title"])).otherwise("")),
            "word_numbering",
            0.96,
            0.84,
        ),
    )
    styled = F.struct(
        F.lit("").alias("label"),
        text.alias("title"),
        F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(F.col("outline_level") + 1, F.lit(2)))).cast("int").alias("level"),
        text.alias("heading"),
        F.lit("").alias("inline_body"),
        F.lit("word_heading_style").alias("kind"),
        F.lit(0.94).alias("confidence"),
    )
    style = F.coalesce("style_name", F.lit(""))
    is_style = (F.col("outline_level").isNotNull() | F.lower(style).startswith("heading") | style.contains("标题")) & (F.length(text) <= 100)
    found = F.coalesce(
        line_heading(text).cast(HEADING),
        F.when(F.coalesce(strip(F.col("numbering_label")), F.lit("")) != "", numbered).cast(HEADING),
        F.when(is_style, styled).cast(HEADING),
    )
    return F.when(F.col("kind") != "table", found)


def prepare_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of several lines among which is a heading come apart into one block a line; others pass. seq is renewed.

    block_id names the new block, source_block, line_start and line_end where it came from.
    """
    blocks = with_optional(blocks)
    lines = F.filter(F.transform(F.split("text", r"\R", -1), lambda x: strip(x)), lambda x: x != "")
    blocks = blocks.withColumn("_lines", lines).withColumn("_id", F.coalesce("source_block", F.format_string("B%04d", F.col("seq"))))
    apart = (F.col("kind") != "table") & (F.size("_lines") > 1) & F.exists("_lines", is_heading)
    blocks = blocks.withColumn("_apart", F.coalesce(apart, F.lit(False)))
    out = blocks.select(*[c for c in blocks.columns if c != "text"], F.posexplode(F.when(F.col("_apart"), F.col("_lines")).otherwise(F.array("text"))).alias("_i", "text"))
    line = F.when(F.col("_apart"), F.col("_i") + 1)
    out = out.withColumns({
        "block_id": F.when(line.isNull(), F.col("_id")).otherwise(F.format_string("%s-L%03d", F.col("_id"), line)),
        "source_block": F.col("_id"),
        "line_start": F.coalesce(line, F.when(F.size("_lines") > 0, 1)),
        "line_end": F.coalesce(line, F.when(F.size("_lines") > 0, F.size("_lines"))),
    })
    order = W.partitionBy("contract_id").orderBy("seq", "line_start")
    return out.withColumn("seq", F.row_number().over(order)).drop("_i", "_apart", "_lines", "_id")


def with_headings(blocks: DataFrame) -> DataFrame:
    return with_optional(blocks).withColumn("heading", block_heading())


def _related(blocks: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Blocks (with headings) and what lies before them, and the columns of their boundaries; _first has none."""
    w = W.partitionBy("contract_id").orderBy("seq")
    rows = blocks.withColumns({
        "left_id": F.lag("block_id").over(w),
        "_left_source": F.lag("source_block").over(w),
        "_first": F.row_number().over(w) == 1,
        "_anchored": F.max(F.col("heading").isNotNull()).over(W.partitionBy("contract_id")),
    })
    headed, level = F.col("heading").isNotNull(), F.col("heading.level")
    same = (F.col("_left_source") == F.col("source_block")) & (F.col("left_id") != F.col("block_id"))
    default = F.when(F.col("_anchored"), 0.76).otherwise(0.42)
    default = F.when(F.col("kind") == "table", F.least(default, F.lit(0.68))).otherwise(default)
    confidence = F.round(F.when(headed, F.col("heading.confidence")).when(same, 0.90).otherwise(default), 2)
    warn = [
        F.when(headed & (F.col("heading.confidence") < 0.9), "编号后的内容可能是标题，也可能是同一行正文"),
        F.when(~headed & ~same & (F.col("kind") == "table"), "表格归属需要结合上下文确认"),
        F.when(~headed & ~same & ~F.col("_anchored"), "全文缺少结构锚点，需要语义模型判断边界"),
    ]
    label = F.when(F.col("heading.label") == "", "无编号标题").otherwise(F.col("heading.label"))
    same = F.coalesce(same, F.lit(False))
    return rows, [
        F.col("contract_id"),
        F.col("seq"),
        F.col("left_id"),
        F.col("block_id").alias("right_id"),
        F.when(headed & (level <= 2), "NEW_CLAUSE").when(headed, "NEW_SUBCLAUSE").when(same, "CONTINUATION").otherwise("SAME_CLAUSE").alias("relation"),
        confidence.alias("confidence"),
        F.when(headed, F.col("heading.kind")).when(same, "layout_rule").otherwise("default_rule").alias("decision_source"),
        F.array(F.when(headed, F.concat(F.lit("右侧识别为"), label, F.lit("，层级"), level.cast("string"))).when(same, "两个文本块来自同一PDF原始区块的相邻行").otherwise("未发现新的编号或标题结构")).alias("evidence"),
        F.filter(F.array(*warn), lambda x: x.isNotNull()).alias("warnings"),
        (confidence < AUTO_ACCEPT).alias("review_required"),
    ]


def boundaries(blocks: DataFrame) -> DataFrame:
    """The relation of each block to the one before it: contract_id, seq (of the right one), left_id, right_id, relation,
    confidence, decision_source, evidence, warnings, review_required. Blocks come with headings."""
    rows, columns = _related(blocks)
    return rows.filter(~F.col("_first")).select(*columns)


def clauses(blocks: DataFrame, decided: DataFrame) -> DataFrame:
    """The clause tree: blocks (with headings) grouped at the boundaries that open a clause, parents by level.

    decided: boundaries, perhaps changed by a model; right_block_role and inferred_title may name the title of a clause
    that no heading opens. Such subclauses in a row go one level deeper each, 6 at most.
    """
    extra = {c: F.lit(None).cast("string") for c in ("right_block_role", "inferred_title") if c not in decided.columns}
    marks = decided.withColumns(extra).select("contract_id", "seq", "relation", F.col("confidence").alias("_sure"), "right_block_role", "inferred_title")
    return _tree(blocks.join(marks, ["contract_id", "seq"], "left"))


def own_clauses(blocks: DataFrame) -> DataFrame:
    """clauses() at the boundaries() of the same blocks, which need no join: each block has its own at hand."""
    rows, _ = _related(blocks)
    headed, level = F.col("heading").isNotNull(), F.col("heading.level")
    relation = F.when(~F.col("_first"), F.when(headed & (level <= 2), "NEW_CLAUSE").when(headed, "NEW_SUBCLAUSE").otherwise("SAME_CLAUSE"))
    none = F.lit(None).cast("string")  # a boundary that opens a clause here has a heading, so that nothing is guessed
    return _tree(rows.withColumns({"relation": relation, "_sure": F.lit(None).cast("double"), "right_block_role": none, "inferred_title": none}))


def _tree(rows: DataFrame) -> DataFrame:
    """The tree of blocks with the relation, _sure, right_block_role and inferred_title of the boundary before them."""
    w = W.partitionBy("contract_id").orderBy("seq")
    rows = rows.withColumn("_opens", (F.row_number().over(w) == 1) | F.coalesce(F.col("relation").isin("NEW_CLAUSE", "NEW_SUBCLAUSE"), F.lit(False)))
    rows = rows.withColumn("clause_seq", F.sum(F.col("_opens").cast("int")).over(w).cast("int"))
    title = F.col("right_block_role") == "TITLE"
    guessed = F.struct(
        F.lit("未编号").alias("label"),
        F.coalesce(F.nullif(F.trim("inferred_title"), F.lit("")), F.when(title, F.col("text")), F.lit("")).alias("title"),
        F.when(F.col("relation") == "NEW_CLAUSE", 2).otherwise(-1).alias("level"),  # -1: one below the clause before
        F.when(title, F.col("text")).otherwise("").alias("heading"),
        F.when(title, "").otherwise(F.col("text")).alias("inline_body"),
        F.lit("llm_inferred").alias("kind"),
        F.col("_sure").alias("confidence"),
    ).cast(HEADING)
    head = F.when(F.col("_opens"), F.coalesce("heading", F.when(F.col("relation").isNotNull(), guessed)))
    parts = rows.withColumn("_head", head).groupBy("contract_id", "clause_seq").agg(
        F.array_sort(F.collect_list(F.struct("seq", "block_id", "text", "page", "source_block", *[F.col(c) if c in rows.columns else F.lit(None).cast("int").alias(c) for c in ("line_start", "line_end")]))).alias("_blocks"),
        F.min_by("_head", "seq").alias("_head"),
    )
    v = W.partitionBy("contract_id").orderBy("clause_seq")
    deeper = F.coalesce(F.col("_head.level"), F.lit(0)) == -1
    parts = parts.withColumn("_level", F.when(~deeper, F.coalesce("_head.level", F.lit(0))))
    parts = parts.withColumn("_base", F.last("_level", ignorenulls=True).over(v)).withColumn("_run", F.count("_level").over(v))
    parts = parts.withColumn("_depth", F.row_number().over(W.partitionBy("contract_id", "_run").orderBy("clause_seq")) - 1)
    level = F.coalesce("_level", F.least(F.lit(6), F.greatest(F.lit(3), F.coalesce("_base", F.lit(0)) + 1) + F.col("_depth") - 1)).cast("int")
    headed = F.col("_head").isNotNull()
    texts = F.transform("_blocks", lambda b: b["text"])
    first_rest = F.slice(F.split(F.element_at(texts, 1), r"\R", -1), 2, 1 << 30)
    body = F.when(headed, F.concat(F.array("_head.inline_body"), first_rest, F.slice(texts, 2, 1 << 30))).otherwise(texts)
    out = parts.select(
        "contract_id",
        "clause_seq",
        F.format_string("C%04d", "clause_seq").alias("clause_id"),
        F.when(headed & (F.col("_head.label") != ""), F.col("_head.label")).when(headed, "标题").otherwise("前言").alias("label"),
        F.when(headed, F.col("_head.title")).otherwise("合同前言").alias("title"),
        level.alias("level"),
        F.when(headed, F.col("_head.heading")).otherwise("").alias("heading"),
        strip(F.array_join(F.filter(body, lambda x: x != ""), "\n")).alias("body"),
        F.array_join(texts, "\n").alias("text"),
        F.transform("_blocks", lambda b: b["block_id"]).alias("block_ids"),
        F.array_min(F.transform("_blocks", lambda b: b["page"])).alias("page_start"),
        F.array_max(F.transform("_blocks", lambda b: b["page"])).alias("page_end"),
        F.transform("_blocks", lambda b: F.struct(b["block_id"].alias("block_id"), b["source_block"].alias("source_block_id"), b["page"].alias("page"), b["line_start"].alias("line_start"), b["line_end"].alias("line_end"))).alias("source_spans"),
    )
    return with_parents(out)


def with_parents(tree: DataFrame) -> DataFrame:
    """parent_seq and parent_id: the nearest clause before with a lower level, unless a clause of level 0 stands between."""
    before = W.partitionBy("contract_id").orderBy("clause_seq").rowsBetween(W.unboundedPreceding, -1)
    last = {f"_l{k}": F.last(F.when(F.col("level") == k, F.col("clause_seq")), ignorenulls=True).over(before) for k in range(7)}
    tree = tree.withColumns(last)
    nearest = F.greatest(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(6)], F.lit(0))
    parent = F.when((F.col("level") > 0) & (nearest > F.coalesce("_l0", F.lit(0))), nearest).cast("int")
    return tree.withColumn("parent_seq", parent).drop(*last).withColumn("parent_id", F.when(F.col("parent_seq").isNotNull(), F.format_string("C%04d", "parent_seq")))


_BREAKS = r"[\n\x0b\f\r\x{85}\x{2028}\x{2029}]"


_CLAUSES = "array<struct<label:string,text:string>>"


def paragraph_clauses(texts: Column) -> Column:
    """array<struct<label, text>>: the clauses that analyze() makes of one contract's paragraphs, whose texts come in order.

    The whole contract is one row, so that its lines need no sort; paragraphs have no numbering or style of their own.
    Paragraphs of one line each are searched for headings all at once, a mark and the label go before each.
    """
    _, part, apart = P.MARKS
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.array_join(texts, "\n", "")), F.lit(P.HEADING_LINE), F.lit(f"{apart}$2{part}$1$2"))

    def clause(x: Column) -> Column:
        """Of what stands between marks: a label, its mark and the text; or a line feed and the text before all headings."""
        label = lambda f: F.when(f[0].startswith("附"), strip(f[0])).otherwise(f[0])  # noqa: E731  only these can end in blanks
        headed = let(F.split(x, part, -1), lambda f: F.struct(label(f).alias("label"), f[1].alias("text")))
        return F.when(x.startswith("\n"), F.struct(F.lit("前言").alias("label"), F.substring(x, F.lit(2), F.length(x)).alias("text"))).otherwise(headed)

    at_once = F.transform(F.filter(F.split(marked, apart, -1), lambda x: x != ""), clause)
    odd = F.regexp_like(F.array_join(texts, "", ""), F.lit(_BREAKS.replace("[", f"[{P.MARKS}")))
    return F.when(F.size(texts) == 0, F.array().cast(_CLAUSES)).when(odd, _line_by_line(texts)).otherwise(at_once)


def _line_by_line(texts: Column) -> Column:
    """paragraph_clauses() of paragraphs that may have several lines, or marks."""

    def label(text: Column) -> Column:
        """'' without a heading."""
        first = F.when(F.regexp_like(text, F.lit(_BREAKS)), F.element_at(F.split(text, r"\R", 2), 1)).otherwise(text)
        own = let(strip(first), lambda line: F.when(F.length(line) <= 180, strip(F.regexp_extract(line, P.HEADING_LABEL, 1))).otherwise(""))
        return F.when(F.regexp_like(text, F.lit(P.HEADING_BEGINS.replace("^", r"^\s*"))), own).otherwise("")

    def apart(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, r"\R", -1), lambda x: strip(x)), lambda x: x != "")
        return let(lines, lambda held: F.when((F.size(held) > 1) & F.exists(held, is_heading), held).otherwise(F.array(text)))

    def of(blocks: Column, labels: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(blocks)), lambda i: (i == 1) | (F.get(labels, i - 1) != ""))

        def clause(first: Column, stop: Column) -> Column:
            named = F.coalesce(F.nullif(F.get(labels, first - 1), F.lit("")), F.lit("前言"))
            return F.struct(named.alias("label"), F.array_join(F.slice(blocks, first, stop - first), "\n").alias("text"))

        return let(starts, lambda s: F.transform(s, lambda first, i: clause(first, F.coalesce(F.get(s, i + 1), F.size(blocks) + 1))))

    texts = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    blocks = let(texts, lambda ts: F.when(F.exists(ts, lambda t: F.regexp_like(t, F.lit(_BREAKS))), F.flatten(F.transform(ts, apart))).otherwise(ts))
    return let(blocks, lambda bs: let(F.transform(bs, label), lambda labels: of(bs, labels)))


def stats(blocks: DataFrame, tree: DataFrame, decided: DataFrame) -> DataFrame:
    """Counts a contract: characters (and those before cleaning), blocks, clauses, boundaries to review and those that a
    model decided, pages."""
    raw = F.coalesce("raw_text", "text") if "raw_text" in blocks.columns else F.col("text")
    b = blocks.groupBy("contract_id").agg(F.sum(F.length("text")).alias("characters"), F.sum(F.length(raw)).alias("raw_characters"), F.count("*").alias("blocks"), F.max("page").alias("pages") if "page" in blocks.columns else F.lit(None).cast("int").alias("pages"))
    c = tree.groupBy("contract_id").agg(F.count("*").alias("clauses"))
    by_model = F.col("decision_source").startswith("llm:") if "decision_source" in decided.columns else F.lit(False)
    d = decided.groupBy("contract_id").agg(F.count_if("review_required").alias("review_boundaries"), F.count_if(by_model).alias("llm_reviewed_boundaries"))
    return b.join(c, "contract_id", "left").join(d, "contract_id", "left").na.fill(0, ["clauses", "review_boundaries", "llm_reviewed_boundaries"])


def unnumbered(tree: DataFrame) -> DataFrame:
    """Contracts whose only clause has level 0: no numbering was found."""
    return tree.groupBy("contract_id").agg(F.count("*").alias("n"), F.max("level").alias("top")).filter("n = 1 and top = 0").select("contract_id")


def analyze(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks with headings, boundaries, clauses) of raw blocks."""
    prepared = with_headings(prepare_blocks(blocks))
    decided = boundaries(prepared)
    return prepared, decided, own_clauses(prepared)
